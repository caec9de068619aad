"""Python extraction (X11-X20): one file row in, one nested file document out.

Grammar subset (what is read, stated plainly):

* string literals and comments are folded first (see ``source_text``), so a
  ``def`` inside a docstring is never seen as code;
* a *top-level statement* starts at a line whose first character is not
  whitespace, a closing bracket or ``@``; decorator lines belong to the
  statement below them;
* module-level ``def`` / ``async def`` (decorated or not) are functions,
  undecorated module-level ``class`` statements are classes (Q10); anything
  under ``if`` / ``try`` is ignored;
* every ``def`` at any depth inside a class statement is a method (Q9);
* parameter lists may span lines and nest brackets at any depth;
* a docstring is a string literal that is the first statement of the body
  (blank and comment lines before it are skipped).

Everything is computed inside the file row with built-in regex and
higher-order functions: no shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symdex.functions.columns import js_trim, let
from symdex.schemas import ALIAS_T, IFACE_T, PROP_T
from symdex.functions.source_text import (
    PY_NAME, PY_TOKEN, ROUND, clean_docstring, fold, matching, nested, split_top_level, unfold,
)

STR_F = r"""[rRbBuUfF]{0,2}(?:\"\"\"[^\"]*\"\"\"|'''[^']*'''|\"[^\"\n]*\"|'[^'\n]*')"""
_END_STMT = r"(?=[ \t]*(?:;|#[^\n]*)?\r?(?:\n|$))"
_DOC = r"(?:[ \t]*(?:#[^\n]*)?(?:\r?\n[ \t]*(?:#[^\n]*)?)*?[ \t]*(" + STR_F + ")" + _END_STMT + ")?"
PARAMS = "(" + nested(r"\(", r"\)", "[^()]") + ")"
_HEAD = (r"(?:async[ \t]+)?def[ \t]+(" + PY_NAME + r")[ \t]*\(" + PARAMS +
         r"\)[ \t]*(?:->[ \t]*([^:\n]+?)[ \t]*)?:")
FUNC_RE = "^" + _HEAD + _DOC                       # groups: name, params, return, doc
METHOD_RE = r"(?m)^([ \t]+)" + _HEAD + _DOC         # groups: indent, name, params, return, doc
CLASS_RE = (r"^class[ \t]+(" + PY_NAME + r")[ \t]*(?:\(" + nested(r"\(", r"\)", "[^()]") + r"\))?[ \t]*:" + _DOC)
MODULE_DOC_RE = "^(" + STR_F + ")" + _END_STMT
DECORATOR_RE = (r"(?m)^@[ \t]*(" + PY_NAME + r"(?:[ \t]*\.[ \t]*" + PY_NAME + r")*)[ \t]*\(" + PARAMS + r"\)")
TOP_LEVEL_SPLIT = r"\n(?=[^\s)\]}@])"
ROUTE_SUFFIXES = ("get", "post", "put", "delete", "patch")


def _doc_text(folded_literal: Column) -> Column:
    """Cleaned docstring of a folded literal; null when there is none."""
    return let(folded_literal, lambda lit: F.when(lit != "", clean_docstring(unfold(lit))))


def param_names(params: Column, is_method: bool) -> Column:
    """Parameter names; untyped ``*args``/``**kw`` lose their stars; ``*`` and ``/`` are skipped."""
    parts = F.transform(split_top_level(params), lambda p: js_trim(F.regexp_replace(p, r"\s+", " ")))
    parts = F.filter(parts, lambda p: (p != "") & (p != "*") & (p != "/"))
    names = F.transform(
        parts,
        lambda p: F.when(p.rlike(r"^\*{1,2}[^:=]*$"), F.regexp_extract(p, r"^\*{1,2}\s*(" + PY_NAME + ")", 1))
        .when(p.startswith("*"), F.regexp_extract(p, r"^(\*{1,2}\s*" + PY_NAME + ")", 1))
        .otherwise(F.regexp_extract(p, "^(" + PY_NAME + ")", 1)),
    )
    names = F.filter(names, lambda n: n != "")
    if not is_method:
        return names
    return let(names, lambda ns: F.when(F.try_element_at(ns, F.lit(1)).isin("self", "cls"),
                                        F.slice(ns, 2, F.greatest(F.size(ns) - 1, F.lit(0)))).otherwise(ns))


def _return_type(ret: Column) -> Column:
    return F.when(ret != "", js_trim(unfold(ret))).otherwise(F.lit("any"))


def _visibility(name: Column) -> Column:
    """X20."""
    return (F.when(name == "__init__", F.lit("private"))
            .when(name.startswith("__"), F.lit("private"))
            .when(name.startswith("_"), F.lit("protected"))
            .otherwise(F.lit("public")))


def _all_decorators(text: Column) -> Column:
    """Whether the pattern reads every decorator with arguments in the text."""
    return F.size(F.regexp_extract_all(text, F.lit(DECORATOR_RE), 0)) == F.size(F.regexp_extract_all(text, F.lit(r"(?m)^@[^(\n]*\("), 0))


def _routes_of(decorators: Column, fn_name: Column, fn_desc: Column) -> Column:
    """Route records of one decorated module-level function."""
    return let(matching(decorators, _all_decorators, ROUND), lambda text: _read_routes(text, fn_name, fn_desc))


def _read_routes(decorators: Column, fn_name: Column, fn_desc: Column) -> Column:
    names = F.regexp_extract_all(decorators, F.lit(DECORATOR_RE), 1)
    args = F.regexp_extract_all(decorators, F.lit(DECORATOR_RE), 2)

    def one(d):
        arg_list = F.transform(split_top_level(d["a"]), lambda a: js_trim(a))
        return let(F.struct(F.regexp_replace(d["n"], r"[ \t]", "").alias("name"),
                            F.try_element_at(F.filter(arg_list, lambda a: a.rlike("^" + STR_F + "$")), F.lit(1))
                            .alias("path")), lambda v: route_of(v["name"], v["path"], d))

    def route_of(name, path_lit, d):
        listed = F.regexp_extract(d["a"], r"methods[ \t]*=[ \t]*\[[ \t\n]*(" + STR_F + ")", 1)
        is_route = name.endswith(".route")
        suffix = F.regexp_extract(name, r"\.([^.]+)$", 1)
        is_verb = suffix.isin(*ROUTE_SUFFIXES) & name.contains(".")
        method = (F.when(is_route & (listed != ""), clean_docstring(unfold(listed)))
                  .when(is_route, F.lit("GET")).otherwise(F.upper(suffix)))
        return F.when((is_route | is_verb) & path_lit.isNotNull(), F.struct(
            method.alias("method"), clean_docstring(unfold(path_lit)).alias("path"),
            fn_name.alias("handler"), fn_desc.alias("description")))

    recs = F.transform(F.arrays_zip(names.alias("n"), args.alias("a")), one)
    return F.filter(recs, lambda r: r.isNotNull())


def python_file_doc(content: Column) -> Column:
    """X11-X20 for one file: the nested document (empty arrays kept).

    Shared intermediates (folded text, chunks, chunk records, functions,
    class bodies) are bound once with ``let``.
    """
    return let(F.split(F.concat(F.lit("\n"), fold(content, PY_TOKEN)), TOP_LEVEL_SPLIT, -1), _doc_from_chunks)


def _headers_fit(c: Column) -> Column:
    """Whether the patterns read the headers of a chunk, a class's methods included, as they stand."""
    heads = F.size(F.regexp_extract_all(c, F.lit(r"(?m)^[ \t]+(?:async[ \t]+)?def[ \t]+" + PY_NAME + r"[ \t]*\("), 0))
    methods = F.size(F.regexp_extract_all(c, F.lit(METHOD_RE), 0))
    return (F.when(c.rlike(r"^(?:async[ \t]+)?def[ \t]"), c.rlike(FUNC_RE))
            .when(c.rlike(r"^class[ \t]"), c.rlike(CLASS_RE) & (heads == methods)).otherwise(F.lit(True)))


def _doc_from_chunks(chunks: Column) -> Column:
    first = F.try_element_at(chunks, F.lit(1))
    module_lit = F.when(js_trim(first) == "", F.regexp_extract(F.try_element_at(chunks, F.lit(2)), MODULE_DOC_RE, 1))
    module_doc = F.coalesce(_doc_text(F.coalesce(module_lit, F.lit(""))), F.lit(""))

    def info(c, i):
        prev = F.when(i > 0, F.try_element_at(chunks, i)).otherwise(F.lit(""))  # 1-based: the previous chunk
        return F.struct(
            matching(c, _headers_fit, ROUND).alias("c"),
            F.when(c.rlike(r"^(?:async[ \t]+)?def[ \t]"), F.lit("def"))
            .when(c.rlike(r"^class[ \t]"), F.lit("class")).otherwise(F.lit("other")).alias("kind"),
            F.regexp_extract(prev, r"\n(@[\s\S]*)$", 1).alias("decorators"),
        )

    return let(F.struct(F.transform(chunks, info).alias("items"), module_doc.alias("mdoc")), _doc_from_items)


def _doc_from_items(s1: Column) -> Column:
    items, mdoc = s1["items"], s1["mdoc"]

    def function_doc(x):
        c = x["c"]
        name = F.regexp_extract(c, FUNC_RE, 1)
        return let(_doc_text(F.regexp_extract(c, FUNC_RE, 4)), lambda own: F.struct(
            name.alias("name"),
            param_names(F.regexp_extract(c, FUNC_RE, 2), False).alias("params"),
            _return_type(F.regexp_extract(c, FUNC_RE, 3)).alias("return_type"),
            F.coalesce(F.when(own != "", own), mdoc).alias("description"),
            (~name.startswith("_")).alias("exported"),
            x["decorators"].alias("decorators"),
        ))

    def class_raw(x):
        c = x["c"]
        return F.struct(
            F.regexp_extract(c, CLASS_RE, 1).alias("name"),
            _doc_text(F.regexp_extract(c, CLASS_RE, 2)).alias("own"),
            F.arrays_zip(
                F.regexp_extract_all(c, F.lit(METHOD_RE), 2).alias("n"),
                F.regexp_extract_all(c, F.lit(METHOD_RE), 3).alias("p"),
                F.regexp_extract_all(c, F.lit(METHOD_RE), 4).alias("r"),
                F.regexp_extract_all(c, F.lit(METHOD_RE), 5).alias("d"),
            ).alias("ms"),
        )

    stage2 = F.struct(
        F.transform(F.filter(items, lambda x: (x["kind"] == "def") & x["c"].rlike(FUNC_RE)), function_doc).alias("funcs"),
        F.transform(F.filter(
            items, lambda x: (x["kind"] == "class") & (x["decorators"] == "") & x["c"].rlike(CLASS_RE)), class_raw
        ).alias("classes"),
    )
    return let(stage2, lambda s2: _assemble(s2["funcs"], s2["classes"], mdoc))


def _assemble(funcs: Column, classes: Column, mdoc: Column) -> Column:

    def method_doc(m):
        own = _doc_text(m["d"])
        return F.struct(
            m["n"].alias("name"), param_names(m["p"], True).alias("params"),
            _return_type(m["r"]).alias("return_type"),
            F.coalesce(own, F.lit("")).alias("description"), _visibility(m["n"]).alias("visibility"))

    doc = F.struct(
        F.transform(funcs, lambda f: F.struct(
            f["name"].alias("name"), f["params"].alias("params"), f["return_type"].alias("return_type"),
            f["description"].alias("description"), f["exported"].alias("exported"))).alias("functions"),
        F.transform(classes, lambda k: F.struct(
            k["name"].alias("name"), F.coalesce(k["own"], mdoc).alias("description"),
            (~k["name"].startswith("_")).alias("exported"), F.lit(False).alias("is_component"),
            F.transform(k["ms"], method_doc).alias("methods"),
            F.array().cast(f"array<{PROP_T}>").alias("properties"))).alias("classes"),
        F.array().cast(f"array<{IFACE_T}>").alias("interfaces"),
        F.array().cast(f"array<{ALIAS_T}>").alias("type_aliases"),
        F.flatten(F.transform(F.filter(funcs, lambda f: f["decorators"] != ""),
                              lambda f: _routes_of(f["decorators"], f["name"], f["description"]))).alias("routes"),
    )
    return doc


def module_docstring(content: Column) -> Column:
    """The cleaned module docstring ('' when the first statement is not a string)."""
    chunks = F.split(F.concat(F.lit("\n"), fold(content, PY_TOKEN)), TOP_LEVEL_SPLIT, -1)

    def from_chunks(ch):
        first = F.try_element_at(ch, F.lit(1))
        lit = F.when(js_trim(first) == "", F.regexp_extract(F.try_element_at(ch, F.lit(2)), MODULE_DOC_RE, 1))
        return F.coalesce(_doc_text(F.coalesce(lit, F.lit(""))), F.lit(""))
    return let(chunks, from_chunks)
