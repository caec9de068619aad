"""TypeScript / JavaScript extraction (X1-X10, Y4, Y7): file row in, nested document out.

Grammar subset (stated plainly):

* comments, string and template literals are folded first; a comment that
  starts its line is folded together with the whitespace after it, so the
  doc blocks above a declaration sit on the declaration's line;
* a *top-level statement* starts at a line whose first character is not
  whitespace, a closing bracket or ``@`` (declarations at column 0, bodies
  indented, closing braces at column 0 or deeper);
* class and interface *members* are the lines of the body at its smallest
  indentation; a member's text runs to the next such line;
* types are the **declared** text (whitespace collapsed); where the reference
  would infer a type from code, the result here is null (for JavaScript the
  JSDoc ``@returns {T}`` / ``@type {T}`` counts as declared);
* the description is the first ``/** */`` block in the comment run directly
  above the declaration, text before the first tag (Q12).

All work happens inside the file row (regex + higher-order functions).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symdex.functions.columns import js_trim, let
from symdex.functions.source_text import (
    FOLD_TO, NAME, TS_TOKEN, fold, jsdoc_description, jsdoc_return_type, matching, nested, split_top_level, unfold,
)
from symdex.schemas import ALIAS_T, IFACE_T

_WS_F = "[ \\t" + FOLD_TO[0] + FOLD_TO[1] + "]"  # whitespace, including folded newlines
# Leading run of folded comments (each possibly followed by folded whitespace).
LEAD = (r"^[ \t]*((?:/\*[^\n]*?\*/" + _WS_F + r"*+|//[^" + FOLD_TO[0] + r"\n]*+" + _WS_F + r"*+)*+)")
TP = "(?:<" + nested("<", ">", "=>|[^<>]") + ">)"
PARAMS = "(" + nested(r"\(", r"\)", "[^()]") + ")"
RET = r"((?:=>|[^{};=]|\{" + nested(r"\{", r"\}", "[^{}]") + r"\})+?)"
FUNC_DECL = (r"^(export[ \t]+(?:default[ \t]+)?)?(?:declare[ \t]+)?(?:async[ \t]+)?function(?![\p{L}\p{N}_$])[ \t]*\*?[ \t]*("
             + NAME + r")?[ \t]*" + TP + r"?[ \t]*\(" + PARAMS + r"\)[ \t]*(?::[ \t]*" + RET + r")?[ \t]*([{;])")
CLASS_DECL = (r"^(export[ \t]+(?:default[ \t]+)?)?(?:declare[ \t]+)?(?:abstract[ \t]+)?class(?![\p{L}\p{N}_$])[ \t]*("
              + NAME + r")?[ \t]*" + TP + r"?[ \t]*(?:extends[ \t]+([^{]*?))?[ \t]*(?:implements[ \t]+[^{]*?)?[ \t]*\{")
IFACE_DECL = (r"^(export[ \t]+(?:default[ \t]+)?)?(?:declare[ \t]+)?interface[ \t]+(" + NAME + r")[ \t]*" + TP
              + r"?[ \t]*(?:extends[ \t]+[^{]*?)?[ \t]*\{")
ALIAS_DECL = (r"^(export[ \t]+)?(?:declare[ \t]+)?type[ \t]+(" + NAME + r")[ \t]*" + TP + r"?[ \t]*=[ \t]*([\s\S]*)$")
VAR_FUNC_DECL = (r"^(export[ \t]+)?(?:const|let|var)[ \t]+(" + NAME + r")[ \t]*(?::[^=]*)?=[ \t]*(?:async[ \t]*)?"
                 r"(?:function(?![\p{L}\p{N}_$])[ \t]*\*?[ \t]*(?:" + NAME + r")?[ \t]*\(" + PARAMS + r"\)"
                 r"|\(" + PARAMS + r"\)[ \t]*(?::[ \t]*[^=]+?)?[ \t]*=>|(" + NAME + r")[ \t]*=>)")
MODIFIERS = r"(?:(?:public|private|protected|static|async|readonly|abstract|override|declare)[ \t]+)*"
METHOD_MEMBER = (r"^(" + MODIFIERS + r")(?:\*[ \t]*)?(#?" + NAME + r")[ \t]*\??[ \t]*" + TP + r"?[ \t]*\(" + PARAMS
                 + r"\)[ \t]*(?::[ \t]*" + RET + r")?[ \t]*[{;]")
PROP_MEMBER = (r"^(" + MODIFIERS + r")(#?" + NAME + r")[ \t]*[?!]?[ \t]*(?::[ \t]*([^=;]+?))?[ \t]*(?:=[\s\S]*|;[\s\S]*)?$")
SIG_METHOD = (r"^(?:readonly[ \t]+)?(" + NAME + r")[ \t]*\??[ \t]*" + TP + r"?[ \t]*\(" + PARAMS
              + r"\)[ \t]*(?::[ \t]*([\s\S]+?))?[ \t]*[;,]?[ \t]*$")
SIG_PROP = r"^(?:readonly[ \t]+)?(" + NAME + r")[ \t]*\??[ \t]*:[ \t]*([\s\S]+?)[ \t]*[;,]?[ \t]*$"
STR_LIT = r"""(?:'[^'\n]*'|"[^"\n]*")"""
ROUTE_RE = (r"(?m)(?:\.[ \t\n]*(get|post|put|delete|patch)[ \t\n]*\([ \t\n]*(" + STR_LIT + r")[ \t\n]*,[ \t\n]*(?=([^\n]*))"
            r"|(?:^|(?<=" + FOLD_TO[0] + r"))(?:(export)[ \t]+(?:default[ \t]+)?)?(?:async[ \t]+)?function[ \t]+(handler)[ \t]*\()")
TOP_LEVEL_SPLIT = r"\n(?=[^\s)\]}@])"
JSDOC_IN = r"(/\*\*(?!/)[^\n]*?\*/)"


def _collapse(text: Column) -> Column:
    """Declared type text: comments removed, whitespace runs collapsed, trimmed."""
    no_comments = F.regexp_replace(text, r"/\*[^\n]*?\*/|//[^" + FOLD_TO[0] + r"\n]*", "")
    return js_trim(F.regexp_replace(unfold(no_comments), r"\s+", " "))


def _describe(lead: Column) -> Column:
    return let(F.regexp_extract(lead, JSDOC_IN, 1), lambda block: F.when(block != "", jsdoc_description(unfold(block))))


def _lead_jsdoc(lead: Column) -> Column:
    """The doc block closest to the declaration (the last one of the run)."""
    return let(F.try_element_at(F.regexp_extract_all(lead, F.lit(JSDOC_IN), 1), F.lit(-1)),
               lambda block: F.when(block.isNotNull(), unfold(block)))


#: A declaration whose header holds brackets, and the patterns that read it.
_DECLARES = r"^(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+|abstract[ \t]+)?(?:function|class|interface|type|const|let|var)(?![\p{L}\p{N}_$])"


def _header_fits(decl: Column) -> Column:
    """No declaration, or one that a pattern reads as it stands."""
    fits = ~decl.rlike(_DECLARES)
    for pattern in (FUNC_DECL, CLASS_DECL, IFACE_DECL, ALIAS_DECL, VAR_FUNC_DECL):
        fits = fits | decl.rlike(pattern)
    return fits


def _strip_lead(text: Column) -> Column:
    return F.regexp_replace(text, LEAD, "")


def ts_params(params: Column) -> Column:
    """Parameter names: decorators and modifiers dropped, ``...rest`` -> rest, patterns kept as text."""
    parts = F.transform(split_top_level(params), lambda p: js_trim(F.regexp_replace(unfold(p), r"\s+", " ")))
    parts = F.filter(parts, lambda p: p != "")
    cleaned = F.transform(parts, lambda p: F.regexp_replace(
        p, r"^(?:@[\w.]+(?:\([^()]*\))?\s*)*(?:(?:public|private|protected|readonly|override)\s+)*", ""))
    return F.transform(cleaned, lambda p: F.when(
        p.rlike(r"^[{\[]"), F.regexp_extract(p, r"^(\{[^}]*\}|\[[^\]]*\])", 1)).otherwise(
        F.regexp_extract(p, r"^(?:\.\.\.)?\s*(" + NAME + ")", 1)))


def _visibility(mods: Column) -> Column:
    return (F.when(mods.rlike(r"(^|\s)private\s"), F.lit("private"))
            .when(mods.rlike(r"(^|\s)protected\s"), F.lit("protected")).otherwise(F.lit("public")))


def _members(body: Column) -> Column:
    """Member texts of a class / interface body (lines at the body's smallest indentation)."""
    def with_code(code):
        widths = F.transform(code, lambda l: F.length(F.regexp_extract(l, r"^([ \t]*)", 1)))
        return let(F.array_min(widths), lambda indent: let(
            F.substring(F.try_element_at(F.filter(code, lambda l: F.length(F.regexp_extract(l, r"^([ \t]*)", 1)) == indent),
                                         F.lit(1)), 1, indent),
            lambda ind: F.filter(F.transform(
                F.split(F.concat(F.lit("\n"), body), F.concat(F.lit("\n(?="), F.coalesce(ind, F.lit("")), F.lit(r"[^\s}])")), -1),
                lambda p: F.regexp_replace(p, r"^[ \t\n]+", "")), lambda p: p != "")))
    return let(F.filter(F.split(body, "\n", -1), lambda l: (js_trim(unfold(l)) != "") & ~l.rlike(r"^\}")), with_code)


def _body(chunk: Column, header_re: str) -> Column:
    """Text after the header's opening brace, without the closing brace."""
    start = F.length(F.regexp_extract(chunk, "(" + header_re + ")", 1))
    rest = F.substring(chunk, start + 1, 1 << 30)
    return F.regexp_replace(rest, r"\}[ \t;]*\s*$", "")


def _exported_names(folded: Column) -> Column:
    """Names exported by ``module.exports = {...}``, ``export {...}`` or ``export default NAME`` (Q13)."""
    objs = F.concat(
        F.regexp_extract_all(folded, F.lit(r"module\.exports[ \t]*=[ \t]*\{([^}]*)\}"), 1),
        F.regexp_extract_all(folded, F.lit(r"(?m)^export[ \t]*\{([^}]*)\}(?![ \t]*from)"), 1),
    )
    names = F.flatten(F.transform(objs, lambda o: F.transform(F.split(o, ","), lambda e: js_trim(
        F.regexp_extract(e, r"(?:^|:|\bas\b)?[ \t\n]*(" + NAME + r")[ \t\n]*(?:as[ \t\n]+" + NAME + r")?[ \t\n]*$", 1)))))
    singles = F.concat(
        F.regexp_extract_all(folded, F.lit(r"module\.exports[ \t]*=[ \t]*(" + NAME + r")[ \t]*;?[ \t]*(?:\n|$)"), 1),
        F.regexp_extract_all(folded, F.lit(r"(?:module\.)?exports\.[\p{L}_$][\p{L}\p{N}_$]*[ \t]*=[ \t]*(" + NAME + r")[ \t]*;?"), 1),
        F.regexp_extract_all(folded, F.lit(r"(?m)^export[ \t]+default[ \t]+(" + NAME + r")[ \t]*;?[ \t]*$"), 1),
    )
    # keyed names "a: b" export the local b; shorthand exports the name itself
    keyed = F.flatten(F.transform(objs, lambda o: F.regexp_extract_all(o, F.lit(":[ \\t\\n]*(" + NAME + ")"), 1)))
    return F.filter(F.array_distinct(F.concat(names, singles, keyed)), lambda n: n != "")


def script_file_doc(content: Column, language: Column, path: Column) -> Column:
    """X1-X10 for one TypeScript or JavaScript file (``language`` = 'ts' / 'js').

    Interfaces and type aliases are read for TypeScript only; JavaScript takes
    declared types from JSDoc.  Shared intermediates are bound with ``let``.
    """
    def with_folded(folded):
        chunks = F.split(F.concat(F.lit("\n"), folded), TOP_LEVEL_SPLIT, -1)
        s1 = F.struct(
            folded.alias("folded"),
            F.transform(chunks, lambda c: F.struct(
                F.regexp_extract(c, LEAD, 1).alias("lead"), matching(_strip_lead(c), _header_fits).alias("decl"))).alias("items"),
            _exported_names(folded).alias("exp"),
        )
        return let(s1, lambda v: _script_doc(v, language, path))
    return let(fold(content, TS_TOKEN), with_folded)


def _script_doc(s1: Column, language: Column, path: Column) -> Column:
    folded, items, exported_set = s1["folded"], s1["items"], s1["exp"]
    is_js = language == "js"
    is_ts = language == "ts"

    def is_exported(export_kw: Column, name: Column) -> Column:
        return (export_kw != "") | F.array_contains(exported_set, name)

    def typed(declared: Column, lead: Column) -> Column:
        rt = F.when(declared != "", _collapse(declared))
        return F.coalesce(rt, F.when(is_js, jsdoc_return_type(_lead_jsdoc(lead))))

    def fn(x):
        d = x["decl"]
        name = F.regexp_extract(d, FUNC_DECL, 2)
        return F.struct(
            F.when(name != "", name).otherwise(F.lit("<anonymous>")).alias("name"),
            ts_params(F.regexp_extract(d, FUNC_DECL, 3)).alias("params"),
            typed(F.regexp_extract(d, FUNC_DECL, 4), x["lead"]).alias("return_type"),
            _describe(x["lead"]).alias("description"),
            is_exported(F.regexp_extract(d, FUNC_DECL, 1), name).alias("exported"),
        )

    has_body = lambda x: x["decl"].rlike(FUNC_DECL) & (
        (F.regexp_extract(x["decl"], FUNC_DECL, 5) == "{") | x["decl"].rlike(r"^(?:export[ \t]+)?declare[ \t]"))

    def with_members(x, header):
        def member_fits(t):
            return t.rlike(METHOD_MEMBER if header is CLASS_DECL else SIG_METHOD)

        members = _members(_body(x["decl"], header))
        return F.struct(
            x["lead"].alias("lead"), x["decl"].alias("decl"),
            F.transform(members, lambda m: F.struct(
                F.regexp_extract(m, LEAD, 1).alias("lead"), matching(_strip_lead(m), member_fits).alias("t"))).alias("members"))

    api_path = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        path, r"^.*/pages/api/", "/"), r"\.[jt]sx?$", ""), r"/index$", "/")

    def route(r):
        verb = F.upper(r["v"])
        p = unfold(F.regexp_extract(r["p"], r"^['\"]([\s\S]*)['\"]$", 1))
        a = r["a"]
        handler = (F.when(a.rlike(r"^" + NAME + r"[ \t]*(?:,|\))"), F.regexp_extract(a, "^(" + NAME + ")", 1))
                   .when(a.rlike(r"^(?:async[ \t]+)?function(?![\p{L}\p{N}_$])"), F.lit("<inline function>"))
                   .when(a.rlike(r"^(?:async[ \t]*)?(?:\((?:[^()]|\([^()]*\))*\)|" + NAME + r")[ \t]*(?::[^=]*?)?=>"),
                         F.lit("<inline function>"))
                   .otherwise(F.lit("")))
        express = F.struct(verb.alias("method"), p.alias("path"), handler.alias("handler"),
                           F.concat(verb, F.lit(" "), p).alias("description"))
        nextjs = F.struct(F.lit("ANY").alias("method"), api_path.alias("path"), F.lit("handler").alias("handler"),
                          F.concat(F.lit("API route for "), api_path).alias("description"))
        return F.when(r["h"] != "", nextjs).otherwise(express)

    routes = F.arrays_zip(
        F.regexp_extract_all(folded, F.lit(ROUTE_RE), 1).alias("v"),
        F.regexp_extract_all(folded, F.lit(ROUTE_RE), 2).alias("p"),
        F.regexp_extract_all(folded, F.lit(ROUTE_RE), 3).alias("a"),
        F.regexp_extract_all(folded, F.lit(ROUTE_RE), 4).alias("e"),
        F.regexp_extract_all(folded, F.lit(ROUTE_RE), 5).alias("h"))
    # a handler is a route where it is exported, at its declaration or by its name
    routes = F.transform(F.filter(routes, lambda r: (r["h"] == "") | is_exported(r["e"], r["h"])), route)

    aliases = F.transform(F.filter(items, lambda x: x["decl"].rlike(ALIAS_DECL)), lambda x: F.struct(
        F.regexp_extract(x["decl"], ALIAS_DECL, 2).alias("name"),
        _collapse(F.regexp_replace(F.regexp_extract(x["decl"], ALIAS_DECL, 3), r"[\s;]+$", "")).alias("type"),
        _describe(x["lead"]).alias("description"),
        (F.regexp_extract(x["decl"], ALIAS_DECL, 1) != "").alias("exported")))

    stage2 = F.struct(
        F.transform(F.filter(items, has_body), fn).alias("funcs"),
        F.transform(F.filter(items, lambda x: x["decl"].rlike(CLASS_DECL)),
                    lambda x: with_members(x, CLASS_DECL)).alias("cls"),
        F.when(is_ts, F.transform(F.filter(items, lambda x: x["decl"].rlike(IFACE_DECL)),
                                  lambda x: with_members(x, IFACE_DECL))).alias("ifs"),
        F.when(is_ts, aliases).otherwise(F.array().cast(f"array<{ALIAS_T}>")).alias("aliases"),
        routes.alias("routes"),
    )

    def member_method(m):
        t = m["t"]
        return F.struct(
            F.regexp_extract(t, METHOD_MEMBER, 2).alias("name"),
            ts_params(F.regexp_extract(t, METHOD_MEMBER, 3)).alias("params"),
            typed(F.regexp_extract(t, METHOD_MEMBER, 4), m["lead"]).alias("return_type"),
            _describe(m["lead"]).alias("description"),
            _visibility(F.regexp_extract(t, METHOD_MEMBER, 1)).alias("visibility"),
        )

    def member_prop(m):
        t = m["t"]
        ty = F.regexp_extract(t, PROP_MEMBER, 3)
        js_type = F.regexp_extract(F.coalesce(_lead_jsdoc(m["lead"]), F.lit("")), r"@type\s*\{([^}]*)\}", 1)
        declared = F.coalesce(F.when(ty != "", _collapse(ty)), F.when(is_js & (js_type != ""), js_type))
        return F.struct(
            F.regexp_extract(t, PROP_MEMBER, 2).alias("name"), declared.alias("type"),
            _describe(m["lead"]).alias("description"),
            _visibility(F.regexp_extract(t, PROP_MEMBER, 1)).alias("visibility"),
        )

    def is_method(m):
        t = m["t"]
        return t.rlike(METHOD_MEMBER) & (F.regexp_extract(t, METHOD_MEMBER, 2) != "constructor") & ~t.startswith("@")

    def is_prop(m):
        t = m["t"]
        return (~t.rlike(METHOD_MEMBER) & t.rlike(PROP_MEMBER) & ~t.startswith("@")
                & ~t.rlike(r"^(?:get|set|static)[ \t]+[^(=:;]*\(") & ~t.rlike(r"^constructor\b"))

    def cls(x):
        d = x["decl"]
        name = F.regexp_extract(d, CLASS_DECL, 2)
        extends = js_trim(unfold(F.regexp_extract(d, CLASS_DECL, 3)))
        has_render = F.exists(x["members"], lambda m: is_method(m) & (F.regexp_extract(m["t"], METHOD_MEMBER, 2) == "render"))
        return F.struct(
            F.when(name != "", name).otherwise(F.lit("<anonymous>")).alias("name"),
            _describe(x["lead"]).alias("description"),
            is_exported(F.regexp_extract(d, CLASS_DECL, 1), name).alias("exported"),
            (extends.contains("Component") | has_render).alias("is_component"),
            F.transform(F.filter(x["members"], is_method), member_method).alias("methods"),
            F.transform(F.filter(x["members"], is_prop), member_prop).alias("properties"),
        )

    def sig_method(m):
        t = m["t"]
        ret = F.regexp_extract(t, SIG_METHOD, 3)
        return F.struct(
            F.regexp_extract(t, SIG_METHOD, 1).alias("name"),
            ts_params(F.regexp_extract(t, SIG_METHOD, 2)).alias("params"),
            F.when(ret != "", _collapse(ret)).alias("return_type"),
            _describe(m["lead"]).alias("description"), F.lit(None).cast("string").alias("visibility"))

    def sig_prop(m):
        t = m["t"]
        return F.struct(
            F.regexp_extract(t, SIG_PROP, 1).alias("name"), _collapse(F.regexp_extract(t, SIG_PROP, 2)).alias("type"),
            _describe(m["lead"]).alias("description"), F.lit(None).cast("string").alias("visibility"))

    def iface(x):
        d = x["decl"]
        is_sig = lambda m: m["t"].rlike(SIG_METHOD)
        return F.struct(
            F.regexp_extract(d, IFACE_DECL, 2).alias("name"), _describe(x["lead"]).alias("description"),
            (F.regexp_extract(d, IFACE_DECL, 1) != "").alias("exported"),
            F.transform(F.filter(x["members"], lambda m: ~is_sig(m) & m["t"].rlike(SIG_PROP)), sig_prop).alias("properties"),
            F.transform(F.filter(x["members"], is_sig), sig_method).alias("methods"),
        )

    return let(stage2, lambda s2: F.struct(
        s2["funcs"].alias("functions"),
        F.transform(s2["cls"], cls).alias("classes"),
        F.coalesce(F.transform(s2["ifs"], iface), F.array().cast(f"array<{IFACE_T}>")).alias("interfaces"),
        s2["aliases"].alias("type_aliases"),
        s2["routes"].alias("routes"),
    ))
