"""The retired surface (Y1-Y13): extra extractors and the declaration / reference search.

Same approach as the live extractors: fold literals and comments, split into
top-level chunks and members, read with regexes, all inside the file row.
Every function returns flat rows so that each feature can be queried alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdex.functions.columns import let
from symdex.functions.source_text import NAME, TS_TOKEN, fold, jsdoc_return_type, unfold
from symdex.operators.extract_ts import (
    CLASS_DECL, FUNC_DECL, LEAD, METHOD_MEMBER, ROUTE_RE, STR_LIT, TOP_LEVEL_SPLIT, VAR_FUNC_DECL,
    _body, _describe, _lead_jsdoc, _members, _strip_lead, ts_params,
)

NEST_VERBS = ("Get", "Post", "Put", "Delete", "Patch", "Options", "Head")
WIDE_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
HOOK_RE = r"(?<![\p{L}\p{N}_$.])(use[A-Z][\p{L}\p{N}_$]*)[ \t]*\("
PROPTYPE_RE = r"(?<![\p{L}\p{N}_$])([\p{L}_$][\p{L}\p{N}_$]*)\.([\p{L}_$][\p{L}\p{N}_$]*)[ \t]*=[ \t]*PropTypes\.([\p{L}\p{N}_$.]+)"


def _items(files: DataFrame) -> DataFrame:
    """(path, folded, items[lead, decl]) per file."""
    def per_file(folded):
        chunks = F.split(F.concat(F.lit("\n"), folded), TOP_LEVEL_SPLIT, -1)
        return F.struct(folded.alias("folded"), F.transform(chunks, lambda c: F.struct(
            F.regexp_extract(c, LEAD, 1).alias("lead"), _strip_lead(c).alias("decl"))).alias("items"))
    return files.select("path", let(fold(F.col("content"), TS_TOKEN), per_file).alias("f")).select(
        "path", F.col("f.folded").alias("folded"), F.col("f.items").alias("items"))


def _explode(df: DataFrame, arr: Column, *keep: str) -> DataFrame:
    """explode_outer + null test (keeps Catalyst from inferring and pushing a size filter)."""
    return df.select(*keep, F.posexplode_outer(arr).alias("pos", "x")).where(F.col("x").isNotNull())


def function_variables(files: DataFrame) -> DataFrame:
    """Top-level variables initialised with a function or arrow function, as functions."""
    it = _items(files)
    rows = _explode(it, F.filter(F.col("items"), lambda x: x["decl"].rlike(VAR_FUNC_DECL)), "path")
    d = F.col("x.decl")
    params = F.coalesce(F.when(F.regexp_extract(d, VAR_FUNC_DECL, 3) != "", F.regexp_extract(d, VAR_FUNC_DECL, 3)),
                        F.when(F.regexp_extract(d, VAR_FUNC_DECL, 4) != "", F.regexp_extract(d, VAR_FUNC_DECL, 4)),
                        F.regexp_extract(d, VAR_FUNC_DECL, 5))
    return rows.select(F.col("path").alias("file"), "pos", F.regexp_extract(d, VAR_FUNC_DECL, 2).alias("name"),
                       F.array_join(ts_params(params), ", ").alias("params"),
                       (F.regexp_extract(d, VAR_FUNC_DECL, 1) != "").alias("exported"),
                       _describe(F.col("x.lead")).alias("description"))


def _class_members(files: DataFrame) -> DataFrame:
    it = _items(files)
    cls = _explode(it, F.filter(F.col("items"), lambda x: x["decl"].rlike(CLASS_DECL)), "path")
    return cls.select("path", F.col("pos").alias("class_pos"),
                      F.regexp_extract(F.col("x.decl"), CLASS_DECL, 2).alias("class_name"),
                      F.transform(_members(_body(F.col("x.decl"), CLASS_DECL)), lambda m: F.struct(
                          F.regexp_extract(m, LEAD, 1).alias("lead"), _strip_lead(m).alias("t"))).alias("members"))


def decorator_routes(files: DataFrame) -> DataFrame:
    """``@Get('/path')``-style decorators on class methods; handler = the decorated method."""
    members = _class_members(files)
    deco = r"^@(" + "|".join(NEST_VERBS) + r")[ \t]*\([ \t]*(" + STR_LIT + r")"

    def route(m, i):
        nxt = F.try_element_at(F.filter(F.slice(F.col("members"), i + 2, 1 << 20),
                                        lambda n: ~n["t"].startswith("@")), F.lit(1))
        handler = F.when(nxt.isNotNull() & nxt["t"].rlike(METHOD_MEMBER), F.regexp_extract(nxt["t"], METHOD_MEMBER, 2))
        verb = F.upper(F.regexp_extract(m["t"], deco, 1))
        path = unfold(F.regexp_extract(F.regexp_extract(m["t"], deco, 2), r"^['\"]([\s\S]*)['\"]$", 1))
        return F.when(m["t"].rlike(deco), F.struct(
            verb.alias("method"), path.alias("path"), F.coalesce(handler, F.lit("")).alias("handler"),
            F.concat(verb, F.lit(" "), path).alias("description")))

    rows = _explode(members, F.filter(F.transform(F.col("members"), route), lambda r: r.isNotNull()), "path", "class_name")
    return rows.select(F.col("path").alias("file"), "pos", "class_name", F.col("x.method").alias("method"),
                       F.col("x.path").alias("route_path"), F.col("x.handler").alias("handler"),
                       F.col("x.description").alias("description"))


def express_routes_wide(files: DataFrame) -> DataFrame:
    """X9 with ``head`` and ``options`` too, method names matched case-insensitively."""
    wide = ROUTE_RE.replace("(get|post|put|delete|patch)", "((?i:" + "|".join(WIDE_VERBS) + "))")
    it = _items(files)
    recs = F.arrays_zip(
        F.regexp_extract_all(F.col("folded"), F.lit(wide), 1).alias("v"),
        F.regexp_extract_all(F.col("folded"), F.lit(wide), 2).alias("p"),
        F.regexp_extract_all(F.col("folded"), F.lit(wide), 3).alias("a"))
    rows = _explode(it, F.filter(recs, lambda r: r["v"] != ""), "path")
    a = F.col("x.a")
    handler = (F.when(a.rlike(r"^" + NAME + r"[ \t]*(?:,|\))"), F.regexp_extract(a, "^(" + NAME + ")", 1))
               .when(a.rlike(r"^(?:async[ \t]+)?function(?![\p{L}\p{N}_$])"), F.lit("<inline function>"))
               .when(a.rlike(r"^(?:async[ \t]*)?(?:\((?:[^()]|\([^()]*\))*\)|" + NAME + r")[ \t]*(?::[^=]*?)?=>"),
                     F.lit("<inline function>")).otherwise(F.lit("")))
    path = unfold(F.regexp_extract(F.col("x.p"), r"^['\"]([\s\S]*)['\"]$", 1))
    return rows.select(F.col("path").alias("file"), "pos", F.upper(F.col("x.v")).alias("method"),
                       path.alias("route_path"), handler.alias("handler"))


def jsdoc_return_types(files: DataFrame) -> DataFrame:
    """The ``@returns {T}`` type of every top-level function's closest doc block."""
    it = _items(files)
    rows = _explode(it, F.filter(F.col("items"), lambda x: x["decl"].rlike(FUNC_DECL)), "path")
    return rows.select(F.col("path").alias("file"), F.regexp_extract(F.col("x.decl"), FUNC_DECL, 2).alias("name"),
                       jsdoc_return_type(_lead_jsdoc(F.col("x.lead"))).alias("return_type"))


def js_method_visibility(files: DataFrame) -> DataFrame:
    """JavaScript class methods, private when the name starts with ``_``."""
    members = _class_members(files)
    is_m = lambda m: m["t"].rlike(METHOD_MEMBER) & (F.regexp_extract(m["t"], METHOD_MEMBER, 2) != "constructor")
    rows = _explode(members, F.filter(F.col("members"), is_m), "path", "class_name")
    name = F.regexp_extract(F.col("x.t"), METHOD_MEMBER, 2)
    return rows.select(F.col("path").alias("file"), "class_name", name.alias("method"),
                       F.when(name.startswith("_"), F.lit("private")).otherwise(F.lit("public")).alias("visibility"))


def constructor_properties(files: DataFrame) -> DataFrame:
    """``this.x`` accesses in the first constructor of each class, in order, duplicates kept."""
    members = _class_members(files)
    ctor = F.try_element_at(F.filter(F.col("members"), lambda m: m["t"].rlike(r"^constructor[ \t]*\(")), F.lit(1))
    props = F.regexp_extract_all(F.coalesce(ctor["t"], F.lit("")), F.lit(r"(?<![\p{L}\p{N}_$])this[ \t]*\.[ \t]*("
                                                                          + NAME + ")"), 1)
    rows = members.select("path", "class_name", F.posexplode_outer(props).alias("pos", "prop")).where(
        F.col("prop").isNotNull())
    return rows.select(F.col("path").alias("file"), "class_name", "pos", "prop",
                       F.when(F.col("prop").startswith("_"), F.lit("private")).otherwise(F.lit("public")).alias("visibility"))


def _component_gate(path: Column, folded: Column) -> Column:
    return (F.lower(path).rlike(r"\.(tsx|jsx)$")
            | folded.rlike(r"from[ \t]*['\"]react['\"]|require\([ \t]*['\"]react['\"][ \t]*\)"))


def components(files: DataFrame) -> DataFrame:
    """Function components (a ``return <...>`` JSX return) and component classes.

    Output per component: name, kind, description, hooks (distinct, first-seen
    order), props (PropTypes assignments: name and type).
    """
    is_fn = lambda x: (x["decl"].rlike(FUNC_DECL) | x["decl"].rlike(VAR_FUNC_DECL)) & x["decl"].rlike(r"return[ \t]+<")
    is_class = lambda x: x["decl"].rlike(CLASS_DECL)

    def of_kind(kind, test):
        return F.transform(F.filter(F.col("items"), test), lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), x["lead"].alias("lead"), x["decl"].alias("decl")))

    # one array for both kinds, empty where the gate is shut: as a filter the gate would be pushed below the folding and fold again
    both = F.when(_component_gate(F.col("path"), F.col("folded")), F.concat(of_kind("function", is_fn), of_kind("class", is_class)))
    rows = _items(files).select("path", F.explode_outer(both).alias("x")).where(F.col("x").isNotNull())
    d, is_class_row = F.col("x.decl"), F.col("x.kind") == "class"
    fn_name = F.when(d.rlike(FUNC_DECL), F.coalesce(F.when(F.regexp_extract(d, FUNC_DECL, 2) != "",
                                                           F.regexp_extract(d, FUNC_DECL, 2)), F.lit("<anonymous>"))) \
        .otherwise(F.regexp_extract(d, VAR_FUNC_DECL, 2))
    props = F.transform(F.arrays_zip(F.regexp_extract_all(d, F.lit(PROPTYPE_RE), 2).alias("n"),
                                     F.regexp_extract_all(d, F.lit(PROPTYPE_RE), 3).alias("t")),
                        lambda p: F.struct(p["n"].alias("name"), p["t"].alias("type")))
    extends = F.regexp_extract(d, CLASS_DECL, 3)
    has_render = F.exists(_members(_body(d, CLASS_DECL)), lambda m: _strip_lead(m).rlike(r"^render[ \t]*\("))
    return rows.where(~is_class_row | extends.contains("Component") | has_render).select(
        F.col("path").alias("file"), F.col("x.pos").alias("pos"),
        F.when(is_class_row, F.regexp_extract(d, CLASS_DECL, 2)).otherwise(fn_name).alias("name"), F.col("x.kind").alias("kind"),
        _describe(F.col("x.lead")).alias("description"),
        F.when(is_class_row, F.array().cast("array<string>")).otherwise(F.array_distinct(F.regexp_extract_all(d, F.lit(HOOK_RE), 1))).alias("hooks"),
        F.when(is_class_row, F.array().cast("array<struct<name:string,type:string>>")).otherwise(props).alias("props"))


def hooks(files: DataFrame) -> DataFrame:
    """One row per (component, hook) in first-seen order."""
    c = components(files)
    return c.select("file", "name", F.posexplode_outer("hooks").alias("hook_pos", "hook")).where(F.col("hook").isNotNull())


def prop_types(files: DataFrame) -> DataFrame:
    """One row per PropTypes assignment of a function component."""
    c = components(files)
    return c.select("file", "name", F.posexplode_outer("props").alias("prop_pos", "p")).where(F.col("p").isNotNull()) \
        .select("file", "name", "prop_pos", F.col("p.name").alias("prop"), F.col("p.type").alias("prop_type"))


def default_handler_routes(files: DataFrame) -> DataFrame:
    """The ``ANY`` route of a ``function handler`` that is the default export, there or by its name (the stated intent)."""
    it = _items(files)
    named = F.col("folded").rlike(r"(?m)^export[ \t]+(?:default[ \t]+handler[ \t]*;?[ \t]*$|\{(?:[^}]*,)?\s*handler\s+as\s+default\s*[,}])")

    def is_h(x):
        declares = r"(?:async[ \t]+)?function[ \t]+handler[ \t]*\("
        return x["decl"].rlike(r"^export[ \t]+default[ \t]+" + declares) | (named & x["decl"].rlike("^" + declares))

    rows = _explode(it, F.filter(F.col("items"), is_h), "path")
    api = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("path"), r"^.*/pages/api/", "/"),
                                            r"\.[jt]sx?$", ""), r"/index$", "/")
    return rows.select(F.col("path").alias("file"), F.lit("ANY").alias("method"), api.alias("route_path"),
                       F.lit("handler").alias("handler"), F.concat(F.lit("API route for "), api).alias("description"))


