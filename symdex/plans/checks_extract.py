"""Extraction keys (X1-X21, G2, D3, E3, B1, B2) on ``code_py``, ``code_ts``, ``code_js``, ``doc_files``.

Render -> extract -> compare: the files are rendered from table columns, so
the expected symbols follow from the same columns without any parsing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from symdex.operators import file_docs as FD
from symdex.plans.catalog import register, source_files
from symdex.sources.fixtures import load_view, with_views

SYM_COLS = ("file, seq, symbol, type, description, signature, exported, parent_symbol, is_component, "
            "visibility, route_method, route_path, handler")


def _symbols(spark, sf, view):
    return FD.flatten_file_docs(FD.file_docs(source_files(spark, sf, view)))


def _row(file, seq, symbol, kind, desc="null", sig="null", exported="null", parent="null", comp="null",
         vis="null", rmethod="null", rpath="null", handler="null"):
    return (f"select {file} as file, cast({seq} as integer) as seq, {symbol} as symbol, '{kind}' as type, "
            f"cast({desc} as varchar) as description, cast({sig} as varchar) as signature, "
            f"cast({exported} as boolean) as exported, cast({parent} as varchar) as parent_symbol, "
            f"cast({comp} as boolean) as is_component, cast({vis} as varchar) as visibility, "
            f"cast({rmethod} as varchar) as route_method, cast({rpath} as varchar) as route_path, "
            f"cast({handler} as varchar) as handler")


# --- Python ------------------------------------------------------------------------

_PY = ("(select cast(p_partkey as varchar) as k, p_name, p_type, p_size, "
       "'/py/' || replace(p_brand, '#', '') || '/m' || cast(p_partkey as varchar) || '.py' as f, "
       "p_name || ' module.' as mdoc from part)")
_PY_ROWS = [
    _row("f", 0, "case when p_size % 5 = 0 then '_' else '' end || replace(p_name, ' ', '_')", "function",
         "case when p_size % 3 = 0 then p_type || ' item.' || chr(10) || chr(10) || 'def not_code(x):' else mdoc end",
         "'(a, b, args, kw): ' || case when p_size % 2 = 0 then 'str' else 'any' end", "p_size % 5 <> 0"),
    _row("f", 1, "'get_' || k", "function", "mdoc", "'(item_id): any'", "true"),
    _row("f", 2, "p_type || k", "class", "mdoc", "null", "true", comp="false"),
    _row("f", 3, "'__init__'", "method", "''", "'(size): any'", "true", "p_type || k", vis="'private'"),
    _row("f", 4, "'_size'", "method", "''", "'(): any'", "true", "p_type || k", vis="'protected'"),
    _row("f", 5, "'inner'", "method", "''", "'(f): any'", "true", "p_type || k", vis="'public'"),
    _row("f", 6, "case when p_size % 3 = 2 then 'POST' else 'GET' end || ' /part/' || k", "route", "mdoc",
         rmethod="case when p_size % 3 = 2 then 'POST' else 'GET' end", rpath="'/part/' || k", handler="'get_' || k"),
]
PY_EXPECTED = " union all ".join(r + f" from {_PY} p" for r in _PY_ROWS)

# --- TypeScript ------------------------------------------------------------------------

_TS = ("(select cast(s_suppkey as varchar) as k, s_suppkey, s_nationkey, s_name, "
       "'/ts/n' || cast(s_nationkey as varchar) || '/s' || cast(s_suppkey as varchar) || '.ts' as f from supplier)")
_TS_ROWS = [
    _row("f", 0, "'load' || k", "function", "s_name", "'(id): string'", "s_suppkey % 2 = 0"),
    _row("f", 1, "'Svc' || k", "class", exported="true", comp="false"),
    _row("f", 2, "'run'", "method", "'Runs it'", "'(a): void'", "true", "'Svc' || k",
         vis="case s_nationkey % 3 when 0 then 'private' when 1 then 'protected' else 'public' end"),
    _row("f", 3, "'list'", "method", "null", "'(): void'", "true", "'Svc' || k", vis="'public'"),
    _row("f", 4, "'count'", "property", "null", "': number'", "true", "'Svc' || k", vis="'private'"),
    _row("f", 5, "'I' || k", "interface", exported="true"),
    _row("f", 6, "'name'", "property", "'Name'", "': string'", "true", "'I' || k"),
    _row("f", 7, "'check'", "method", "null", "'(a): boolean'", "true", "'I' || k"),
    _row("f", 8, "'T' || k", "type", "null", "': string'", "true"),
    _row("f", 9, "'GET /s/' || k", "route", "'GET /s/' || k", rmethod="'GET'", rpath="'/s/' || k",
         handler="'load' || k"),
]
TS_EXPECTED = " union all ".join(r + f" from {_TS} s" for r in _TS_ROWS)

# --- JavaScript ------------------------------------------------------------------------

_JS = ("(select cast(c_custkey as varchar) as k, c_custkey, c_nationkey, c_mktsegment, "
       "case when c_custkey % 10 = 0 then '/web/pages/api/c' else '/web/src/c' end || cast(c_custkey as varchar) || "
       "case when c_custkey % 2 = 0 then '.js' else '.jsx' end as f, "
       "case when c_nationkey % 3 = 0 then 1 else 0 end as r, "
       "case c_nationkey % 4 when 0 then 'GET' when 1 then 'POST' when 3 then 'DELETE' end as verb from customer)")
_JS_ROWS = [
    _row("f", 0, "case when c_custkey % 10 = 0 then 'handler' else 'fn' || k end", "function",
         "c_mktsegment || ' page'", "'(req, res): number'", "true"),
    _row("f", 1, "'View' || k", "function", "null", "'(props)'", "false"),
    _row("f", 2, "'Box' || k", "class", exported="false", comp="c_nationkey % 2 = 0 or c_nationkey % 3 = 0"),
    _row("f", 3, "'_hide'", "method", "null", "'()'", "false", "'Box' || k", vis="'public'"),
]
JS_EXPECTED = " union all ".join(r + f" from {_JS} c" for r in _JS_ROWS) + (
    " union all " + _row("f", 4, "'render'", "method", "null", "'()'", "false", "'Box' || k", vis="'public'")
    + f" from {_JS} c where r = 1"
    + " union all " + _row("f", "4 + r", "'ANY /c' || k", "route", "'API route for /c' || k", rmethod="'ANY'",
                           rpath="'/c' || k", handler="'handler'") + f" from {_JS} c where c_custkey % 10 = 0"
    + " union all " + _row("f", "4 + r + case when c_custkey % 10 = 0 then 1 else 0 end", "verb || ' /c/' || k",
                           "route", "verb || ' /c/' || k", rmethod="verb", rpath="'/c/' || k",
                           handler="'<inline function>'") + f" from {_JS} c where verb is not null"
)


@register("extract_python", with_views(f"select {SYM_COLS} from ({PY_EXPECTED}) t"))
def extract_python(spark, sf):
    return _symbols(spark, sf, "code_py")


@register("extract_typescript", with_views(f"select {SYM_COLS} from ({TS_EXPECTED}) t"))
def extract_typescript(spark, sf):
    return _symbols(spark, sf, "code_ts")


@register("extract_javascript", with_views(f"select {SYM_COLS} from ({JS_EXPECTED}) t"))
def extract_javascript(spark, sf):
    return _symbols(spark, sf, "code_js")


def _kind_key(key: str, expected: str, kinds: tuple[str, ...], view: str):
    kinds_sql = ", ".join(f"'{k}'" for k in kinds)

    @register(key, with_views(f"select {SYM_COLS} from ({expected}) t where type in ({kinds_sql})"))
    def q(spark, sf):
        return _symbols(spark, sf, view).where(F.col("type").isin(*kinds))

    return q


# Per-operator views of the same extraction (each key reads its whole fixture).
_kind_key("extract_py_functions", PY_EXPECTED, ("function",), "code_py")
_kind_key("extract_py_classes", PY_EXPECTED, ("class",), "code_py")
_kind_key("extract_py_methods", PY_EXPECTED, ("method",), "code_py")
_kind_key("extract_py_routes", PY_EXPECTED, ("route",), "code_py")
_kind_key("extract_ts_functions", TS_EXPECTED, ("function",), "code_ts")
_kind_key("extract_ts_classes", TS_EXPECTED, ("class",), "code_ts")
_kind_key("extract_ts_methods", TS_EXPECTED, ("method",), "code_ts")
_kind_key("extract_ts_properties", TS_EXPECTED, ("property",), "code_ts")
_kind_key("extract_ts_interfaces", TS_EXPECTED, ("interface",), "code_ts")
_kind_key("extract_ts_type_aliases", TS_EXPECTED, ("type",), "code_ts")
_kind_key("extract_express_routes", TS_EXPECTED, ("route",), "code_ts")
_kind_key("extract_api_handler_routes", JS_EXPECTED, ("route",), "code_js")


@register("extract_handlers_exported_by_name", with_views(f"select {SYM_COLS} from ({JS_EXPECTED}) t"))
def extract_handlers_exported_by_name(spark, sf):
    # the same files, the handlers exported below their declaration
    files = source_files(spark, sf, "code_js")
    tail = F.when(F.col("path").endswith("0.js"), F.lit("export default handler;\n")).otherwise(F.lit("export { handler };\n"))
    below = F.concat(F.replace("content", F.lit("export function handler("), F.lit("function handler(")), tail)
    return FD.flatten_file_docs(FD.file_docs(files.withColumn("content", F.when(F.col("content").contains("function handler("), below).otherwise(F.col("content")))))


@register("extract_after_regex_literals", with_views(f"select {SYM_COLS} from ({JS_EXPECTED}) t"))
def extract_after_regex_literals(spark, sf):
    # quotes, comment marks and brackets in regex literals, divisions beside them; nothing else changes
    files = source_files(spark, sf, "code_js")
    head = "const quote = /[\"'`/]/g, half = (size + 1) / 2 / n;\nlines.map(l => /^\\s*\\/\\*|['{(]/.test(l) || half / 2);\n"
    return FD.flatten_file_docs(FD.file_docs(files.withColumn("content", F.concat(F.lit(head), F.col("content")))))


_kind_key("flag_components", JS_EXPECTED, ("class",), "code_js")


@register("get_doc_for_file", with_views(
    "select path, 'ts' as language, 1 as n_functions, 1 as n_classes, 1 as n_interfaces, 1 as n_type_aliases, "
    "1 as n_routes, cast(null as varchar) as error from code_ts", "code_ts"))
def get_doc_for_file(spark, sf):
    docs = FD.file_docs(source_files(spark, sf, "code_ts"))
    return docs.select("path", "language", *[F.size(F.col(f"doc.{f}")).alias(f"n_{f}") for f in
                                             ("functions", "classes", "interfaces", "type_aliases", "routes")], "error")


@register("collect_file_doc", with_views(
    "select path, 2 as n_functions, 1 as n_classes, 0 as n_interfaces, 0 as n_type_aliases, 1 as n_routes, "
    "3 as n_methods from code_py", "code_py"))
def collect_file_doc(spark, sf):
    # Python keeps empty arrays (D3), so interfaces / aliases count 0 here
    docs = FD.file_docs(source_files(spark, sf, "code_py"))
    return docs.select("path", *[F.size(F.col(f"doc.{f}")).alias(f"n_{f}") for f in
                                 ("functions", "classes", "interfaces", "type_aliases", "routes")],
                       F.aggregate(F.col("doc.classes"), F.lit(0), lambda a, c: a + F.size(c["methods"])).alias("n_methods"))


@register("classify_language", with_views(
    "select path, case lower(regexp_extract(path, '\\.([^./]+)$', 1)) when 'ts' then 'ts' when 'tsx' then 'ts' "
    "when 'js' then 'js' when 'jsx' then 'js' when 'py' then 'py' end as language from doc_files", "doc_files"))
def classify_language(spark, sf):
    return load_view(spark, sf, "doc_files").select("path", FD.language_of(F.col("path")).alias("language"))


@register("file_error_rows", with_views(
    "select path, 'Unsupported file type' as error, 'No parser available for file type: ' || "
    "lower(regexp_extract(path, '(\\.[^./]*)$', 1)) as details from doc_files "
    "where lower(regexp_extract(path, '\\.([^./]+)$', 1)) not in ('ts', 'tsx', 'js', 'jsx', 'py')", "doc_files"))
def file_error_rows(spark, sf):
    docs = FD.file_docs(source_files(spark, sf, "doc_files"))
    return docs.where(F.col("error").isNotNull()).select("path", "error", "details")


@register("insertion_order", with_views(
    f"select file, seq, symbol, type from ({PY_EXPECTED}) t"))
def insertion_order(spark, sf):
    # ord follows the files in path order; within a file it must follow seq
    from pyspark.sql import Window

    files = FD.in_file_order(load_view(spark, sf, "code_py").select("path", "content"))
    rows = FD.insertion_order(FD.flatten_file_docs(FD.file_docs(files)))
    w = Window.partitionBy("file").orderBy("ord")
    ranked = rows.withColumn("rn", F.row_number().over(w) - 1)
    return ranked.where(F.col("rn") == F.col("seq")).select("file", "seq", "symbol", "type")


# --- the same extraction, one key per SURVEY operator ----------------------------------

from symdex.operators.extract_python import module_docstring  # noqa: E402
from symdex.plans.checks_registry import upsert_symbols as _upsert  # noqa: E402
from symdex.plans.catalog import ORACLES as _ORACLES  # noqa: E402


@register("flatten_file_docs", with_views(f"select {SYM_COLS} from ({TS_EXPECTED}) t"))
def flatten_file_docs(spark, sf):
    return _symbols(spark, sf, "code_ts")


register("upsert_symbol", _ORACLES["upsert_symbols"])(_upsert)


@register("attach_jsdoc", with_views(
    f"select file, seq, symbol, description from ({TS_EXPECTED}) t where description is not null "
    f"union all select file, seq, symbol, description from ({JS_EXPECTED}) j where description is not null"))
def attach_jsdoc(spark, sf):
    ts = _symbols(spark, sf, "code_ts")
    js = _symbols(spark, sf, "code_js")
    return ts.unionByName(js).where(F.col("description").isNotNull()).select("file", "seq", "symbol", "description")


@register("clean_docstring", with_views(
    f"select file, symbol, description from ({PY_EXPECTED}) t where type = 'function'"))
def clean_docstring(spark, sf):
    return _symbols(spark, sf, "code_py").where(F.col("type") == "function").select("file", "symbol", "description")


@register("extract_py_params", with_views(
    f"select file, symbol, type, signature from ({PY_EXPECTED}) t where type in ('function', 'method')"))
def extract_py_params(spark, sf):
    return _symbols(spark, sf, "code_py").where(F.col("type").isin("function", "method")).select(
        "file", "symbol", "type", "signature")


@register("extract_py_return_type", with_views(
    "select '/py/' || replace(p_brand, '#', '') || '/m' || cast(p_partkey as varchar) || '.py' as path, "
    "case when p_size % 5 = 0 then '_' else '' end || replace(p_name, ' ', '_') as name, "
    "case when p_size % 2 = 0 then 'str' else 'any' end as return_type from part union all "
    "select '/py/' || replace(p_brand, '#', '') || '/m' || cast(p_partkey as varchar) || '.py', "
    "'get_' || cast(p_partkey as varchar), 'any' from part"))
def extract_py_return_type(spark, sf):
    docs = FD.file_docs(source_files(spark, sf, "code_py"))
    return docs.select("path", F.posexplode_outer("doc.functions").alias("i", "f")).where(F.col("f").isNotNull()).select(
        "path", F.col("f.name").alias("name"), F.col("f.return_type").alias("return_type"))


@register("py_module_docstring", with_views(
    "select '/py/' || replace(p_brand, '#', '') || '/m' || cast(p_partkey as varchar) || '.py' as path, "
    "p_name || ' module.' as module_doc from part"))
def py_module_docstring(spark, sf):
    return source_files(spark, sf, "code_py").select("path", module_docstring(F.col("content")).alias("module_doc"))


@register("py_description_fallback", with_views(
    f"select file, symbol, type, description from ({PY_EXPECTED}) t where type in ('function', 'class', 'method')"))
def py_description_fallback(spark, sf):
    return _symbols(spark, sf, "code_py").where(F.col("type").isin("function", "class", "method")).select(
        "file", "symbol", "type", "description")


@register("py_visibility", with_views(
    f"select file, symbol, visibility from ({PY_EXPECTED}) t where type = 'method'"))
def py_visibility(spark, sf):
    return _symbols(spark, sf, "code_py").where(F.col("type") == "method").select("file", "symbol", "visibility")
