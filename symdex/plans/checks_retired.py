"""Retired-surface keys (Y4-Y13) on ``code_js`` / ``code_ts``; expectations follow from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from symdex.operators import retired as Y
from symdex.plans.catalog import register, source_files
from symdex.sources.fixtures import with_views

_JS = ("(select cast(c_custkey as varchar) as k, c_custkey, c_nationkey, c_mktsegment, "
       "case when c_custkey % 10 = 0 then '/web/pages/api/c' else '/web/src/c' end || cast(c_custkey as varchar) || "
       "case when c_custkey % 2 = 0 then '.js' else '.jsx' end as f from customer) c")
_TS = ("(select cast(s_suppkey as varchar) as k, s_nationkey, "
       "'/ts/n' || cast(s_nationkey as varchar) || '/s' || cast(s_suppkey as varchar) || '.ts' as f from supplier) s")


def _js(spark, sf):
    return source_files(spark, sf, "code_js")


def _ts(spark, sf):
    return source_files(spark, sf, "code_ts")


@register("extract_function_variables", with_views(
    f"select f as file, 'arrow' || k as name, 'a, b' as params, true as exported, cast(null as varchar) as description from {_JS}"))
def extract_function_variables(spark, sf):
    return Y.function_variables(_js(spark, sf)).drop("pos")


@register("extract_decorator_routes", with_views(
    f"select f as file, 'Svc' || k as class_name, 'GET' as method, '/n/' || cast(s_nationkey as varchar) as route_path, "
    f"'list' as handler, 'GET /n/' || cast(s_nationkey as varchar) as description from {_TS}"))
def extract_decorator_routes(spark, sf):
    return Y.decorator_routes(_ts(spark, sf)).drop("pos")


@register("extract_express_routes_wide", with_views(
    "select f as file, case c_nationkey % 4 when 0 then 'GET' when 1 then 'POST' when 2 then 'HEAD' else 'DELETE' end "
    f"as method, '/c/' || k as route_path, '<inline function>' as handler from {_JS}"))
def extract_express_routes_wide(spark, sf):
    return Y.express_routes_wide(_js(spark, sf)).drop("pos")


@register("jsdoc_return_type", with_views(
    f"select f as file, case when c_custkey % 10 = 0 then 'handler' else 'fn' || k end as name, 'number' as return_type "
    f"from {_JS} union all select f, 'View' || k, cast(null as varchar) from {_JS}"))
def jsdoc_return_type(spark, sf):
    return Y.jsdoc_return_types(_js(spark, sf))


@register("js_name_visibility", with_views(
    f"select f as file, 'Box' || k as class_name, '_hide' as method, 'private' as visibility from {_JS} "
    f"union all select f, 'Box' || k, 'render', 'public' from {_JS} where c_nationkey % 3 = 0"))
def js_name_visibility(spark, sf):
    return Y.js_method_visibility(_js(spark, sf))


@register("js_constructor_properties", with_views(
    f"select f as file, 'Box' || k as class_name, 0 as pos, '_n' as prop, 'private' as visibility from {_JS} "
    f"union all select f, 'Box' || k, 1, 'size', 'public' from {_JS}"))
def js_constructor_properties(spark, sf):
    return Y.constructor_properties(_js(spark, sf))


@register("extract_components", with_views(
    f"select f as file, 'View' || k as name, 'function' as kind, cast(null as varchar) as description, "
    f"'useState,useEffect' as hooks, 'label:string' as props from {_JS} "
    f"union all select f, 'Box' || k, 'class', null, '', '' from {_JS} where c_nationkey % 2 = 0 or c_nationkey % 3 = 0"))
def extract_components(spark, sf):
    c = Y.components(_js(spark, sf))
    return c.select("file", "name", "kind", "description", F.array_join("hooks", ",").alias("hooks"),
                    F.array_join(F.transform("props", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",").alias("props"))


@register("extract_hooks", with_views(
    f"select f as file, 'View' || k as name, 0 as hook_pos, 'useState' as hook from {_JS} "
    f"union all select f, 'View' || k, 1, 'useEffect' from {_JS}"))
def extract_hooks(spark, sf):
    return Y.hooks(_js(spark, sf))


@register("extract_prop_types", with_views(
    f"select f as file, 'View' || k as name, 0 as prop_pos, 'label' as prop, 'string' as prop_type from {_JS}"))
def extract_prop_types(spark, sf):
    return Y.prop_types(_js(spark, sf))


@register("extract_default_handler_routes", with_views(
    "select f as file, 'ANY' as method, '/c' || k as route_path, 'handler' as handler, 'API route for /c' || k as "
    f"description from {_JS} where c_custkey % 10 = 0"))
def extract_default_handler_routes(spark, sf):
    # the rendered handlers are named exports; here half are default exports, half are exported below by name
    here = F.replace("content", F.lit("export function handler("), F.lit("export default function handler("))
    below = F.concat(F.replace("content", F.lit("export function handler("), F.lit("function handler(")), F.lit("export default handler;\n"))
    return Y.default_handler_routes(_js(spark, sf).withColumn("content", F.when(F.col("path").endswith("0.js") & F.col("path").contains("5"), here).otherwise(below)))


# --- Y1-Y3 on code_ts ---------------------------------------------------------------

from symdex.operators import declarations as DCL  # noqa: E402

_TS_LINES = ("(select path, unnest(generate_series(1, len(arr))) as line, unnest(arr) as text, arr from "
             "(select path, string_split(content, chr(10)) as arr from code_ts) f) l")
_RUN_DECL = ("select path as file, line, 3 as \"column\", 'method' as kind, "
             "substring(text, 3) || chr(10) || arr[line + 1] || chr(10) || arr[line + 2] as snippet "
             f"from {_TS_LINES} where regexp_matches(text, '^  (private|protected|public) run\\(')")
_RUN_REFS = ("select path as file, line, cast(strpos(text, ' run(') + 1 as integer) as \"column\", 'reference' as kind, "
             f"trim(text) as snippet from {_TS_LINES} where regexp_matches(text, '\\brun\\b')")


@register("find_declarations", with_views(
    "select path as file, line, 3 as \"column\", 'property' as kind, 'private count: number;' as snippet "
    f"from {_TS_LINES} where text = '  private count: number;'", "code_ts"))
def find_declarations(spark, sf):
    return DCL.find_declarations(_ts(spark, sf), "count")


@register("find_references", with_views(
    "select path as file, line, cast(strpos(text, 'count') as integer) as \"column\", 'reference' as kind, "
    f"trim(text) as snippet from {_TS_LINES} where regexp_matches(text, '\\bcount\\b')", "code_ts"))
def find_references(spark, sf):
    files = _ts(spark, sf)
    return DCL.find_references(files, "count", DCL.find_declarations(files, "count"))


@register("search_for_symbol", with_views(f"{_RUN_DECL} union all {_RUN_REFS}", "code_ts"))
def search_for_symbol(spark, sf):
    decls, refs = DCL.search_for_symbol(_ts(spark, sf), "run")
    return decls.unionByName(refs)
