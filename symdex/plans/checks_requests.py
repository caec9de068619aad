"""Request keys on ``requests_v``."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from symdex.operators import registry as G
from symdex.operators import requests as RQ
from symdex.operators.search import rank_within_request
from symdex.operators.usages import usage_scan_batch, with_listing_order
from symdex.plans import checks_answers as CA
from symdex.plans.catalog import PRIORITY_SQL, dealt, private_sql, register, source_files, symbols
from symdex.schemas import FILE_TRACKING
from symdex.session import ensure_checkpoint_dir
from symdex.sources.fixtures import load_view, register_base_tables, with_views
from symdex.sources.store import RegistryStore
from symdex.sources.tables import tracking_from_view

NOW = dt.datetime(2024, 6, 1)

# DuckDB: parsed request fields
_PARSED = (
    "select request_id, jl as line, ok_json, case when ok_json then json_type(jl, '$.tool') end as tool_t, "
    "case when ok_json then json_extract_string(jl, '$.tool') end as tool_s, "
    "case when ok_json then json_type(jl, '$.input') end as input_t from "
    "(select request_id, json_valid(line) as ok_json, case when json_valid(line) then line else '{}' end as jl "
    "from requests_v where trim(line) <> '') r"
)
_FIELDS = (
    "select request_id, case when tool_t = 'VARCHAR' and tool_s <> '' then tool_s end as tool, "
    "case when not ok_json then 'Invalid JSON' when coalesce(tool_t, '') <> 'VARCHAR' or tool_s = '' then 'Invalid request' "
    "when coalesce(input_t, '') not in ('OBJECT', 'ARRAY') then 'Invalid request' end as error, "
    "case when not ok_json then 'Unexpected token in JSON' when coalesce(tool_t, '') <> 'VARCHAR' or tool_s = '' "
    "then 'Missing or invalid \"tool\" field' when coalesce(input_t, '') not in ('OBJECT', 'ARRAY') "
    "then 'Missing or invalid \"input\" field' end as details, "
    + ", ".join(
        f"case when json_type(line, '$.input.{k}') = 'VARCHAR' then json_extract_string(line, '$.input.{k}') end as {k}"
        for k in ("query", "prefix", "symbol", "file", "type"))
    + f" from ({_PARSED}) p"
)
_KIND = ("case when lower(f.type) in ('function', 'class', 'method', 'property', 'interface', 'type', 'route', "
         "'variable') then lower(f.type) end")


def _ranked_sql(term: str, k: int, exact: bool) -> str:
    match = "s.symbol = f.term" if exact else "contains(lower(s.symbol), lower(f.term))"
    priv = "" if exact else f" and not {private_sql().replace('visibility', 's.visibility').replace('symbol', 's.symbol')}"
    return (
        f"select f.request_id, s.symbol, row_number() over (partition by f.request_id order by "
        f"coalesce(s.symbol = f.term, false) desc, coalesce(s.exported, false) desc, "
        f"{PRIORITY_SQL.replace('case type', 'case s.type')}, s.ord) as rank "
        f"from (select *, {term} as term, {_KIND} as kind from fields f) f join symbols_v s on {match} "
        f"and (f.kind is null or s.type = f.kind){priv} where f.term is not null and f.term <> ''"
    )


def _answer_sql(tool: str, term: str, k: int, exact: bool) -> str:
    return (
        f"select f.request_id, f.tool, cast(null as varchar) as error, cast(null as varchar) as details, "
        f"cast(coalesce(r.n, 0) as integer) as result_count, r.first_symbol from fields f left join "
        f"(select request_id, count(*) filter (where rank <= {k}) as n, min(symbol) filter (where rank = 1) as first_symbol "
        f"from ({_ranked_sql(term, k, exact)}) x group by request_id) r on f.request_id = r.request_id "
        f"where f.error is null and f.tool = '{tool}'"
    )


_STALE = ("(select count(*) from tracking_v t join listing_v l on t.path = l.path "
          "where t.\"exists\" and l.mtime > t.last_parsed)")

DISPATCH_SQL = with_views(
    f"with fields as ({_FIELDS}) "
    "select request_id, tool, error, details, 0 as result_count, cast(null as varchar) as first_symbol "
    "from fields where error is not null "
    "union all select request_id, tool, 'Unknown tool', 'Tool \"' || tool || '\" not supported', 0, null from fields "
    "where error is null and tool not in ('get_doc_for_file', 'search_project_symbols', 'autocomplete_symbol', "
    "'get_doc_for_symbol', 'find_usages', 'refresh_registry') "
    f"union all {_answer_sql('search_project_symbols', 'query', 20, False)} "
    f"union all {_answer_sql('autocomplete_symbol', 'prefix', 10, False)} "
    "union all select request_id, tool, case when coalesce(symbol, '') = '' then 'Missing or invalid symbol name' "
    "when result_count = 0 then 'Symbol ''' || symbol || ''' not found' end, null, result_count, first_symbol from "
    f"({_answer_sql('get_doc_for_symbol', 'symbol', 1, True).replace('select f.request_id, f.tool,', 'select f.request_id, f.tool, f.symbol,')}) d "
    "union all select u.request_id, u.tool, null, null, cast(least(coalesce(n.n, 0), 51) as integer), null from "
    f"({_answer_sql('find_usages', 'symbol', 1, True)}) u left join (select name, sum(len(string_split_regex(text, '\\b' || name || '\\b')) - 1) as n from "
    "(select distinct symbol as name from symbols_v where symbol in (select symbol from fields)) s join "
    "(select unnest(string_split(content, chr(10))) as text from doc_files where regexp_matches(path, '\\.(ts|tsx|js|jsx)$')) l on regexp_matches(l.text, '\\b' || s.name || '\\b') "
    "group by name) n on n.name = u.first_symbol "
    f"union all select request_id, tool, null, null, cast({_STALE} as integer), null from fields "
    "where error is null and tool = 'refresh_registry' "
    "union all select f.request_id, f.tool, case when coalesce(f.file, '') = '' then 'Invalid input' "
    "when d.path is null then 'File not found' end, case when coalesce(f.file, '') = '' then "
    "'Missing or invalid \"file\" field' when d.path is null then 'File not found at path: ' || f.file end, 0, null "
    "from fields f left join doc_files d on d.path = f.file where f.error is null and f.tool = 'get_doc_for_file'",
    "requests_v", "symbols_v", "tracking_v", "listing_v", "doc_files",
)


def dispatch_inputs(spark, sf):
    """(symbols, files, listing, summary) of the check views; the tracked files hold no symbols and have no content, so a refresh only counts them."""
    syms, listing = symbols(spark, sf), load_view(spark, sf, "listing_v")
    summary = G.refresh_registry(syms, tracking_from_view(load_view(spark, sf, "tracking_v")), listing, None, NOW)[2]
    return syms, load_view(spark, sf, "doc_files").select("path", "content"), listing, summary


@register("dispatch_requests", DISPATCH_SQL)
def dispatch_requests(spark, sf):
    syms, files, listing, summary = dispatch_inputs(spark, sf)
    return RQ.summarised(RQ.dispatch_requests(load_view(spark, sf, "requests_v"), syms, files=files, listing=listing, summary=summary))


@register("parse_requests", with_views(
    f"select request_id, tool, error, details from ({_FIELDS}) f", "requests_v"))
def parse_requests(spark, sf):
    return RQ.parse_requests(load_view(spark, sf, "requests_v")).select("request_id", "tool", "error", "details")


@register("parse_symbol_type", with_views(
    f"select request_id, type as type_text, {_KIND} as kind from ({_FIELDS}) f where error is null", "requests_v"))
def parse_symbol_type(spark, sf):
    parsed = RQ.parse_requests(load_view(spark, sf, "requests_v"))
    fields = RQ.request_fields(parsed.where(F.col("error").isNull()))
    from symdex.functions.columns import parse_symbol_type_col

    return fields.select("request_id", F.col("type").alias("type_text"), parse_symbol_type_col(F.col("type")).alias("kind"))


@register("reject_empty_input", with_views(
    f"with fields as ({_FIELDS}) select request_id, tool from fields where error is null and "
    "tool in ('search_project_symbols', 'autocomplete_symbol', 'get_doc_for_symbol', 'find_usages') and "
    "coalesce(case tool when 'search_project_symbols' then query when 'autocomplete_symbol' then prefix else symbol end, '') = ''",
    "requests_v"))
def reject_empty_input(spark, sf):
    f = RQ.request_fields(RQ.parse_requests(load_view(spark, sf, "requests_v")))
    term = (F.when(F.col("tool") == "search_project_symbols", F.col("query"))
            .when(F.col("tool") == "autocomplete_symbol", F.col("prefix")).otherwise(F.col("symbol")))
    return f.where(F.col("error").isNull() & F.col("tool").isin(
        "search_project_symbols", "autocomplete_symbol", "get_doc_for_symbol", "find_usages")
        & (F.coalesce(term, F.lit("")) == "")).select("request_id", "tool")


# the full answers of checks_answers over the requests, symbols and files of these views; no request here names a file there is
_NO_NAME = "coalesce(r.symbol, '') = ''"
_RESPONSES = f"""
with fields as ({_FIELDS}), project_files as (select path, content from doc_files),
sym as (select ord, symbol, type, file, description, signature, exported, parent_symbol, cast(null as boolean) as is_component, visibility,
  cast(null as varchar) as route_method, cast(null as varchar) as route_path, cast(null as varchar) as handler from symbols_v),
req as (select request_id, tool, query, prefix, symbol, file, type as type_text, cast(null as integer) as lim, cast(null as integer) as max_results, false as exact, false as priv,
  true as with_def, true as with_related from fields where error is null),{CA._TOP}, {CA._USAGES}
select request_id, cast(json_object('error', error, 'details', details, 'resultCount', 0) as varchar) as json from fields where error is not null
union all select request_id, cast(json_object('error', 'Unknown tool', 'details', 'Tool "' || tool || '" not supported', 'resultCount', 0) as varchar) from req
where tool not in ('get_doc_for_file', 'search_project_symbols', 'autocomplete_symbol', 'get_doc_for_symbol', 'find_usages', 'refresh_registry')
union all select request_id, json from ({CA._SEARCH_JSON}) s union all select request_id, json from ({CA._COMPLETION_JSON}) c
union all select r.request_id, case when {_NO_NAME} then '{{"found":false,"error":"Missing or invalid symbol name"}}' else d.json end from ({CA._DOC_JSON}) d join req r using (request_id)
union all select request_id, json from ({CA._USAGE_JSON.replace("least(l.n,", "least(coalesce(l.n, 0),")}) u where request_id not in (select request_id from req r where {_NO_NAME})
union all select request_id, '{{"symbol":"","type":"","usages":[],"totalFound":0,"limitReached":false}}' from req r where tool = 'find_usages' and {_NO_NAME}
union all select r.request_id, cast(case when coalesce(r.file, '') = '' then json_object('error', 'Invalid input', 'details', 'Missing or invalid "file" field', 'resultCount', 0)
  when d.path is null then json_object('error', 'File not found', 'details', 'File not found at path: ' || r.file, 'resultCount', 0) end as varchar)
  from req r left join doc_files d on d.path = r.file where r.tool = 'get_doc_for_file'
union all select request_id, '{{"refreshed":true,"filesProcessed":' || {_STALE} || ',"filesRemoved":0,"symbols":' || (select count(*) from symbols_v where file not in
  (select path from tracking_v where path not in (select path from listing_v))) || '}}' from req where tool = 'refresh_registry'"""


@register("emit_responses", with_views(_RESPONSES.strip(), "requests_v", "symbols_v", "tracking_v", "listing_v", "doc_files"))
def emit_responses(spark, sf):
    """The response line of every request, the answered ones too."""
    syms, files, listing, summary = dispatch_inputs(spark, sf)
    answers = RQ.dispatch_requests(load_view(spark, sf, "requests_v"), syms, files=files, listing=listing, summary=summary)
    return RQ.emit_responses(answers, counts=True).select("request_id", "json")


_RANKED = with_views(
    f"with fields as ({_FIELDS}) select request_id, symbol, cast(rank as integer) as rank from "
    f"({_ranked_sql('query', 20, False)}) r where rank <= 20", "requests_v", "symbols_v")


def _searches(spark, sf):
    f = RQ.request_fields(RQ.parse_requests(load_view(spark, sf, "requests_v")))
    return f.where(F.col("error").isNull() & (F.col("tool") == "search_project_symbols")).select(
        "request_id", F.col("query").alias("term"), "type", F.lit(None).cast("string").alias("file"),
        F.lit(False).alias("exact_match"), F.lit(False).alias("include_private"), F.lit(20).alias("limit"))


@register("rank_within_request", _RANKED)
def rank_within_request_q(spark, sf):
    ensure_checkpoint_dir(spark)
    # the names of one row group are spelled out in grams by many tasks
    return rank_within_request(_searches(spark, sf).checkpoint(), symbols(spark, sf, dealt)).select("request_id", "symbol", "rank")


@register("rank_by_stored_index", _RANKED)
def rank_by_stored_index_q(spark, sf):
    """E4 by the index that two commits left: the files of one half, then those of the other."""
    store = RegistryStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/indexed-{uuid.uuid4().hex}", max_rows=20_000, index=True)
    every, none = symbols(spark, sf), spark.createDataFrame([], FILE_TRACKING)
    late = F.pmod(F.crc32("file"), F.lit(2)) == 1
    store.replace_all(every.where(~late), none)
    store.commit(every.where(late).select(F.col("file").alias("path")).distinct().checkpoint(), every.where(late), none)
    syms, grams, counts = store.search_index()
    return rank_within_request(_searches(spark, sf), syms, grams=grams, counts=counts).select("request_id", "symbol", "rank")


_NAMES_SQL = (
    "select 'load' || cast(s_suppkey as varchar) as name from supplier union select 'Svc' || cast(s_suppkey as varchar) from supplier "
    "union select 'GET /s/' || cast(s_suppkey as varchar) from supplier union select 'POST /s/' || cast(s_suppkey as varchar) from supplier "
    "union select 'a$b' union select '$' union select '+' union select 'n + 1' union select 'nowhere'")


@register("usage_scan_batch", with_views(
    f"with n as (select name, regexp_escape(name) as esc, regexp_matches(name, '^\\w') as w1, regexp_matches(name, '\\w$') as w2 from ({_NAMES_SQL}) q), "
    "f as (select path, content, 1 as pattern_idx from project_files where ends_with(path, '.ts') union all select path, content, 3 from project_files where ends_with(path, '.js') "
    "union all select path, content, 1 from project_files where ends_with(path, '5.ts')), "
    "l as (select path, pattern_idx, arr, unnest(generate_series(1, len(arr))) as line, unnest(arr) as text from (select *, string_split(content, chr(10)) as arr from f) x), "
    "h as (select n.name, l.*, string_split_regex(l.text, '\\b' || esc || '\\b') as g from l join n on contains(l.text, n.name) and regexp_matches(l.text, '\\b' || esc || '\\b')) "
    "select name, path, pattern_idx, line, cast(1 + list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * length(name) as integer) as \"column\", "
    "array_to_string(arr[greatest(line - 1, 1):least(line + 1, len(arr))], '\\n') as snippet from h, unnest(range(1, len(g))) as t(k)",
    "project_files"))
def usage_scan_batch_q(spark, sf):
    """Words, routes of one verb, names with signs, and files that are listed twice."""
    docs = source_files(spark, sf, "project_files")
    files = with_listing_order(docs.unionByName(docs.where(F.col("path").endswith("5.ts"))))
    register_base_tables(spark, sf, ["supplier"])
    names = spark.sql(_NAMES_SQL.replace("as varchar)", "as string)"))
    return usage_scan_batch(files.where(F.col("pattern_idx") > 0), names)
