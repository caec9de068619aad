"""Full answers of all six tools over one project.

``project_*`` is one coherent project: rendered files, the registry before a refresh (some files
stale, some gone, some never seen) and requests that hit symbols, members, usages and files with all their
options.  The SQL refreshes the registry, answers every request and writes the response as JSON, field by field.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from symdex.operators import file_docs as FD
from symdex.operators import registry as G
from symdex.operators import requests as RQ
from symdex.operators.search import flatten
from symdex.plans.catalog import PRIORITY_SQL, register, source_files
from symdex.plans.checks_extract import TS_EXPECTED
from symdex.plans.checks_usages import RE2_SPACE
from symdex.session import ensure_checkpoint_dir
from symdex.sources.fixtures import load_view, with_views
from symdex.sources.store import RegistryStore, refresh_store
from symdex.sources.tables import tracking_from_view

NOW = dt.datetime(2026, 1, 1)
VIEWS = ("project_files", "project_tracking", "project_symbols", "project_requests")
COLS = ("ord, symbol, type, file, description, signature, exported, parent_symbol, is_component, visibility, route_method, route_path, handler")


def project_symbols(spark, sf):
    flat = load_view(spark, sf, "project_symbols")
    return flat.select(
        F.col("ord").cast("long").alias("ord"), "symbol", "type", "file", "description", "signature", "exported", "parent_symbol",
        F.struct("is_component", "visibility", "route_method", "route_path", "handler").alias("metadata"))


def project(spark, sf) -> dict:
    files = load_view(spark, sf, "project_files")
    # the view's parts have one row group each: contents are rendered by many tasks, the listing needs none
    return {
        "symbols": project_symbols(spark, sf), "files": source_files(spark, sf, "project_files"),
        "tracking": tracking_from_view(load_view(spark, sf, "project_tracking")), "listing": files.select("path", "mtime"), "now": NOW,
    }


_REFRESHED: dict[tuple[str, str], tuple] = {}


def refreshed(spark, sf):
    """(store, files, listing, summary) after the refresh that all tools start with; built once a session, its version never changes."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _REFRESHED:
        _REFRESHED[key] = _refreshed(spark, sf)
    return _REFRESHED[key]


def _refreshed(spark, sf):
    p = project(spark, sf)
    files = p["files"].checkpoint()  # the rendered files are read by several tools
    store = RegistryStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/project-{uuid.uuid4().hex}", max_rows=500)
    store.replace_all(p["symbols"], p["tracking"])
    return store, files, p["listing"], refresh_store(store, p["listing"], files, NOW)


def answers(spark, sf):
    store, files, listing, summary = refreshed(spark, sf)
    return RQ.dispatch_requests(load_view(spark, sf, "project_requests"), store.load()[0], files=files, listing=listing, summary=summary)


# --- DuckDB: the registry after the refresh --------------------------------------

_SYM = f"""
stale as (select t.path from project_tracking t join project_files l on t.path = l.path where t."exists" and l.mtime > t.last_parsed),
kept as (select * from project_symbols where file in (select path from project_files) and file not in (select path from stale)),
fresh as (select (select max(ord) from project_symbols where file in (select path from project_files)) + row_number() over (order by '/p' || file, seq) as ord,
  '/p' || file as file, * exclude (file, seq) from ({TS_EXPECTED}) x where '/p' || file in (select path from stale)),
sym as (select {COLS} from kept union all select {COLS} from fresh)"""

# --- DuckDB: fields of the requests -------------------------------------------------


def _field(name: str, kind: str) -> str:
    return f"try_cast(json_extract_string(line, '$.input.{name}') as {kind})"


_REQ = f"""
req as (select request_id, json_extract_string(line, '$.tool') as tool, {_field('query', 'varchar')} as query, {_field('prefix', 'varchar')} as prefix,
  {_field('symbol', 'varchar')} as symbol, {_field('file', 'varchar')} as file, {_field('type', 'varchar')} as type_text, {_field('limit', 'integer')} as lim,
  {_field('maxResults', 'integer')} as max_results, coalesce({_field('exactMatch', 'boolean')}, false) as exact, coalesce({_field('includePrivate', 'boolean')}, false) as priv,
  coalesce({_field('includeDefinition', 'boolean')}, true) as with_def, coalesce({_field('includeRelated', 'boolean')}, true) as with_related,
  coalesce({_field('fullScan', 'boolean')}, false) as full_scan, {_field('baseDir', 'varchar')} as base_dir from project_requests),"""
_TOP = f"""
spec as (select *, case when lower(type_text) in ('function', 'class', 'method', 'property', 'interface', 'type', 'route', 'variable') then lower(type_text) end as kind,
  case tool when 'search_project_symbols' then query when 'autocomplete_symbol' then prefix when 'get_doc_for_symbol' then symbol when 'find_usages' then symbol end as term,
  tool in ('get_doc_for_symbol', 'find_usages') as lookup,
  case when tool = 'autocomplete_symbol' and coalesce(lim, 0) = 0 then 10 when tool in ('get_doc_for_symbol', 'find_usages') then 1 else coalesce(lim, 20) end as k from req),
ranked as (select r.request_id, r.tool, r.k, s.*, row_number() over (partition by r.request_id order by (s.symbol = r.term) desc, coalesce(s.exported, false) desc,
  {PRIORITY_SQL.replace('case type', 'case s.type')}, s.ord) as rank from spec r join sym s on r.term <> '' and (r.kind is null or s.type = r.kind)
  and (r.tool = 'autocomplete_symbol' or coalesce(r.file, '') = '' or contains(s.file, r.file))
  and (r.lookup or r.priv or not (coalesce(s.visibility, '') = 'private' or starts_with(s.symbol, '_') or starts_with(s.symbol, '#')))
  and case when r.lookup or (r.exact and r.tool = 'search_project_symbols') then s.symbol = r.term else contains(lower(s.symbol), lower(r.term)) end),
top as (select * from ranked where k <= 0 or rank <= k)"""


def _json(*fields: tuple[str, str], raw: tuple[str, ...] = ()) -> str:
    """A JSON object of (name, SQL) fields; a null field is left out, ``raw`` ones hold JSON text."""
    parts = ", ".join(f"'\"{n}\":' || " + (f"({x})" if n in raw else f"cast(to_json({x}) as varchar)") for n, x in fields)
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


def _meta(p: str = "") -> str:
    body = _json(("isComponent", f"{p}is_component"), ("visibility", f"{p}visibility"), ("method", f"{p}route_method"), ("path", f"{p}route_path"), ("handler", f"{p}handler"))
    return f"nullif({body}, '{{}}')"


_RECORD = _json(("symbol", "symbol"), ("type", "type"), ("file", "file"), ("description", "description"), ("signature", "signature"), ("exported", "exported"),
                ("parentSymbol", "parent_symbol"), ("metadata", _meta()), raw=("metadata",))
_COMPLETION = _json(("symbol", "symbol"), ("type", "type"), ("signature", "signature"), ("description", "description"), ("filePath", "file"))


def _list(sql: str, order: str) -> str:
    return f"'[' || string_agg({sql}, ',' order by {order}) || ']'"


_SEARCH_JSON = f"""
select r.request_id, '{{"results":' || coalesce(l, '[]') || '}}' as json from req r left join
(select request_id, {_list(_RECORD, 'rank')} as l from top where tool = 'search_project_symbols' group by request_id) t using (request_id) where r.tool = 'search_project_symbols'"""
_COMPLETION_JSON = f"""
select r.request_id, '{{"completions":' || coalesce(l, '[]') || '}}' as json from req r left join
(select request_id, {_list(_COMPLETION, 'rank')} as l from top where tool = 'autocomplete_symbol' group by request_id) t using (request_id) where r.tool = 'autocomplete_symbol'"""

_RELATED_ITEM = _json(("symbol", "symbol"), ("type", "type"), ("relationship", "relationship"), ("description", "description"))
_DOC_JSON = f"""
select r.request_id, case when t.request_id is null then '{{"found":false,"error":"Symbol ''' || r.symbol || ''' not found"}}' else '{{"found":true,"symbol":' ||
{_json(("name", "t.symbol"), ("type", "t.type"), ("file", "t.file"), ("description", "t.description"), ("signature", "t.signature"), ("exported", "t.exported"),
       ("visibility", "t.visibility"), ("metadata", _meta('t.')), ("relatedSymbols", "case when r.with_related then rel.l end"), raw=("metadata", "relatedSymbols"))} || '}}' end as json
from req r left join top t on t.request_id = r.request_id left join
(select request_id, {_list(_RELATED_ITEM, 'g, not_exported, priority, o')} as l from
 (select f.request_id, p.symbol, p.type, 'parent' as relationship, p.description, 0 as g, false as not_exported, 0 as priority, 0 as o from top f join
   (select *, row_number() over (partition by symbol order by coalesce(exported, false) desc, {PRIORITY_SQL}, ord) as rn from sym
    where not (coalesce(visibility, '') = 'private' or starts_with(symbol, '_') or starts_with(symbol, '#'))) p on p.symbol = f.parent_symbol and p.rn = 1
  union all select f.request_id, c.symbol, c.type, 'child', c.description, 1, not coalesce(c.exported, false), {PRIORITY_SQL.replace('case type', 'case c.type')}, c.ord
  from top f join sym c on c.parent_symbol = f.symbol where f.type in ('class', 'interface')) x group by request_id) rel on rel.request_id = r.request_id
where r.tool = 'get_doc_for_symbol'"""

_USAGE_ITEM = _json(("file", "path"), ("line", "line"), ("column", "col"), ("snippet", "snippet"), ("isDefinition", "is_definition"))
_PATS = [f"'\\b' || esc || '{RE2_SPACE}*\\('", f"'\\b' || esc || '{RE2_SPACE}*\\{{'", f"'\\b' || esc || '{RE2_SPACE}*:'", f"'\\bfunction{RE2_SPACE}+' || esc || '\\b'"]
_COL = "case " + " ".join(f"when regexp_matches(text, {p}) then length(string_split_regex(text, {p})[1]) + 1" for p in _PATS) + " end"
_USAGES = f"""
use as (select r.request_id, t.symbol as name, t.type, t.file as def_file, r.with_def, case when coalesce(r.max_results, 0) = 0 then 50 else r.max_results end as m
  from req r join top t on t.request_id = r.request_id where r.tool = 'find_usages'),
esc as (select distinct name, regexp_escape(name) as esc from use),
lines as (select path, case regexp_extract(path, '\\.([^./]+)$', 1) when 'ts' then 1 when 'tsx' then 2 when 'js' then 3 when 'jsx' then 4 else 0 end as pattern_idx,
  unnest(generate_series(1, len(arr))) as line, unnest(arr) as text, arr from (select path, string_split(content, chr(10)) as arr from project_files) f),
hit as (select l.*, e.name, e.esc, array_to_string(arr[greatest(line - 1, 1):least(line + 1, len(arr))], '\\n') as snippet from lines l join esc e on contains(l.text, e.name)),
occ as (select name, path, pattern_idx, line, snippet, cast(1 + list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * length(name) as integer) as col
  from (select *, string_split_regex(text, '\\b' || esc || '\\b') as g from hit where pattern_idx > 0 and regexp_matches(text, '\\b' || esc || '\\b')) h, unnest(range(1, len(g))) as u(k)),
def0 as (select name, path, line, snippet, {_COL} as col from hit where (name, path) in (select (name, def_file) from use)),
def1 as (select * from def0 where col is not null),
defs as (select * from def1 d where line = 1 or line = (select min(line) from def1 e where e.name = d.name and e.path = d.path and e.line > 1)),
found as (select u.request_id, u.m, d.path, d.line, d.col, d.snippet, true as is_definition, 0 as pattern_idx from use u join defs d on u.with_def and d.name = u.name and d.path = u.def_file
  union all select u.request_id, u.m, o.path, o.line, o.col, o.snippet, false, o.pattern_idx from use u join occ o on o.name = u.name and not (u.with_def and o.path = u.def_file)),
listed as (select *, row_number() over (partition by request_id order by is_definition desc, pattern_idx, path, line, col) as rank,
  count(*) filter (where is_definition) over (partition by request_id) as d, count(*) over (partition by request_id) as n from found)"""
_USAGE_JSON = f"""
select r.request_id, {_json(("symbol", "coalesce(u.name, r.symbol)"), ("type", "coalesce(u.type, nullif(r.type_text, ''), 'unknown')"), ("usages", "coalesce(l.l, '[]')"),
  ("totalFound", "coalesce(least(l.n, greatest(l.d, u.m) + 1), 0)"), ("limitReached", "coalesce(l.n > greatest(l.d, u.m), false)"), raw=("usages",))} as json
from req r left join use u using (request_id) left join (select request_id, max(d) as d, max(n) as n, {_list(_USAGE_ITEM, 'rank').replace("order by rank)", "order by rank) filter (where rank <= greatest(d, m))")} as l
  from listed group by request_id) l using (request_id) where r.tool = 'find_usages'"""


def _sym_json(kind: str) -> str:
    """Aggregated JSON lists of a file's own symbols, from the expected rows of the rendered files."""
    base = f"select '/p' || file as path, * from ({TS_EXPECTED}) x"
    params = "case when starts_with(signature, '()') then '[]' else '[\"' || replace(regexp_extract(signature, '^\\((.*)\\)', 1), ', ', '\",\"') || '\"]' end"
    returned = "nullif(regexp_extract(signature, '\\): (.*)$', 1), '')"
    of_type = "nullif(substr(signature, 3), '')"
    method = _json(("name", "symbol"), ("params", params), ("returnType", returned), ("description", "description"), ("visibility", "visibility"), raw=("params",))
    prop = _json(("name", "symbol"), ("type", of_type), ("description", "description"), ("visibility", "visibility"))
    lists = {
        "functions": ("type = 'function'", _json(("name", "symbol"), ("params", params), ("returnType", returned), ("description", "description"), ("exported", "exported"), raw=("params",))),
        "type_aliases": ("type = 'type'", _json(("name", "symbol"), ("type", of_type), ("description", "description"), ("exported", "exported"))),
        "routes": ("type = 'route'", _json(("method", "route_method"), ("path", "route_path"), ("handler", "handler"), ("description", "description"))),
        "methods": ("type = 'method' and starts_with(parent_symbol, {p})", method), "properties": ("type = 'property' and starts_with(parent_symbol, {p})", prop),
    }
    if kind in ("functions", "type_aliases", "routes"):
        where, item = lists[kind]
        return f"select path, {_list(item, 'seq')} as l from ({base}) b where {where} group by path"
    own, prefix = ("class", "'Svc'") if kind == "classes" else ("interface", "'I'")
    m, p = (f"(select path, {_list(item, 'seq')} as l from ({base}) b where {where.format(p=prefix)} group by path)" for where, item in (lists["methods"], lists["properties"]))
    fields = [("name", "b.symbol"), ("description", "b.description"), ("exported", "b.exported"), ("methods", "m.l"), ("properties", "p.l"), ("isComponent", "b.is_component")]
    if kind == "interfaces":
        fields = [*fields[:3], fields[4], fields[3]]
    item = _json(*fields, raw=("methods", "properties"))
    return f"select b.path, {_list(item, 'b.seq')} as l from ({base}) b left join {m} m on m.path = b.path left join {p} p on p.path = b.path where b.type = '{own}' group by b.path"


_FILE_JSON = f"""
select r.request_id, case when coalesce(r.file, '') = '' then '{{"error":"Invalid input","details":"Missing or invalid \\"file\\" field"}}'
  when f.path is null then '{{"error":"File not found","details":"File not found at path: ' || r.file || '"}}' else
  {_json(("filePath", "r.file"), ("functions", "a.l"), ("classes", "b.l"), ("interfaces", "c.l"), ("typeAliases", "d.l"), ("routes", "e.l"),
         raw=("functions", "classes", "interfaces", "typeAliases", "routes"))} end as json
from req r left join project_files f on f.path = r.file left join ({_sym_json('functions')}) a on a.path = r.file left join ({_sym_json('classes')}) b on b.path = r.file
left join ({_sym_json('interfaces')}) c on c.path = r.file left join ({_sym_json('type_aliases')}) d on d.path = r.file left join ({_sym_json('routes')}) e on e.path = r.file
where r.tool = 'get_doc_for_file'"""

# a scan parses all it lists; the rendered files have ten symbols each (TS) or one (JS)
_REFRESH_JSON = f"""
select request_id, {_json(("refreshed", "true"), ("filesProcessed", "n"), ("filesRemoved", "0"), ("symbols", "s"))} as json from (
 select request_id, case when not full_scan then (select count(*) from stale) when base_dir is null then (select count(*) from project_files where regexp_matches(path, '\\.(ts|js)$'))
   else (select count(*) from project_files where regexp_matches(path, '^/p/ts/n1/[^/]*\\.ts$')) + (select count(*) from project_files where regexp_matches(path, '^/p/ts/n1/(.*/)?s[^/]*1\\.ts$')) end as n,
  case when not full_scan then (select count(*) from sym) when base_dir is null then (select count(*) from ({TS_EXPECTED}) x) + (select count(*) from customer)
   else (select count(*) from sym where not starts_with(file, '/p/ts/n1/')) + (select count(*) from ({TS_EXPECTED}) x where starts_with(file, '/ts/n1/')) end as s
 from req where tool = 'refresh_registry') x"""

_ALL = {"search_project_symbols": _SEARCH_JSON, "autocomplete_symbol": _COMPLETION_JSON, "get_doc_for_symbol": _DOC_JSON, "find_usages": _USAGE_JSON,
        "get_doc_for_file": _FILE_JSON, "refresh_registry": _REFRESH_JSON}


def responses_sql(tool: str | None = None) -> str:
    body = " union all ".join(f"select request_id, json from ({sql}) j" for name, sql in _ALL.items() if tool in (None, name))
    return with_views(f"with {_SYM}, {_REQ}{_TOP}, {_USAGES} {body}", *VIEWS)


@register("answer_requests", responses_sql())
def answer_requests(spark, sf):
    return RQ.emit_responses(answers(spark, sf)).select("request_id", "json")


def _tool_key(key: str, tool: str):
    @register(key, responses_sql(tool))
    def q(spark, sf):
        return RQ.emit_responses(answers(spark, sf).where(F.col("tool") == tool)).select("request_id", "json")

    return q


for _key, _tool in (("answer_searches", "search_project_symbols"), ("answer_completions", "autocomplete_symbol"), ("answer_symbol_docs", "get_doc_for_symbol"),
                    ("answer_usages", "find_usages"), ("answer_file_docs", "get_doc_for_file"), ("answer_refreshes", "refresh_registry")):
    _tool_key(_key, _tool)


# --- a refresh that refreshes (C5, G7, G8) -------------------------------------------

_FLAT = "symbol, type, file, description, signature, exported, parent_symbol, visibility"


@register("refresh_project", with_views(f"with {_SYM} select {_FLAT}, row_number() over (order by ord) as place from sym", *VIEWS[:3]))
def refresh_project(spark, sf):
    """Symbols after an incremental refresh with extraction, and the order they stand in."""
    return _placed(refreshed(spark, sf)[0].load()[0])


def _placed(syms):
    """Symbols with their place in insertion order: the rows before a file's first and the place among its own."""
    from pyspark.sql import Window

    flat = flatten(syms)
    files = flat.groupBy("file").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
    before = files.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    rows = flat.withColumn("own", own).join(before.select("file", "before"), "file")
    return rows.select(*_FLAT.split(", "), (F.col("before") + F.col("own")).cast("long").alias("place"))


@register("refresh_project_tracking", with_views(
    f"with {_SYM} select path, case when path in (select path from stale) then timestamp '2026-01-01 00:00:00' else last_parsed end as last_parsed, "
    "case when path in (select path from stale) then timestamp '2024-01-01 00:00:00' else last_modified end as last_modified, "
    "case when path not in (select path from project_files) then false else \"exists\" end as \"exists\" from project_tracking", *VIEWS[:3]))
def refresh_project_tracking(spark, sf):
    return refreshed(spark, sf)[0].load()[1]


@register("refresh_project_tables", with_views(f"with {_SYM} select {_FLAT} from sym", *VIEWS[:3]))
def refresh_project_tables(spark, sf):
    """G8 on plain tables, without a store."""
    p = project(spark, sf)
    return flatten(G.refresh_registry(p["symbols"], p["tracking"], p["listing"], FD.extract_symbols, NOW, files=p["files"])[0]).select(*_FLAT.split(", "))


@register("cleanup_project", with_views(
    "select symbol, type, file from project_symbols where file in (select path from project_files)", *VIEWS[:3]))
def cleanup_project(spark, sf):
    """Tracked files that are gone lose their symbols, and only they."""
    p = project(spark, sf)
    return G.cleanup_deleted(p["symbols"], p["tracking"], p["listing"])[0].select("symbol", "type", "file")


@register("file_doc_errors", with_views(
    "select path, case when path = '' then 'Invalid input' when not exists (select 1 from project_files f where f.path = w.path) then 'File not found' end as error, "
    "case when path = '' then 'Missing or invalid \"file\" field' when not exists (select 1 from project_files f where f.path = w.path) then 'File not found at path: ' || path end as details "
    "from (select distinct file as path from (select json_extract_string(line, '$.input.file') as file from project_requests "
    "where json_extract_string(line, '$.tool') = 'get_doc_for_file') x union select '/p/readme.md') w", "project_files", "project_requests"))
def file_doc_errors(spark, sf):
    """B2: error rows of the files asked for."""
    fields = RQ.request_fields(RQ.parse_requests(load_view(spark, sf, "project_requests")))
    wanted = fields.where(F.col("tool") == "get_doc_for_file").select(F.col("file").alias("path"))
    more = spark.createDataFrame([("/p/readme.md",)], "path string")
    return FD.requested_file_docs(wanted.unionByName(more), project(spark, sf)["files"]).select("path", "error", "details")
