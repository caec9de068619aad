"""Check views derived from the driver's tables (see FIXTURES.md).

The same SQL text runs in Spark and in DuckDB; only the quoting of the
``exists`` column differs (back quotes in Spark, double quotes in DuckDB).
Each view is a pure projection / aggregation of a base table, so its size
grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_VIEWS: dict[str, str] = {
    "doc_files": """
select doc_id, '/corpus/' || source || '/' || cast(doc_id as varchar(20)) ||
       case lang when 'en' then '.ts' when 'fr' then '.JS' when 'de' then '.py' else '.txt' end as path,
       text as content, n_chars as length
from documents""",
    "code_py": """
select p_partkey as id, '/py/' || replace(p_brand, '#', '') || '/m' || cast(p_partkey as varchar(20)) || '.py' as path,
 repeat(chr(34), 3) || p_name || ' module.' || repeat(chr(34), 3) || chr(10) || chr(10) ||
 'def ' || case when p_size % 5 = 0 then '_' else '' end || replace(p_name, ' ', '_') || '(a, b: int = 0, *args,' || chr(10) ||
 '        **kw)' || case when p_size % 2 = 0 then ' -> str' else '' end || ':' || chr(10) ||
 case when p_size % 3 = 0 then '    ' || repeat(chr(34), 3) || p_type || ' item.' || chr(10) || chr(10) ||
   '      def not_code(x):' || chr(10) || '    ' || repeat(chr(34), 3) || chr(10) else '' end ||
 '    return None' || chr(10) || chr(10) ||
 'class ' || p_type || cast(p_partkey as varchar(20)) || ':' || chr(10) ||
 '    def __init__(self, size):' || chr(10) || '        self.size = size' || chr(10) ||
 '    def _size(self):' || chr(10) || '        def inner(f):' || chr(10) || '            return f' || chr(10) ||
 '        return ' || cast(p_size as varchar(20)) || chr(10) || chr(10) ||
 '@app.' || case p_size % 3 when 0 then 'get' when 1 then 'route' else 'post' end ||
 '(' || chr(39) || '/part/' || cast(p_partkey as varchar(20)) || chr(39) || ')' || chr(10) ||
 'def get_' || cast(p_partkey as varchar(20)) || '(item_id):' || chr(10) || '    return None' || chr(10) as content
from part""",
    "code_ts": """
select s_suppkey as id, '/ts/n' || cast(s_nationkey as varchar(20)) || '/s' || cast(s_suppkey as varchar(20)) || '.ts' as path,
 '/** ' || s_name || ' */' || chr(10) ||
 case when s_suppkey % 2 = 0 then 'export ' else '' end || 'function load' || cast(s_suppkey as varchar(20)) ||
 '(id: number): string {' || chr(10) || '  return ' || chr(34) || chr(34) || ';' || chr(10) || '}' || chr(10) ||
 'export interface I' || cast(s_suppkey as varchar(20)) || ' {' || chr(10) || '  /** Name */' || chr(10) || '  name: string;' || chr(10) ||
 '  check(a: number): boolean;' || chr(10) || '}' || chr(10) ||
 'export type T' || cast(s_suppkey as varchar(20)) || ' = string;' || chr(10) ||
 'export class Svc' || cast(s_suppkey as varchar(20)) || ' {' || chr(10) || '  private count: number;' || chr(10) ||
 '  constructor() { this.count = ' || cast(s_nationkey as varchar(20)) || '; }' || chr(10) ||
 '  /** Runs it */' || chr(10) || '  ' || case s_nationkey % 3 when 0 then 'private ' when 1 then 'protected ' else 'public ' end ||
 'run(a: string): void {' || chr(10) || '    load' || cast(s_suppkey as varchar(20)) || '(1);' || chr(10) || '  }' || chr(10) ||
 '  @Get(' || chr(39) || '/n/' || cast(s_nationkey as varchar(20)) || chr(39) || ')' || chr(10) || '  list(): void {}' || chr(10) || '}' || chr(10) ||
 'app.get(' || chr(34) || '/s/' || cast(s_suppkey as varchar(20)) || chr(34) || ', load' || cast(s_suppkey as varchar(20)) || ');' || chr(10) as content
from supplier""",
    "code_js": """
select c_custkey as id, case when c_custkey % 10 = 0 then '/web/pages/api/c' else '/web/src/c' end || cast(c_custkey as varchar(20)) ||
 case when c_custkey % 2 = 0 then '.js' else '.jsx' end as path,
 'import React from ' || chr(39) || 'react' || chr(39) || ';' || chr(10) ||
 '/**' || chr(10) || ' * ' || c_mktsegment || ' page' || chr(10) || ' * @returns {number} balance' || chr(10) || ' */' || chr(10) ||
 'export function ' || case when c_custkey % 10 = 0 then 'handler' else 'fn' || cast(c_custkey as varchar(20)) end || '(req, res) {' || chr(10) ||
 '  return 1; // }' || chr(10) || '}' || chr(10) ||
 'export const arrow' || cast(c_custkey as varchar(20)) || ' = (a, b) => {' || chr(10) || '  return a;' || chr(10) || '};' || chr(10) ||
 'class Box' || cast(c_custkey as varchar(20)) || case when c_nationkey % 2 = 0 then ' extends React.Component' else '' end || ' {' || chr(10) ||
 '  constructor() {' || chr(10) || '    this._n = 0;' || chr(10) || '    this.size = 1;' || chr(10) || '  }' || chr(10) ||
 '  _hide() {}' || chr(10) || case when c_nationkey % 3 = 0 then '  render() {}' || chr(10) else '' end || '}' || chr(10) ||
 'function View' || cast(c_custkey as varchar(20)) || '(props) {' || chr(10) || '  const s = useState(0);' || chr(10) || '  useEffect(go);' || chr(10) ||
 '  useState(1);' || chr(10) || '  View' || cast(c_custkey as varchar(20)) || '.label = PropTypes.string;' || chr(10) || '  return <div/>;' || chr(10) || '}' || chr(10) ||
 'app.' || case c_nationkey % 4 when 0 then 'get' when 1 then 'post' when 2 then 'head' else 'delete' end ||
 '(' || chr(39) || '/c/' || cast(c_custkey as varchar(20)) || chr(39) || ', (req, res) => { res.end(); });' || chr(10) as content
from customer""",
    "code_hidden": """
select s_suppkey as id, case s_suppkey % 4 when 0 then '/ts/__tests__/_t' || cast(s_suppkey as varchar(20)) || '.ts'
  when 1 then '/web/pages/_app' || cast(s_suppkey as varchar(20)) || '.tsx'
  when 2 then '/py/_pkg' || cast(s_suppkey as varchar(20)) || '/__init__.py'
  else '/ts/.cache/h' || cast(s_suppkey as varchar(20)) || '.ts' end as path,
 '/* ' || s_name || ' */' || chr(10) as content
from supplier""",
    "symbols_v": """
select p_partkey as ord,
 case when p_size % 7 = 0 then '_' else '' end || case when p_partkey % 8 = 6 then 'GET /' else '' end || replace(p_name, ' ', '_') as symbol,
 case p_partkey % 8 when 0 then 'function' when 1 then 'class' when 2 then 'method' when 3 then 'property'
   when 4 then 'interface' when 5 then 'type' when 6 then 'route' else 'variable' end as type,
 '/src/' || replace(p_brand, '#', '') || '.ts' as file,
 p_type || ' item' as description,
 case when p_partkey % 8 in (0, 2) then '(a, b): ' || lower(p_type) when p_partkey % 8 in (3, 5) then ': ' || lower(p_type) end as signature,
 case when p_partkey % 8 = 6 then null else p_size % 2 = 0 end as exported,
 case when p_partkey % 8 in (2, 3) then replace(p_name, ' ', '_') end as parent_symbol,
 case when p_partkey % 8 in (2, 3) then case p_size % 3 when 0 then 'private' when 1 then 'protected' else 'public' end end as visibility
from part""",
    "tracking_v": """
select '/src/u' || cast(user_id as varchar(20)) || '.ts' as path,
 max(case when event_type = 'purchase' then ts end) as last_parsed,
 max(case when event_type in ('signup', 'click') and event_id % 2 = 0 then ts end) as last_modified,
 user_id % 7 <> 0 as {Q}exists{Q}
from events where user_id % 10 <> 3 group by user_id""",
    "listing_v": """
select '/src/u' || cast(user_id as varchar(20)) || '.ts' as path, mtime
from (select user_id, max(case when event_type in ('signup', 'click') then ts end) as mtime,
             max(ts) as last_ts, max(case when event_type = 'error' then ts end) as last_error
      from events group by user_id) e
where mtime is not null and (last_error is null or last_error < last_ts)""",
    "requests_v": """
select cast(conv_id as varchar(20)) || '-' || cast(turn as varchar(20)) as request_id,
 case when role = 'system' then '{"tool": broken'
      when (conv_id + turn) % 11 = 0 then '{"tool":7,"input":{}}'
      when (conv_id + turn) % 11 = 1 then '{"tool":"find_usages"}'
      else '{"tool":"' || case (conv_id + turn) % 7 when 0 then 'search_project_symbols' when 1 then 'autocomplete_symbol'
             when 2 then 'get_doc_for_symbol' when 3 then 'find_usages' when 4 then 'refresh_registry'
             when 5 then 'get_doc_for_file' else 'nope' end ||
           '","input":{"' || case (conv_id + turn) % 7 when 0 then 'query' when 1 then 'prefix' when 5 then 'file' else 'symbol' end || '":"' ||
           case conv_id % 6 when 0 then 'rod' when 1 then 'ring' when 2 then 'Widget' when 3 then 'old_rod' when 4 then 'plate' else '' end ||
           '","type":"' || case turn % 4 when 0 then 'Function' when 1 then 'class' when 2 then 'bogus' else 'route' end || '"}}' end as line
from (select distinct conv_id, turn, role from conversations) c""",
    "project_files": """
select '/p' || path as path, content, timestamp '2024-01-01 00:00:00' as mtime from ({code_ts}) t
union all
select '/p' || path, content, timestamp '2024-01-01 00:00:00' from ({code_py}) p
union all
select '/p/web/c' || cast(c_custkey as varchar(20)) || '.js' as path,
 'import { load' || cast(c_custkey % 97 + 1 as varchar(20)) || ' } from ' || chr(39) || '../ts' || chr(39) || ';' || chr(10) ||
 'export function use' || cast(c_custkey as varchar(20)) || '(n) {' || chr(10) ||
 '  return load' || cast(c_custkey % 97 + 1 as varchar(20)) || '(n) + load' || cast(c_custkey % 97 + 1 as varchar(20)) || '(n + 1); // load' ||
 cast(c_custkey % 97 + 1 as varchar(20)) || 'x a$b GET /s/' || cast(c_nationkey as varchar(20)) || chr(10) || '}' || chr(10) ||
 'const svc = new Svc' || cast(c_custkey % 97 + 1 as varchar(20)) || '();' || chr(10) as content,
 timestamp '2024-01-01 00:00:00' as mtime
from customer""",
    "project_tracking": """
select '/p' || path as path, case when id % 3 = 0 then timestamp '2023-01-01 00:00:00' else timestamp '2025-01-01 00:00:00' end as last_parsed,
 timestamp '2023-01-01 00:00:00' as last_modified, id % 11 <> 0 as {Q}exists{Q}
from ({code_ts}) t where id % 4 <> 1
union all
select '/p/web/c' || cast(c_custkey as varchar(20)) || '.js', timestamp '2025-01-01 00:00:00', timestamp '2024-01-01 00:00:00', true from customer
union all
select '/p/ts/gone' || cast(n_nationkey as varchar(20)) || '.ts', timestamp '2025-01-01 00:00:00', timestamp '2023-01-01 00:00:00', true from nation""",
    "project_symbols": """
select s_suppkey * 100 + i as ord,
 case i when 0 then 'load' || k when 1 then 'Svc' || k when 2 then 'run' when 3 then 'count' when 4 then 'I' || k else 'name' end as symbol,
 case i when 0 then 'function' when 1 then 'class' when 2 then 'method' when 4 then 'interface' else 'property' end as type,
 '/p/ts/n' || cast(s_nationkey as varchar(20)) || '/s' || k || '.ts' as file,
 case when i < 3 then 'old ' || s_name end as description,
 case i when 0 then '(id): string' when 2 then '(a): void' when 3 then ': number' when 5 then ': string' end as signature,
 case when i = 0 then s_suppkey % 2 = 0 else true end as exported,
 case i when 2 then 'Svc' || k when 3 then 'Svc' || k when 5 then 'I' || k end as parent_symbol,
 case when i = 1 then false end as is_component,
 case i when 2 then case s_nationkey % 3 when 0 then 'private' when 1 then 'protected' else 'public' end when 3 then 'private' end as visibility,
 cast(null as varchar(10)) as route_method, cast(null as varchar(10)) as route_path, cast(null as varchar(10)) as handler
from (select s_suppkey, s_nationkey, s_name, cast(s_suppkey as varchar(20)) as k from supplier where s_suppkey % 4 <> 1) s
cross join (select 0 as i union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) n
union all
select 1000000000 + c_custkey, 'use' || cast(c_custkey as varchar(20)), 'function', '/p/web/c' || cast(c_custkey as varchar(20)) || '.js',
 c_mktsegment || ' user', '(n)', true, null, cast(null as boolean), null, null, null, null from customer
union all
select 2000000000 + n_nationkey, case when n_nationkey % 2 = 0 then 'load' || cast(n_nationkey as varchar(20)) else 'Gone' || cast(n_nationkey as varchar(20)) end,
 'function', '/p/ts/gone' || cast(n_nationkey as varchar(20)) || '.ts', n_name || ' is gone', '()', true, null, cast(null as boolean), null, null, null, null
from nation""",
    "project_requests": """
select 'r' || cast(s_suppkey as varchar(20)) as request_id,
 case s_suppkey % 23
  when 0 then '{"tool":"search_project_symbols","input":{"query":"load' || cast(s_nationkey % 10 as varchar(20)) || '","limit":3}}'
  when 1 then '{"tool":"search_project_symbols","input":{"query":"svc","type":"Class","file":"/n1"}}'
  when 2 then '{"tool":"search_project_symbols","input":{"query":"A","type":"property","limit":0,"includePrivate":true}}'
  when 3 then '{"tool":"search_project_symbols","input":{"query":"run","exactMatch":true,"limit":-1}}'
  when 4 then '{"tool":"autocomplete_symbol","input":{"prefix":"lo","limit":0}}'
  when 5 then '{"tool":"autocomplete_symbol","input":{"prefix":"count","includePrivate":true,"limit":-1,"type":"bogus"}}'
  when 6 then '{"tool":"get_doc_for_symbol","input":{"symbol":"Svc' || cast(s_suppkey as varchar(20)) || '"}}'
  when 7 then '{"tool":"get_doc_for_symbol","input":{"symbol":"run","file":"/n' || cast(s_nationkey as varchar(20)) || '/"}}'
  when 8 then '{"tool":"get_doc_for_symbol","input":{"symbol":"I' || cast(s_suppkey as varchar(20)) || '","includeRelated":false}}'
  when 9 then '{"tool":"find_usages","input":{"symbol":"load' || cast(s_suppkey % 97 + 1 as varchar(20)) || '"}}'
  when 10 then '{"tool":"find_usages","input":{"symbol":"load' || cast(s_nationkey + 1 as varchar(20)) || '","includeDefinition":false,"maxResults":5}}'
  when 11 then '{"tool":"find_usages","input":{"symbol":"GET /s/' || cast(s_nationkey as varchar(20)) || '","type":"route"}}'
  when 12 then '{"tool":"get_doc_for_file","input":{"file":"/p/ts/n' || cast(s_nationkey as varchar(20)) || '/s' || cast(s_suppkey as varchar(20)) || '.ts"}}'
  when 13 then '{"tool":"get_doc_for_file","input":{"file":"/p/ts/missing' || cast(s_suppkey as varchar(20)) || '.ts"}}'
  when 14 then '{"tool":"refresh_registry","input":{}}'
  when 15 then '{"tool":"refresh_registry","input":{"fullScan":true}}'
  when 16 then '{"tool":"refresh_registry","input":{"fullScan":true,"baseDir":"/p/ts/n1","patterns":["*.ts","**/s*1.ts"]}}'
  when 17 then '{"tool":"find_usages","input":{"symbol":"Svc' || cast(s_nationkey + 1 as varchar(20)) || '","maxResults":1,"type":"class"}}'
  when 18 then '{"tool":"find_usages","input":{"symbol":"nothing' || cast(s_suppkey as varchar(20)) || '"}}'
  when 19 then '{"tool":"get_doc_for_symbol","input":{"symbol":"Gone' || cast(s_nationkey as varchar(20)) || '"}}'
  when 20 then '{"tool":"get_doc_for_file","input":{"file":""}}'
  when 21 then '{"tool":"autocomplete_symbol","input":{"prefix":""}}'
  else '{"tool":"find_usages","input":{"symbol":"count","maxResults":2}}' end as line
from supplier""",
}
for _name, _sql in _VIEWS.items():
    for _other in ("code_ts", "code_py"):
        _VIEWS[_name] = _VIEWS[_name].replace("{" + _other + "}", _VIEWS[_other])

# Which base tables each view reads (used to build DuckDB CTE prefixes).
VIEW_NAMES = tuple(_VIEWS)


def view_sql(name: str, dialect: str = "spark") -> str:
    quote = "`" if dialect == "spark" else '"'
    return _VIEWS[name].replace("{Q}", quote).strip()


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with DuckDB CTEs for the named check views."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({view_sql(n, 'duckdb')})" for n in names)
    body = sql.lstrip()
    if body[:5].lower() == "with ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"


def register_base_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES, prepare=None) -> None:
    for t in names:
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        (rows if prepare is None else prepare(rows)).createOrReplaceTempView(t)


def load_view(spark: SparkSession, sf_dir: str, name: str, prepare=None) -> DataFrame:
    """Build one check view from the parquet tables under ``sf_dir``, each put through ``prepare`` (say, dealt to tasks) if given."""
    needed = {
        "doc_files": ["documents"],
        "code_py": ["part"],
        "code_ts": ["supplier"],
        "code_js": ["customer"],
        "code_hidden": ["supplier"],
        "symbols_v": ["part"],
        "tracking_v": ["events"],
        "listing_v": ["events"],
        "requests_v": ["conversations"],
        "project_files": ["supplier", "customer", "part"],
        "project_tracking": ["supplier", "customer", "nation"],
        "project_symbols": ["supplier", "customer", "nation"],
        "project_requests": ["supplier"],
    }[name]
    register_base_tables(spark, sf_dir, needed, prepare)
    return spark.sql(view_sql(name, "spark"))
