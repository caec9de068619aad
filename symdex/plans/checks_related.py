"""Symbol documentation keys on ``symbols_v``."""

from __future__ import annotations

from symdex.operators import related as R
from symdex.plans.catalog import PRIORITY_SQL, private_sql, rank_order_sql, register, symbols
from symdex.schemas import CHILD_SCAN_LIMIT
from symdex.sources.fixtures import with_views

_BEST_PARENT = (
    "select symbol as parent_name, ord as parent_ord, type as parent_type, file as parent_file, "
    "description as parent_description, row_number() over (partition by symbol order by "
    f"coalesce(exported, false) desc, {PRIORITY_SQL}, ord) as rn from symbols_v where not {private_sql()}"
)


@register("symbol_parent", with_views(
    f"select k.ord, k.symbol, k.type, k.parent_symbol, p.parent_ord, p.parent_type, p.parent_file, p.parent_description "
    f"from symbols_v k left join ({_BEST_PARENT}) p on k.parent_symbol = p.parent_name and p.rn = 1 "
    "where k.parent_symbol is not null", "symbols_v"))
def symbol_parent(spark, sf):
    return R.symbol_parent(symbols(spark, sf))


@register("symbol_children", with_views(
    "select parent_symbol as owner_name, ord as child_ord, symbol as child_symbol, type as child_type, "
    "description as child_description, coalesce(exported, false) as child_exported, "
    f"{PRIORITY_SQL} as child_priority from symbols_v where parent_symbol is not null and parent_symbol in "
    "(select symbol from symbols_v where type in ('class', 'interface'))", "symbols_v"))
def symbol_children(spark, sf):
    return R.symbol_children(symbols(spark, sf))


def _found_sql(name: str, kind: str) -> str:
    return (f"select * from symbols_v where symbol = '{name}' and type = '{kind}' "
            f"order by {rank_order_sql(repr(name))} limit 1")


def _related_sql(name: str, kind: str, scan_limit: int | None = None) -> str:
    pool = "symbols_v" if scan_limit is None else (
        f"(select * from symbols_v order by {rank_order_sql(chr(39) * 2)} limit {scan_limit})")
    return (
        f"with f as ({_found_sql(name, kind)}) "
        "select f.ord, 'parent' as relationship, p.parent_name as symbol, p.parent_type as type, "
        "p.parent_description as description, 0 as rel_group, false as rel_not_exported, 0 as rel_priority, "
        f"p.parent_ord as rel_ord from f join ({_BEST_PARENT}) p on f.parent_symbol = p.parent_name and p.rn = 1 "
        "union all "
        "select f.ord, 'child', c.symbol, c.type, c.description, 1, not coalesce(c.exported, false), "
        f"{PRIORITY_SQL.replace('case type', 'case c.type')}, c.ord from f join {pool} c on c.parent_symbol = f.symbol "
        "where f.type in ('class', 'interface')"
    )


@register("related_symbols", with_views(_related_sql("red_widget", "class"), "symbols_v"))
def related_symbols(spark, sf):
    syms = symbols(spark, sf)
    return R.get_doc_for_symbol(syms, "red_widget", "class")[1]


@register("related_symbols_parent", with_views(_related_sql("blue_bolt", "method"), "symbols_v"))
def related_symbols_parent(spark, sf):
    syms = symbols(spark, sf)
    return R.get_doc_for_symbol(syms, "blue_bolt", "method")[1]


@register("related_symbols_scan50", with_views(_related_sql("red_widget", "class", CHILD_SCAN_LIMIT), "symbols_v"))
def related_symbols_scan50(spark, sf):
    # parity mode (Q3): members are looked for among the 50 best symbols of the project only
    syms = symbols(spark, sf)
    return R.get_doc_for_symbol(syms, "red_widget", "class", child_scan_limit=CHILD_SCAN_LIMIT)[1]


def _doc_sql(name: str, kind: str) -> str:
    return with_views(
        f"with f as ({_found_sql(name, kind)}), r as ({_related_sql(name, kind)}) "
        "select true as found, symbol as name, type, file, description, signature, exported, visibility, "
        "(select case when count(*) = 0 then null else cast(count(*) as integer) end from r) as related_count, "
        "cast(null as varchar) as error from f",
        "symbols_v",
    )


@register("get_doc_for_symbol", _doc_sql("red_widget", "class"))
def get_doc_for_symbol(spark, sf):
    return R.get_doc_for_symbol(symbols(spark, sf), "red_widget", "CLASS")[0]


@register("project_symbol_doc", _doc_sql("blue_bolt", "method"))
def project_symbol_doc(spark, sf):
    return R.get_doc_for_symbol(symbols(spark, sf), "blue_bolt", "method")[0]


@register("get_doc_for_symbol_missing", with_views(
    "select false as found, cast(null as varchar) as name, cast(null as varchar) as type, cast(null as varchar) as file, "
    "cast(null as varchar) as description, cast(null as varchar) as signature, cast(null as boolean) as exported, "
    "cast(null as varchar) as visibility, cast(null as integer) as related_count, "
    "'Symbol ''sum'' not found' as error from (select count(*) from symbols_v) t", "symbols_v"))
def get_doc_for_symbol_missing(spark, sf):
    return R.get_doc_for_symbol(symbols(spark, sf), "sum", "function")[0]
