"""Registry-maintenance keys on ``tracking_v``, ``listing_v`` and ``symbols_v``."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from symdex.operators import registry as G
from symdex.operators.search import flatten
from symdex.plans.catalog import SYMBOL_COLS, register, symbols
from symdex.session import ensure_checkpoint_dir
from symdex.sources import tables as TB
from symdex.sources.fixtures import load_view, with_views

NOW = dt.datetime(2024, 6, 1, 0, 0, 0)
NOW_SQL = "timestamp '2024-06-01 00:00:00'"
TRACK_COLS = 'path, last_parsed, last_modified, "exists"'


def _tracking(spark, sf):
    return TB.tracking_from_view(load_view(spark, sf, "tracking_v"))


def _listing(spark, sf):
    return load_view(spark, sf, "listing_v")


def _tl(sql: str) -> str:
    return with_views(sql, "tracking_v", "listing_v")


@register("deleted_files", _tl(f"select {TRACK_COLS} from tracking_v where path not in (select path from listing_v)"))
def deleted_files(spark, sf):
    return G.deleted_files(_tracking(spark, sf), _listing(spark, sf))


@register("drop_deleted_symbols", with_views(
    f"select {SYMBOL_COLS} from symbols_v where file not in "
    "(select path from tracking_v where path not in (select path from listing_v))",
    "symbols_v", "tracking_v", "listing_v"))
def drop_deleted_symbols(spark, sf):
    gone = G.deleted_files(_tracking(spark, sf), _listing(spark, sf))
    return flatten(G.drop_deleted_symbols(symbols(spark, sf), gone))


@register("stale_files", _tl(
    "select t.path, l.mtime, t.last_parsed from tracking_v t join listing_v l on t.path = l.path "
    "where t.\"exists\" and l.mtime > t.last_parsed"))
def stale_files(spark, sf):
    return G.stale_files(_tracking(spark, sf), _listing(spark, sf))


@register("file_needs_refresh", _tl(
    "select coalesce(l.path, t.path) as path, case when l.mtime is null then false when t.path is null then true "
    "else coalesce(l.mtime > t.last_parsed, false) end as needs_refresh "
    "from listing_v l full join tracking_v t on l.path = t.path"))
def file_needs_refresh(spark, sf):
    # a tracked row with no parse time compares as null -> not stale
    return G.file_needs_refresh(_tracking(spark, sf), _listing(spark, sf)).select(
        "path", F.coalesce(F.col("needs_refresh"), F.lit(False)).alias("needs_refresh"))


@register("untracked_files", _tl("select path, mtime from listing_v where path not in (select path from tracking_v)"))
def untracked_files(spark, sf):
    return G.untracked_files(_tracking(spark, sf), _listing(spark, sf))


@register("track_files", _tl(
    f"select coalesce(t.path, l.path) as path, case when l.path is not null then {NOW_SQL} else t.last_parsed end as last_parsed, "
    f"case when l.path is not null then coalesce(l.mtime, {NOW_SQL}) else t.last_modified end as last_modified, "
    "case when l.path is not null then true else t.\"exists\" end as \"exists\" "
    "from tracking_v t full join listing_v l on t.path = l.path"))
def track_files(spark, sf):
    return G.track_files(_tracking(spark, sf), _listing(spark, sf), NOW)


@register("cleanup_deleted", _tl(
    "select path, last_parsed, last_modified, case when path in (select path from listing_v) then \"exists\" "
    "else false end as \"exists\" from tracking_v"))
def cleanup_deleted(spark, sf):
    return G.cleanup_deleted(symbols(spark, sf), _tracking(spark, sf), _listing(spark, sf))[1]


def _stale_sql() -> str:
    return ("(select t.path from tracking_v t join listing_v l on t.path = l.path "
            "where t.\"exists\" and l.mtime > t.last_parsed)")


@register("refresh_summary", with_views(
    f"select true as refreshed, cast((select count(*) from {_stale_sql()} s) as integer) as files_processed, "
    "0 as files_removed, cast((select count(*) from symbols_v where file not in "
    "(select path from tracking_v where path not in (select path from listing_v))) as integer) as symbols",
    "symbols_v", "tracking_v", "listing_v"))
def refresh_summary(spark, sf):
    return G.refresh_registry(symbols(spark, sf), _tracking(spark, sf), _listing(spark, sf), None, NOW)[2]


@register("refresh_registry", with_views(
    "select true as refreshed, cast((select count(*) from listing_v) as integer) as files_processed, "
    "0 as files_removed, cast((select count(*) from symbols_v where file not in "
    "(select path from tracking_v where path not in (select path from listing_v))) as integer) as symbols",
    "symbols_v", "tracking_v", "listing_v"))
def refresh_registry(spark, sf):
    return G.refresh_registry(symbols(spark, sf), _tracking(spark, sf), _listing(spark, sf), None, NOW,
                              full_scan=True)[2]


_DEDUPE = (
    "select min(ord) over (partition by symbol, type, file, parent_symbol) as ord, symbol, type, file, description, "
    "signature, exported, parent_symbol, visibility, row_number() over (partition by symbol, type, file, parent_symbol "
    "order by ord desc) as rn from {src}"
)


@register("dedupe_symbols", with_views(
    f"select {SYMBOL_COLS} from ({_DEDUPE.format(src='symbols_v')}) d where rn = 1", "symbols_v"))
def dedupe_symbols(spark, sf):
    return flatten(G.dedupe_symbols(symbols(spark, sf)))


_ALTERED = ("(select ord + 100000 as ord, symbol, type, file, 'updated ' || description as description, signature, "
            "exported, parent_symbol, visibility from symbols_v where ord % 5 = 0)")


@register("upsert_symbols", with_views(
    f"select {SYMBOL_COLS} from ({_DEDUPE.format(src='(select * from symbols_v union all select * from ' + _ALTERED + ')')}) d "
    "where rn = 1", "symbols_v"))
def upsert_symbols(spark, sf):
    syms = symbols(spark, sf)
    altered = syms.where(F.col("ord") % 5 == 0).select(
        (F.col("ord") + 100000).alias("ord"), "symbol", "type", "file",
        F.concat(F.lit("updated "), F.col("description")).alias("description"),
        "signature", "exported", "parent_symbol", "metadata")
    return flatten(G.upsert_symbols(syms, altered))


_MOVED = ("(select ord + 1000000 as ord, symbol, type, '/src/Brand1.ts' as file, description, signature, exported, "
          "parent_symbol, visibility from symbols_v where file = '/src/Brand2.ts')")


@register("replace_file_symbols", with_views(
    f"select {SYMBOL_COLS} from symbols_v where file <> '/src/Brand1.ts' union all "
    f"select {SYMBOL_COLS} from ({_DEDUPE.format(src=_MOVED)}) d where rn = 1", "symbols_v"))
def replace_file_symbols(spark, sf):
    syms = symbols(spark, sf)
    moved = syms.where(F.col("file") == "/src/Brand2.ts").select(
        (F.col("ord") + 1000000).alias("ord"), "symbol", "type", F.lit("/src/Brand1.ts").alias("file"),
        "description", "signature", "exported", "parent_symbol", "metadata")
    return flatten(G.replace_file_symbols(syms, moved))


@register("remove_file_symbols", with_views(
    f"select {SYMBOL_COLS} from symbols_v where file <> '/src/Brand1.ts'", "symbols_v"))
def remove_file_symbols(spark, sf):
    syms = symbols(spark, sf)
    one = spark.createDataFrame([("/src/Brand1.ts",)], "path string")
    return flatten(G.remove_file_symbols(syms, _tracking(spark, sf), one, _listing(spark, sf))[0])


@register("clear_registry", with_views(f"select {SYMBOL_COLS} from symbols_v where false", "symbols_v"))
def clear_registry(spark, sf):
    return flatten(G.clear_registry(symbols(spark, sf), _tracking(spark, sf))[0])


@register("registry_round_trip", with_views(f"select {SYMBOL_COLS} from symbols_v", "symbols_v"))
def registry_round_trip(spark, sf):
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    TB.persist_registry(symbols(spark, sf), _tracking(spark, sf), root)
    syms, _ = TB.load_registry(spark, root)
    return flatten(syms)


@register("union_listings", with_views(
    "select path, 1 as pattern_idx from doc_files where regexp_matches(path, '^/corpus/(.*/)?[^/]*\\.ts$') "
    "union all select path, 2 from doc_files", "doc_files"))
def union_listings(spark, sf):
    files = load_view(spark, sf, "doc_files").select("path")
    return G.union_listings(files, ["**/*.ts", "**/*"], base_dir="/corpus")
