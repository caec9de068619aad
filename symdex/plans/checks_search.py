"""Search / completion / lookup keys on ``symbols_v``."""

from __future__ import annotations

from pyspark.sql import functions as F

from symdex.operators import search as S
from symdex.plans.catalog import (
    PRIORITY_SQL, SYMBOL_COLS, private_sql, rank_order_sql, register, symbols, topk_sql,
)
from symdex.sources.fixtures import with_views

TERM = "ROD"  # substring term of the ranking checks


def _flat(df):
    return S.flatten(df)


@register("filter_type", with_views(f"select {SYMBOL_COLS} from symbols_v where type = 'method'", "symbols_v"))
def filter_type(spark, sf):
    return _flat(S.filter_type(symbols(spark, sf), "method"))


@register("filter_file", with_views(f"select {SYMBOL_COLS} from symbols_v where contains(file, 'Brand1')", "symbols_v"))
def filter_file(spark, sf):
    return _flat(S.filter_file(symbols(spark, sf), "Brand1"))


@register("filter_private", with_views(f"select {SYMBOL_COLS} from symbols_v where not {private_sql()}", "symbols_v"))
def filter_private(spark, sf):
    return _flat(S.filter_private(symbols(spark, sf), include_private=False))


@register("match_exact", with_views(f"select {SYMBOL_COLS} from symbols_v where symbol = 'red_widget'", "symbols_v"))
def match_exact(spark, sf):
    return _flat(S.match_exact(symbols(spark, sf), "red_widget"))


@register("match_substring", with_views(
    f"select {SYMBOL_COLS} from symbols_v where contains(lower(symbol), lower('{TERM}'))", "symbols_v"))
def match_substring(spark, sf):
    return _flat(S.match_substring(symbols(spark, sf), TERM))


@register("rank_symbols", with_views(
    f"select {SYMBOL_COLS}, coalesce(symbol = 'bolt', false) as is_exact, coalesce(exported, false) as is_exported, "
    f"{PRIORITY_SQL} as priority from symbols_v where contains(lower(symbol), 'bolt')", "symbols_v"))
def rank_symbols(spark, sf):
    # The whole ranked list of one term, with its sort keys as columns (no cap).
    return S.flatten(S.rank_symbols(S.match_substring(symbols(spark, sf), "bolt"), "bolt", with_keys=True))


@register("limit_results", topk_sql("true", "''", 20))
def limit_results(spark, sf):
    return S.limit_results(_flat(symbols(spark, sf)), S.rank_keys(F.lit("")), 20)


@register("search_symbols", topk_sql(f"contains(lower(symbol), lower('{TERM}')) and not {private_sql()}", f"'{TERM}'", 20))
def search_symbols(spark, sf):
    return _flat_ranked(S.search_symbols(symbols(spark, sf), TERM))


def _flat_ranked(df):
    return df.select(*S.OUTPUT_COLUMNS[:-1], F.col("metadata.visibility").alias("visibility"), "rank")


@register("search_symbols_typed", topk_sql(
    "type = 'function' and contains(file, 'Brand2') and contains(lower(symbol), lower('ring'))", "'ring'", 5))
def search_symbols_typed(spark, sf):
    return _flat_ranked(S.search_symbols(symbols(spark, sf), "ring", type="FUNCTION", file="Brand2",
                                         include_private=True, limit=5))


@register("search_symbols_exact", topk_sql("symbol = 'red_widget'", "'red_widget'", 20))
def search_symbols_exact(spark, sf):
    return _flat_ranked(S.search_symbols(symbols(spark, sf), "red_widget", exact_match=True, include_private=True))


@register("autocomplete_symbols", topk_sql(
    f"contains(lower(symbol), 'a') and not {private_sql()}", "'a'", 10,
    cols="symbol, type, signature, description, file as file_path"))
def autocomplete_symbols(spark, sf):
    return S.autocomplete_symbols(symbols(spark, sf), "a")


@register("project_completions", topk_sql(
    f"type = 'class' and contains(lower(symbol), 'wid') and not {private_sql()}", "'wid'", 10,
    cols="symbol, type, signature, description, file as file_path"))
def project_completions(spark, sf):
    return S.autocomplete_symbols(symbols(spark, sf), "wid", type="Class", limit=0)


@register("lookup_symbol", topk_sql("symbol = 'blue_bolt' and type = 'method'", "'blue_bolt'", 1))
def lookup_symbol(spark, sf):
    return _flat_ranked(S.lookup_symbol(symbols(spark, sf), "blue_bolt", type="method"))


@register("symbol_count", with_views("select count(*) as symbols from symbols_v", "symbols_v"))
def symbol_count(spark, sf):
    return symbols(spark, sf).agg(F.count(F.lit(1)).alias("symbols"))


@register("list_symbols", with_views(f"select {SYMBOL_COLS} from symbols_v", "symbols_v"))
def list_symbols(spark, sf):
    return _flat(symbols(spark, sf))


__all__ = ["PRIORITY_SQL", "rank_order_sql"]
