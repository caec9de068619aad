"""Query catalog: every operator key of SURVEY section 2 wired to its check view.

Each entry is ``(spark, sf_dir) -> DataFrame`` and, where SQL can express it,
an equivalent DuckDB query over the same base tables (the check views are
inlined as CTEs).  Parameters are fixed per key; every query reads the whole
view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.sources.fixtures import load_view, with_views
from symdex.sources.tables import symbols_from_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def symbols(spark: SparkSession, sf_dir: str, prepare=None) -> DataFrame:
    return symbols_from_view(load_view(spark, sf_dir, "symbols_v", prepare))


#: Files that one task of a code view reads, about.
FILES_PER_TASK = 5_000


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of a base table dealt out to tasks: the check tables have few row groups, and a task per group would grow with its files.

    The number of rows only decides how many tasks there are: one for ``FILES_PER_TASK`` files, all cores at least.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FILES_PER_TASK))
    return rows.repartition(tasks)


def source_files(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """Path and content of a code view.  Its base rows are dealt to all cores, and each task renders its own files."""
    return load_view(spark, sf_dir, view, dealt).select("path", "content")


# DuckDB spelling of the ranking keys (F1).
PRIORITY_SQL = (
    "case type when 'function' then 1 when 'class' then 2 when 'route' then 3 when 'method' then 4 "
    "when 'interface' then 5 when 'type' then 6 when 'property' then 7 when 'variable' then 8 else 999 end"
)
SYMBOL_COLS = "ord, symbol, type, file, description, signature, exported, parent_symbol, visibility"


def rank_order_sql(term_sql: str) -> str:
    return f"coalesce(symbol = {term_sql}, false) desc, coalesce(exported, false) desc, {PRIORITY_SQL}, ord"


def private_sql() -> str:
    return "(coalesce(visibility, '') = 'private' or starts_with(symbol, '_') or starts_with(symbol, '#'))"


def topk_sql(where: str, term_sql: str, k: int, cols: str = SYMBOL_COLS) -> str:
    return with_views(
        f"select {cols}, rank from (select *, row_number() over (order by {rank_order_sql(term_sql)}) as rank "
        f"from symbols_v where {where}) t where rank <= {k}",
        "symbols_v",
    )


def load_all() -> None:
    """Import every check module so that its keys are registered."""
    import importlib

    for mod in ("checks_search", "checks_related", "checks_usages", "checks_registry", "checks_extract", "checks_requests", "checks_stream", "checks_sources", "checks_retired", "checks_answers"):
        importlib.import_module(f"symdex.plans.{mod}")
