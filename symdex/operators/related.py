"""Symbol documentation with parents and members.

Parents and children are linked **by name**.  The batch forms never join
namesake to namesake: parents are first reduced to one best row per name
(a partial hash aggregate, so a name shared by a third of the table is
combined map-side), and children are keyed by their parent *name*, so a class
and its members are related through one name row instead of all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.functions.columns import is_private, type_priority
from symdex.operators.search import flatten, lookup_symbol, rank_keys

MEMBER_OWNER_TYPES = ("class", "interface")


def _order_struct() -> F.Column:
    """Ascending struct equal to the rank order of an exact-name search."""
    return F.struct(
        (~F.coalesce(F.col("exported"), F.lit(False))).alias("not_exported"),
        type_priority(F.col("type")).alias("priority"),
        F.col("ord").alias("ord"),
    )


def best_symbol_per_name(symbols: DataFrame, include_private: bool = False) -> DataFrame:
    """One row per name: the top-ranked namesake (exported, kind priority, ord)."""
    df = symbols if include_private else symbols.where(~is_private(F.col("symbol"), F.col("metadata.visibility")))
    best = df.groupBy("symbol").agg(
        F.min_by(F.struct("ord", "type", "file", "description"), _order_struct()).alias("best")
    )
    return best.select(
        F.col("symbol").alias("parent_name"),
        F.col("best.ord").alias("parent_ord"),
        F.col("best.type").alias("parent_type"),
        F.col("best.file").alias("parent_file"),
        F.col("best.description").alias("parent_description"),
    )


def symbol_parent(symbols: DataFrame) -> DataFrame:
    """C1 for every symbol that names a parent: the parent's best non-private row (Q19)."""
    kids = symbols.where(F.col("parent_symbol").isNotNull()).select("ord", "symbol", "type", "parent_symbol")
    parents = best_symbol_per_name(symbols)
    return kids.join(parents, kids.parent_symbol == parents.parent_name, "left").drop("parent_name")


def symbol_children(symbols: DataFrame) -> DataFrame:
    """C2 keyed by owner name: every member whose parent name is a class/interface name.

    Private members are included.  The list order is the ranking of an empty
    term (exported, kind priority, ord), exposed as columns.
    """
    owners = symbols.where(F.col("type").isin(*MEMBER_OWNER_TYPES)).select(F.col("symbol").alias("owner")).distinct()
    kids = symbols.where(F.col("parent_symbol").isNotNull())
    out = kids.join(owners, kids.parent_symbol == owners.owner, "left_semi")
    return out.select(
        F.col("parent_symbol").alias("owner_name"),
        F.col("ord").alias("child_ord"),
        F.col("symbol").alias("child_symbol"),
        F.col("type").alias("child_type"),
        F.col("description").alias("child_description"),
        F.coalesce(F.col("exported"), F.lit(False)).alias("child_exported"),
        type_priority(F.col("type")).alias("child_priority"),
    )


def related_symbols(symbols: DataFrame, found: DataFrame, child_scan_limit: int | None = None) -> DataFrame:
    """C3 for looked-up rows ``found`` (a handful of rows): parent then children.

    Output: (ord, relationship, symbol, type, description, rel_*) where ``ord``
    is the looked-up symbol and the ``rel_*`` columns are the list order.  ``child_scan_limit=50`` reproduces the reference's
    scan of only the 50 best symbols of the whole project (Q3); ``None`` lists
    every member.
    """
    f = found.select(F.col("ord").alias("of_ord"), F.col("symbol").alias("of_symbol"),
                     F.col("type").alias("of_type"), F.col("parent_symbol").alias("of_parent"))
    # only the namesakes of the wanted parent names are ranked, not the whole table
    wanted = f.select(F.col("of_parent").alias("symbol")).where(F.col("symbol").isNotNull()).distinct()
    parents = best_symbol_per_name(symbols.join(wanted, "symbol", "left_semi"))
    parent_rows = f.join(parents, f.of_parent == parents.parent_name, "inner").select(
        "of_ord", F.lit(0).alias("rel_group"), F.lit(False).alias("rel_not_exported"),
        F.lit(0).alias("rel_priority"), F.col("parent_ord").alias("rel_ord"),
        F.lit("parent").alias("relationship"), F.col("parent_name").alias("symbol"),
        F.col("parent_type").alias("type"), F.col("parent_description").alias("description"),
    )
    pool = symbols
    if child_scan_limit is not None and child_scan_limit > 0:
        pool = symbols.orderBy(*rank_keys(F.lit(""))).limit(child_scan_limit)
    kids = pool.where(F.col("parent_symbol").isNotNull())
    owners = f.where(F.col("of_type").isin(*MEMBER_OWNER_TYPES))
    child_rows = kids.join(owners, kids.parent_symbol == owners.of_symbol, "inner").select(
        "of_ord", F.lit(1).alias("rel_group"),
        (~F.coalesce(F.col("exported"), F.lit(False))).alias("rel_not_exported"),
        type_priority(F.col("type")).alias("rel_priority"), F.col("ord").alias("rel_ord"),
        F.lit("child").alias("relationship"), "symbol", "type", "description",
    )
    # The list order is (rel_group, rel_not_exported, rel_priority, rel_ord); it
    # is kept as columns so a class with very many members is never numbered
    # inside one task.
    return parent_rows.unionByName(child_rows).withColumnRenamed("of_ord", "ord").orderBy(
        "ord", "rel_group", "rel_not_exported", "rel_priority", "rel_ord")


def project_symbol_doc(found: DataFrame, related: DataFrame | None) -> DataFrame:
    """Name ... metadata, visibility lifted, related list null when empty."""
    base = flatten(found).select(
        F.lit(True).alias("found"),
        F.col("symbol").alias("name"), "type", "file", "description", "signature", "exported", "visibility", "ord",
    )
    if related is None:
        return base.withColumn("related_count", F.lit(None).cast("int")).drop("ord")
    counts = related.groupBy("ord").agg(F.count(F.lit(1)).cast("int").alias("related_count"))
    return base.join(counts, "ord", "left").drop("ord")


def get_doc_for_symbol(symbols: DataFrame, symbol, type=None, file=None, include_related: bool = True,
                       child_scan_limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(doc row, related rows).  A miss yields one row ``found=false`` with the error text."""
    spark = symbols.sparkSession
    if not symbol or not isinstance(symbol, str):
        return _not_found(spark, "Missing or invalid symbol name"), None
    found = lookup_symbol(symbols, symbol, type, file).drop("rank")
    related = related_symbols(symbols, found, child_scan_limit) if include_related else None
    doc = project_symbol_doc(found, related).withColumn("error", F.lit(None).cast("string"))
    miss = _not_found(spark, f"Symbol '{symbol}' not found")
    # One answer row: the hit when there is one, else the miss row (at most two rows meet here).
    both = doc.unionByName(miss)
    one = both.agg(F.max_by(F.struct(*both.columns), F.col("found").cast("int")).alias("r")).select("r.*")
    return one, related


def _not_found(spark, message: str) -> DataFrame:
    return spark.createDataFrame(
        [(False, None, None, None, None, None, None, None, None, message)],
        "found boolean, name string, type string, file string, description string, signature string, "
        "exported boolean, visibility string, related_count int, error string",
    )
