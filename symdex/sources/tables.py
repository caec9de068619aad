"""Loading and persisting the registry (A5, A6, G9) and view adapters; ``store`` holds the storage itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.schemas import FILE_TRACKING, SYMBOLS
from symdex.sources.store import RegistryStore

def symbols_from_view(view: DataFrame) -> DataFrame:
    """Adapt the flat ``symbols_v`` check view to the symbol-table schema."""
    return view.select(
        F.col("ord").cast("long").alias("ord"),
        "symbol", "type", "file", "description", "signature", "exported", "parent_symbol",
        F.struct(
            F.lit(None).cast("boolean").alias("is_component"),
            F.col("visibility"),
            F.lit(None).cast("string").alias("route_method"),
            F.lit(None).cast("string").alias("route_path"),
            F.lit(None).cast("string").alias("handler"),
        ).alias("metadata"),
    )


def tracking_from_view(view: DataFrame) -> DataFrame:
    return view.select("path", "last_parsed", "last_modified", F.col("exists").alias("exists"))


def empty_symbols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SYMBOLS)


def empty_tracking(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FILE_TRACKING)


def persist_registry(symbols: DataFrame, tracking: DataFrame, path: str) -> None:
    """Both tables as one new version of the store at ``path`` (one write per batch, not per symbol)."""
    RegistryStore(symbols.sparkSession, path).replace_all(symbols, tracking)


def load_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A5: both tables of the newest version; a store that does not exist yields empty tables, any other failure is raised."""
    return RegistryStore(spark, path).load()


def load_registry_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A5 for a JSON state document ``{symbols: [...], files: [...], lastFullRefresh}``.

    Corrupt input becomes empty tables (PERMISSIVE parse, nulls dropped).
    Times are epoch milliseconds in the document.
    """
    schema = (
        "symbols array<struct<symbol:string,type:string,file:string,description:string,signature:string,"
        "exported:boolean,parentSymbol:string,metadata:struct<isComponent:boolean,visibility:string,"
        "method:string,path:string,handler:string>>>, "
        "files array<struct<path:string,lastParsed:double,lastModified:double,exists:boolean>>, lastFullRefresh double"
    )
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    symbols = raw.select(F.posexplode("symbols").alias("pos", "s")).select(
        F.col("pos").cast("long").alias("ord"),
        F.col("s.symbol").alias("symbol"), F.col("s.type").alias("type"), F.col("s.file").alias("file"),
        F.col("s.description").alias("description"), F.col("s.signature").alias("signature"),
        F.col("s.exported").alias("exported"), F.col("s.parentSymbol").alias("parent_symbol"),
        F.struct(
            F.col("s.metadata.isComponent").alias("is_component"),
            F.col("s.metadata.visibility").alias("visibility"),
            F.col("s.metadata.method").alias("route_method"),
            F.col("s.metadata.path").alias("route_path"),
            F.col("s.metadata.handler").alias("handler"),
        ).alias("metadata"),
    )
    tracking = raw.select(F.explode("files").alias("f")).select(
        F.col("f.path").alias("path"),
        F.timestamp_millis(F.col("f.lastParsed").cast("long")).alias("last_parsed"),
        F.timestamp_millis(F.col("f.lastModified").cast("long")).alias("last_modified"),
        F.col("f.exists").alias("exists"),
    )
    return symbols, tracking
