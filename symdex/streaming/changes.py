"""Structured Streaming jobs.

S1 ``stream_file_changes``: file versions arrive as rows (path, mtime,
content, deleted).  Each micro-batch keeps the newest version per path
(``max_by``), drops versions not newer than the tracked one (the late-data
rule), removes the symbols of deleted files and replaces the symbols of
changed files, in one commit to the registry store (``sources.store``).  A batch reads and rewrites only the
buckets its files fall into, and the late-data rule makes a re-run batch a no-op for
versions already applied.

S2 ``stream_requests``: request rows (request_id, line) arrive as JSON
files; every micro-batch is answered by the batch dispatcher from the store's newest version (or given tables)
and appended to the response folder under its batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.operators.file_docs import extract_symbols
from symdex.operators.registry import dedupe_symbols
from symdex.operators.requests import dispatch_requests, emit_responses
from symdex.session import ensure_checkpoint_dir
from symdex.sources.store import MAX_ROWS, RegistryStore

CHANGE_SCHEMA = "path string, mtime timestamp, seq long, content string, deleted boolean"


def read_state(spark: SparkSession, state: str) -> tuple[DataFrame, DataFrame]:
    """The committed (symbols, tracking) tables; empty before the first batch."""
    return RegistryStore(spark, state).load()


def apply_changes(batch: DataFrame, state: str, max_rows: int = MAX_ROWS, index: bool = False) -> None:
    """One S1 micro-batch: newest version per path, late versions dropped, symbols replaced, in one commit."""
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    store = RegistryStore(spark, state, max_rows, index)
    manifest = store.manifest()
    newest = batch.groupBy("path").agg(
        F.max_by(F.struct("mtime", "seq", "content", "deleted"), F.struct("mtime", "seq")).alias("v")
    ).select("path", F.col("v.mtime").alias("mtime"), F.col("v.content").alias("content"), F.col("v.deleted").alias("deleted")).checkpoint()
    tracking = store.read("tracking", manifest, store.touched(newest, manifest))
    # late data: keep a version only when it is newer than the tracked one
    fresh = newest.join(tracking.select("path", "last_modified"), "path", "left").where(
        F.col("last_modified").isNull() | (F.col("mtime") > F.col("last_modified"))).drop("last_modified")
    changed = fresh.where(~F.col("deleted")).select("path", "content")
    stamped = fresh.select("path", F.col("mtime").alias("last_parsed"), F.col("mtime").alias("last_modified"), (~F.col("deleted")).alias("exists"))
    store.commit(fresh.select("path"), dedupe_symbols(extract_symbols(changed, offset=manifest.next_ord)), stamped, manifest)


def stream_file_changes(spark: SparkSession, source_dir: str, state: str, checkpoint: str,
                        files_per_batch: int | None = None, max_rows: int = MAX_ROWS, index: bool = False):
    """Run the change stream over ``source_dir`` (parquet rows of CHANGE_SCHEMA) until drained.

    ``files_per_batch`` bounds a micro-batch; by default one takes all that is there.
    ``index`` keeps the gram index of the changed buckets in the same commit.
    """
    reader = spark.readStream.schema(CHANGE_SCHEMA)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    q = (reader.parquet(source_dir).writeStream.foreachBatch(lambda df, bid: apply_changes(df, state, max_rows, index))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def answer_batch(batch: DataFrame, batch_id: int, out_dir: str, symbols: DataFrame, files=None,
                 listing=None, summary=None) -> None:
    """One S2 micro-batch: answer the requests and write their answers and responses under the batch id."""
    folder = f"{out_dir}/batch={batch_id}"
    # one pass over the plan: the records first, the JSON lines from what was written
    dispatch_requests(batch, symbols, files=files, listing=listing, summary=summary).write.mode("overwrite").parquet(f"{folder}/answers")
    emit_responses(batch.sparkSession.read.parquet(f"{folder}/answers")).write.mode("overwrite").json(f"{folder}/responses")


def stream_requests(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, symbols: DataFrame,
                    files=None, listing=None, summary=None, files_per_batch: int | None = None):
    """JSON request rows (request_id, line) -> answers + JSON responses, until drained."""
    reader = spark.readStream.schema("request_id string, line string")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    q = (reader.json(source_dir).writeStream.foreachBatch(
        lambda df, bid: answer_batch(df, bid, out_dir, symbols, files, listing, summary))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_answers(spark: SparkSession, out_dir: str, what: str = "answers") -> DataFrame:
    """The ``answers`` or ``responses`` of all micro-batches."""
    folders = f"{out_dir}/batch=*/{what}"
    return spark.read.parquet(folders) if what == "answers" else spark.read.json(folders)
