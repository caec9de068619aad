"""Streaming keys (S1 on ``events``, S2 on ``requests_v``): the stream's final state equals the batch answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from symdex.plans.catalog import register
from symdex.operators import requests as RQ
from symdex.plans.checks_requests import DISPATCH_SQL, dispatch_inputs
from symdex.session import ensure_checkpoint_dir
from symdex.sources.fixtures import load_view, with_views
from symdex.streaming import changes as S

SOURCE_FILES = 4  # the events are replayed as four files, one per micro-batch


def _scratch(spark, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@register("stream_file_changes", with_views(
    "select path as file, event_type || '_' || cast(event_id as varchar) as symbol, 'function' as type, "
    "true as exported from (select '/src/u' || cast(user_id as varchar) || '.ts' as path, event_id, event_type, "
    "row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) e "
    "where rn = 1 and event_type <> 'error'"))
def stream_file_changes(spark, sf):
    root = _scratch(spark, "s1")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    changes = ev.select(
        F.concat(F.lit("/src/u"), F.col("user_id").cast("string"), F.lit(".ts")).alias("path"),
        F.col("ts").alias("mtime"), F.col("event_id").alias("seq"),
        F.concat(F.lit("export function "), F.col("event_type"), F.lit("_"), F.col("event_id").cast("string"),
                 F.lit("() {}\n")).alias("content"),
        (F.col("event_type") == "error").alias("deleted"),
    )
    # files arrive out of time order, so later batches carry older versions (late data)
    changes.repartition(SOURCE_FILES, F.pmod(F.col("seq"), F.lit(SOURCE_FILES))).write.parquet(f"{root}/in")
    S.stream_file_changes(spark, f"{root}/in", f"{root}/state", f"{root}/ckpt", files_per_batch=1, max_rows=20)
    syms, _ = S.read_state(spark, f"{root}/state")
    return syms.select("file", "symbol", "type", "exported")


@register("stream_requests", DISPATCH_SQL)
def stream_requests(spark, sf):
    """The dispatcher's answers over two micro-batches."""
    root = _scratch(spark, "s2")
    reqs = load_view(spark, sf, "requests_v")
    reqs.repartition(2).write.json(f"{root}/in")
    syms, files, listing, summary = dispatch_inputs(spark, sf)
    S.stream_requests(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt", syms, files=files, listing=listing, summary=summary, files_per_batch=1)
    return RQ.summarised(S.read_answers(spark, f"{root}/out"))
