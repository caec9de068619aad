"""A bit table of fixed size over a column of longs, to skip rows early; an exact join stays behind it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16


def bit_table(df: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """``2**bits`` booleans; value v sets the one at its low ``bits`` bits."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.zeros(CHUNK, bool)
                own[places] = True
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    bit = df.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("bit")).distinct()
    chunks = bit.groupBy(F.shiftright("bit", 16).alias("chunk")).agg(F.collect_list(F.col("bit").bitwiseAND(F.lit(CHUNK - 1))).alias("places"))
    table = np.zeros(1 << bits, bool)
    for chunk, own in chunks.mapInArrow(pack, "chunk int, bits binary").collect():  # one bit each, whatever the input
        table[chunk * CHUNK : (chunk + 1) * CHUNK] = np.unpackbits(np.frombuffer(own, np.uint8)).astype(bool)
    return table
