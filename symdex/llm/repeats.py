"""Exact removal of long repeated byte strings with a run-compressed index.

Two equal strings of ``LENGTH`` bytes share an anchor, the least gram of
``GRAM`` bytes, at the same offset.  So the stretch around each anchor (all
windows that hold it) is compared only with the stretches of the same gram:

1. anchors are counted over the corpus; a gram that occurs once is done with;
2. equal stretches are summed: where one occurs twice, all its windows repeat;
3. what differs around the same gram goes, one row a distinct stretch, to the index
   of its gram: a Burrows-Wheeler transform of the stretches aligned at the gram,
   built from the last column to the first.  A column's symbols in suffix order are
   kept as runs; inside a run the common prefix with the row above is the one
   of the next column plus 1, and only at run ends it is taken anew, as a minimum
   over the rows between (sampled run ends).  So the matching statistics
   of every row stream out column by column, and windows whose longest match reaches
   ``LENGTH`` are marked;
4. grams with more than ``MOST_ROWS`` distinct stretches would not fit one index;
   their windows are counted by hash over the whole cluster instead, which is
   exact as well.

The marks of all anchors of a text are united and its bytes cut out.  Anchors do
not cross texts.  Texts are known by a 64-bit digest of their bytes, so copies
share their marks.  Null counts as empty; texts shorter than ``LENGTH`` keep all;
equal rows are copies of each other; ids may be null or repeated; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.llm.anchors import anchors, regions
from symdex.llm.bits import bit_table
from symdex.llm.common import shared_folder, text_or_empty, written
from symdex.llm.words import prefix_sums, rows_of, sliced, stretch_hashes

LENGTH, GRAM = 200, 64
MOST_ROWS = 50_000
#: A text is searched in slices of this many bytes.
SLICE = 2 << 20
#: Rows that one index holds at a time, of whole groups.
BATCH_ROWS = 20_000


def _key(text: bytes) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def text_anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes and stretch hashes of a text's anchors."""
    n = len(text)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, max(0, n - length + 1), SLICE):
        low, high = max(0, s - length), min(n, s + SLICE + 2 * length)
        buf = np.frombuffer(text, np.uint8, high - low, low)
        sums = prefix_sums(buf)
        inner = slice(s - low, min(n, s + SLICE + length - 1) - low)
        at, h = anchors(buf[inner], prefix_sums(buf[inner]), gram, length)
        at = at + inner.start
        # ends are those of the text: the slice reaches past every stretch, or to the text's end
        _, _, r = regions(sums, len(buf), at, gram, length)
        found.append((at + low, h, r))
    if not found:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    at, h, r = (np.concatenate(x) for x in zip(*found, strict=True))
    at, first = np.unique(at, return_index=True)
    return at, h[first], r[first]


def _anchor_rows(length: int, gram: int, table=None):
    """(text key, place, gram, stretch) of all anchors; with a bit table, of those whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else table.value
        for _, texts in rows_of(batches, 4 << 20):
            keys, places, grams, stretches = [], [], [], []
            for text in texts:
                at, h, r = text_anchors(text, length, gram)
                if bits is not None:
                    some = bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)]
                    at, h, r = at[some], h[some], r[some]
                keys.append(np.full(len(at), _key(text) if len(at) else 0, np.int64))
                places.append(at)
                grams.append(h.view(np.int64))
                stretches.append(r.view(np.int64))
            columns = [np.concatenate(x) for x in (keys, places, grams, stretches)]
            if bits is None:
                columns = columns[2:]
            for a in range(0, len(columns[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], ["key", "place", "gram", "stretch"][-len(columns) :])

    return run


def _packed(texts: DataFrame) -> DataFrame:
    """doc_id, key and the compressed bytes of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for ids, group in rows_of(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_key(t) for t in group], pa.int64()), pa.array([packer.compress(t) for t in group], pa.binary())], ["doc_id", "key", "packed"])

    return texts.mapInArrow(run, "doc_id long, key long, packed binary")


def matching_windows(rows: np.ndarray, groups: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For rows aligned at their gram, sorted by group: which window starts have their ``length`` symbols in another row of the group.

    Columns are symbols from ``length - gram`` before the gram to ``length - gram`` after it.
    """
    m, side = len(rows), length - gram
    rows = np.ascontiguousarray(rows.T)
    first = np.concatenate(([True], groups[1:] != groups[:-1]))
    group_no = np.cumsum(first).astype(np.int64) << 10
    inner = ~first
    order = np.arange(m)
    shared = np.zeros(m + 1, np.int64)  # common prefix of each row with the one above it, in order
    marks = np.zeros((side + 1, m), bool)

    def mark(column: int) -> None:
        best = np.maximum(shared[:m], np.where(np.concatenate((inner[1:], [False])), shared[1:], 0))
        marks[column, order] = best >= length

    for column in [*range(2 * side + gram - 1, length - 1, -1), -1, *range(side - 1, -1, -1)]:
        if column < 0:  # the gram itself is the same in all rows of a group
            shared[:m] += np.where(inner, gram, 0)
            mark(side)
            continue
        symbols = rows[column, order]
        keys = group_no + symbols
        heads = inner & (keys != np.concatenate((keys[:1], keys[:-1])))
        if not heads.any():  # one run a group
            shared[:m] += inner
        else:
            turn = np.argsort(keys, kind="stable")
            above = np.concatenate(([-1], turn[:-1]))
            same = np.concatenate(([False], keys[turn[1:]] == keys[above[1:]]))
            fresh = shared[turn] + 1
            ends = np.flatnonzero(same & (turn != above + 1))  # run ends: the rows between have another symbol
            if len(ends):
                spans = np.stack((above[ends] + 1, turn[ends] + 1), axis=1).reshape(-1)
                fresh[ends] = np.minimum.reduceat(shared, spans)[::2] + 1
            shared[:m] = np.where(same, fresh, 0)
            order = order[turn]
        if column <= side:
            mark(column)
    return marks.T


def _cut(text: bytes, at: int, length: int, gram: int) -> tuple[np.ndarray, int, int]:
    """Symbols (byte + 1, 0 outside) of the stretch at an anchor, and its first and end column."""
    side = length - gram
    low, high = max(0, at - side), min(len(text), at + length)
    row = np.zeros(2 * side + gram, np.uint16)
    row[low - at + side : high - at + side] = np.frombuffer(text, np.uint8, high - low, low).astype(np.uint16) + 1
    return row, low - at + side, high - at + side


def _spans(starts: np.ndarray, length: int) -> list[int]:
    """Marked window starts as first and end columns of the bytes that they cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    low, high = np.concatenate(([starts[0]], starts[gap + 1])), np.concatenate((starts[gap], [starts[-1]])) + length
    return np.stack((low, high), axis=1).reshape(-1).tolist()


STRETCHES = "gram long, stretch long, n long, hot boolean, low int, high int, bytes binary"
MARKS = "gram long, stretch long, spans array<int>"


def _indexed(length: int, gram: int):
    """Rows of STRETCHES sorted by gram and stretch to MARKS."""

    def marks_of(grams: np.ndarray, stretches: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        side = length - gram
        # every window holds half of the left side or half of the right side with the gram: a row alone in both has no match
        half, wide = side // 2, (rows.astype(np.uint64) + np.uint64(1))
        weights = np.cumprod(np.full(rows.shape[1], 0x9E3779B97F4A7C15, np.uint64))
        alone = np.ones(len(rows), bool)
        for columns in (slice(side - half, side), slice(length, length + side - half)):
            part = (wide[:, columns] * weights[columns]).sum(axis=1, dtype=np.uint64) ^ (grams.view(np.uint64) * np.uint64(0x94D049BB133111EB))
            _, back, times = np.unique(part, return_inverse=True, return_counts=True)
            alone &= times[back] == 1
        places = [[] for _ in range(len(rows))]
        some = np.flatnonzero(~alone)
        if len(some):
            found = matching_windows(rows[some], grams[some], length, gram)
            columns = np.arange(side + 1)
            found &= (columns >= low[some][:, None]) & (columns + length <= high[some][:, None])
            for i, row in zip(some.tolist(), found, strict=True):
                places[i] = _spans(np.flatnonzero(row), length)
        for i in np.flatnonzero((counts > 1) & (high - low >= length)).tolist():
            places[i] = [int(low[i]), int(high[i])]
        return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(stretches), pa.array(places, pa.list_(pa.int32()))], ["gram", "stretch", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * (length - gram) + gram
        held: list[list[np.ndarray]] = []
        size = 0

        def joined() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for batch in batches:
            data = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint16).reshape(-1, width)
            held.append([*(batch.column(c).to_numpy() for c in ("gram", "stretch", "n", "low", "high")), data])
            size += batch.num_rows
            if size >= BATCH_ROWS:
                columns = joined()
                last = np.flatnonzero(columns[0] != columns[0][-1])
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield finish([c[:cut] for c in columns])
                held, size = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if size:
            yield finish(joined())

    def finish(columns: list[np.ndarray]) -> pa.RecordBatch:
        # copies of one text deliver the same stretch again
        new = np.concatenate(([True], (np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)))
        return marks_of(*(c[new] for c in columns))

    return run


def _windows(length: int, gram: int):
    """Rows of STRETCHES to one row for each window: its column and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, r, n, low, high, data in zip(*(batch.column(c).to_pylist() for c in ("gram", "stretch", "n", "low", "high", "bytes")), strict=True):
                at = np.arange(low, high - length + 1)
                if len(at):
                    sums = prefix_sums(np.frombuffer(data, np.uint16))
                    w = stretch_hashes(sums, at, at + length).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v)) for v in (g, r, n)] + [pa.array(at.astype(np.int32)), pa.array(w)], ["gram", "stretch", "n", "place", "window"])

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most_rows: int = MOST_ROWS) -> DataFrame:
    """key (of a text's bytes) and spans, the first and end bytes of its strings that start elsewhere too; spans may overlap."""
    spark = texts.sparkSession
    counted = texts.mapInArrow(_anchor_rows(length, gram), "gram long, stretch long").groupBy("gram")
    grams = counted.agg(F.count(F.lit(1)).alias("n"), (F.min("stretch") != F.max("stretch")).alias("differs")).where("n > 1").select("gram", "differs")
    grams = written(grams, "repeat-grams", "none")
    table = spark.sparkContext.broadcast(bit_table(grams, "gram"))
    rows = texts.mapInArrow(_anchor_rows(length, gram, table), "key long, place long, gram long, stretch long")
    rows = written(rows.join(grams, "gram"), "repeat-anchors")
    differing = rows.where("differs").groupBy("gram", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("rep"))
    differing = written(differing, "repeat-stretches", "none")
    hot = differing.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most_rows).select("gram", F.lit(True).alias("hot"))
    wanted = differing.join(hot, "gram", "left").groupBy(F.col("rep.key").alias("key")).agg(F.collect_list(F.struct("gram", "stretch", "n", F.coalesce("hot", F.lit(False)).alias("hot"), F.col("rep.place").alias("place"))).alias("wanted"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches):
            out: list[tuple] = []
            for data, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = unpack(data)
                for w in wants:
                    row, low, high = _cut(text, w["place"], length, gram)
                    out.append((w["gram"], w["stretch"], w["n"], w["hot"], low, high, row.tobytes()))
                if len(out) >= 5000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["gram", "stretch", "n", "hot", "low", "high", "bytes"])

    stretches = _packed(texts).select("key", "packed").join(wanted, "key").select("packed", "wanted").mapInArrow(cut_out, STRETCHES)
    if hot.isEmpty():
        marks = stretches.repartition("gram").sortWithinPartitions("gram", "stretch").mapInArrow(_indexed(length, gram), MARKS)
    else:
        stretches = written(stretches, "repeat-cuts", "lz4")
        marks = stretches.where("not hot").repartition("gram").sortWithinPartitions("gram", "stretch").mapInArrow(_indexed(length, gram), MARKS)
        windows = stretches.where("hot").dropDuplicates(["gram", "stretch"]).mapInArrow(_windows(length, gram), "gram long, stretch long, n long, place int, window long")
        again = windows.groupBy("gram", "place", "window").agg(F.sum("n").alias("times")).where("times > 1")
        places = windows.join(again, ["gram", "place", "window"]).select("gram", "stretch", F.array("place", F.col("place") + length).alias("span"))
        marks = marks.unionByName(places.groupBy("gram", "stretch").agg(F.flatten(F.collect_list("span")).alias("spans")))
    marks = written(marks.where(F.size("spans") > 0), "repeat-marks")
    side = length - gram
    # spans count from `side` bytes before the anchor; a stretch that is the same everywhere repeats as a whole
    own = rows.where("differs").join(marks, ["gram", "stretch"]).select("key", "place", "spans")
    whole = rows.where("not differs").select("key", "place", F.lit(None).cast("array<int>").alias("spans"))
    spans = F.when(F.col("spans").isNull(), F.array(F.col("place") - side, F.col("place") + length)).otherwise(F.transform("spans", lambda x: x + F.col("place") - side))
    return own.unionByName(whole).select("key", spans.alias("spans")).groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def united(spans: list[int], n: int, length: int) -> list[tuple[int, int]]:
    """Disjoint spans in order, inside a text of ``n`` bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(spans[0::2], spans[1::2], strict=True)):
        a, b = max(0, a), min(n, b)
        if b - a < length:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, n_bytes, spans (first and end bytes removed) and kept, the bytes that are left, of every row."""
    shared_folder(docs.sparkSession)
    texts = text_or_empty(docs)
    spans = repeated_spans(texts, length, gram, most_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches):
            n, gone, kept = [], [], []
            for data, found in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = unpack(data)
                pieces = united(found or [], len(text), length)
                edges = [0, *(x for piece in pieces for x in piece), len(text)]
                n.append(len(text))
                gone.append([{"first": a, "end": b} for a, b in pieces])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    rows = _packed(texts).join(spans, "key", "left").select("doc_id", "packed", "spans")
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<first: long, end: long>>, kept binary")


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Counts of what is removed from every text, and the digest of the rest."""
    rows = without_repeats(docs, length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
