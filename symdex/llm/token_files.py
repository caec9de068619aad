"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks.

Writing.  Documents are put in ascending order of doc_id by range, encoded with
the tokenizers library, given an end id, and written as segments of a file:
one file a range, one row a segment, through Spark's own committed Parquet
writer, so a lost task leaves nothing behind.  A segment holds

    "TKS1", number of documents, of ids and of blocks (each a little-endian u64),
    doc ids (i64) and lengths (u32), both deflated after their sizes (u64),
    for each block: ids (u32), crc32 of the ids as u32 (u32), coded bytes (u32),
    the coded blocks, one after another.

Coding.  A block of ``BLOCK`` ids is coded on its own; every model starts
afresh.  For each id the order-2 and the order-1 context (the last two ids, the
last id) predict the id that followed them before, with a confidence of 0 to 3,
and order 0 offers the ids of the block by first use.  The coded symbol says
which prediction holds: 0 order 2, 1 order 1, 2 a new id, else the bit length of
the place among the ids used; place and new id follow as plain bits.  The
symbol's probability mixes the counts seen at this order-2 confidence, at this
order-1 confidence and without context, weighted by ``(order + 1)**2``; counts
that are few weigh little by themselves.  The mix is refreshed every ``EPOCH`` ids,
and counts are halved as they grow.  All blocks of a segment are coded side by
side, one numpy lane each.

Reading decodes every block, checks its crc32 and fails on a mismatch.

Null text counts as empty: its document is the end id alone.  Rows with equal doc_id
stand next to each other, in order of their text; a null doc_id comes first and
is kept; other columns are ignored; an empty table gives no segment and an
empty result.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symdex.llm import byte_pairs
from symdex.llm.common import shared_folder, ship_package, text_or_empty

BLOCK, EPOCH, MOST_LANES = 4096, 64, 2048
SYMBOLS, STATES = 16, 4
SLOTS = 4096
WEIGHTS = (1, 4, 9)
HALVE_AT = 512
#: A segment holds the ids of about so many bytes of text.
SEGMENT_BYTES = 8 << 20
NULL_ID = -(2**63)
MAGIC = b"TKS1"
FULL = np.uint64(0xFFFFFFFF)
WORD = np.uint64(16)


class _Model:
    """Context tables and mixed counts, one row a lane."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.tables = [np.zeros(lanes * SLOTS, np.int64), np.zeros(lanes * SLOTS, np.int64)]
        self.counts = [np.zeros((lanes, SYMBOLS), np.int32), np.zeros((lanes, STATES, SYMBOLS), np.int32), np.zeros((lanes, STATES, SYMBOLS), np.int32)]
        self.cumulated = np.zeros((lanes, STATES, STATES, SYMBOLS + 1), np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.last_but_one = np.zeros(lanes, np.int64)

    def refresh(self, n: int) -> None:
        c0, c1, c2 = (c[:n] for c in self.counts)
        full = np.flatnonzero(c0.sum(axis=1) >= HALVE_AT)
        for c in (c0, c1, c2):
            c[full] >>= 1
        mixed = 1 + WEIGHTS[0] * c0[:, None, None, :] + WEIGHTS[1] * c1[:, None, :, :] + WEIGHTS[2] * c2[:, :, None, :]
        np.cumsum(mixed, axis=3, out=self.cumulated[:n, :, :, 1:])

    def predict(self, n: int) -> None:
        a, b, lane = self.last[:n], self.last_but_one[:n], self.lane[:n]
        self.slot1 = lane * SLOTS + ((a * 0x9E3779B1 >> 11) & (SLOTS - 1))
        self.slot2 = lane * SLOTS + (((a * 0x85EBCA77 + b * 0xC2B2AE3D) >> 11) & (SLOTS - 1))
        e1, e2 = self.tables[0][self.slot1], self.tables[1][self.slot2]
        self.sure1, self.sure2 = e1 & 3, e2 & 3
        self.id1, self.id2 = (e1 >> 2) - 1, (e2 >> 2) - 1
        self.base = ((lane * STATES + self.sure2) * STATES + self.sure1) * (SYMBOLS + 1)

    def update(self, n: int, ids: np.ndarray, symbols: np.ndarray) -> None:
        lane = self.lane[:n]
        self.counts[0].reshape(-1)[lane * SYMBOLS + symbols] += 1
        self.counts[1].reshape(-1)[(lane * STATES + self.sure1) * SYMBOLS + symbols] += 1
        self.counts[2].reshape(-1)[(lane * STATES + self.sure2) * SYMBOLS + symbols] += 1
        entry = (ids + 1) << 2
        self.tables[0][self.slot1] = entry | np.where(ids == self.id1, np.minimum(self.sure1 + 1, 3), 1)
        self.tables[1][self.slot2] = entry | np.where(ids == self.id2, np.minimum(self.sure2 + 1, 3), 1)
        self.last_but_one[:n] = self.last[:n]
        self.last[:n] = ids


def _order0(blocks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every id: its order-0 symbol, the number that follows as plain bits, and that number's range."""
    lanes, steps = blocks.shape
    key = (np.arange(lanes)[:, None] << 32) | blocks
    flat = key.reshape(-1)
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    head = np.concatenate(([True], s[1:] != s[:-1]))
    first = np.empty(len(flat), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(flat)), 0))]
    new = first == np.arange(len(flat))
    place = np.cumsum(new.reshape(lanes, steps), axis=1).reshape(-1) - 1
    number = place[first] + 1
    bits = np.floor(np.log2(number)).astype(np.int64)
    symbol = np.where(new, 2, 3 + bits).reshape(lanes, steps)
    value = np.where(new, blocks.reshape(-1), number - (1 << bits)).reshape(lanes, steps)
    span = np.where(new, 1 << 16, 1 << bits).reshape(lanes, steps)
    return symbol, value, span


def encode_blocks(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(ids, crc32, coded bytes) of each block of ``ids``; ids of 65536 and more are refused."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 16:
        raise ValueError(f"ids from {ids.min()} to {ids.max()}: the coder takes 16 bits")
    n_blocks = -(-len(ids) // BLOCK)
    out = []
    for a in range(0, n_blocks, MOST_LANES):
        out.extend(_encode_lanes(ids[a * BLOCK : (a + MOST_LANES) * BLOCK]))
    return out


def _encode_lanes(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    lanes = -(-len(ids) // BLOCK)
    lengths = np.full(lanes, BLOCK)
    lengths[-1] = len(ids) - (lanes - 1) * BLOCK
    padded = np.zeros(lanes * BLOCK, np.int64)
    padded[: len(ids)] = ids
    blocks = padded.reshape(lanes, BLOCK)
    steps = int(lengths.max())
    order0, values, spans = (np.ascontiguousarray(x.T) for x in _order0(blocks, lengths))
    by_step = np.ascontiguousarray(blocks.T)
    model = _Model(lanes)
    cumulated = model.cumulated.reshape(-1)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, FULL)
    words = np.zeros((lanes, 2 * steps + 2), np.uint32)
    used = np.zeros(lanes, np.int64)
    for t in range(steps):
        n = lanes if t < lengths[-1] else lanes - 1
        if t % EPOCH == 0:
            model.refresh(n)
        x = by_step[t, :n]
        model.predict(n)
        symbols = np.where(x == model.id2, 0, np.where(x == model.id1, 1, order0[t, :n]))
        at = model.base + symbols
        start, end, total = cumulated[at], cumulated[at + 1], cumulated[model.base + SYMBOLS]
        unit = width[:n] // total.astype(np.uint64)
        low[:n] += unit * start.astype(np.uint64)
        width[:n] = unit * (end - start).astype(np.uint64)
        _emit(low, width, words, used, n)
        plain = symbols >= 2
        span = np.where(plain, spans[t, :n], 1).astype(np.uint64)
        width[:n] //= span
        low[:n] += width[:n] * np.where(plain, values[t, :n], 0).astype(np.uint64)
        _emit(low, width, words, used, n)
        model.update(n, x, symbols)
    rows = np.arange(lanes)
    for _ in range(2):
        words[rows, used] = low >> WORD
        low = (low & np.uint64(0xFFFF)) << WORD
        used += 1
    out = []
    for i in range(lanes):
        w = words[i, : used[i]]
        digits = int.from_bytes((w & 0xFFFF).astype(">u2").tobytes(), "big")
        carries = int.from_bytes((w >> 16).astype(">u2").tobytes(), "big") << 16
        size = 2 * len(w)
        coded = ((digits + carries) & ((1 << (8 * size)) - 1)).to_bytes(size, "big")
        own = blocks[i, : lengths[i]].astype("<u4").tobytes()
        out.append((int(lengths[i]), zlib.crc32(own), coded.rstrip(b"\0")))
    return out


def _emit(low: np.ndarray, width: np.ndarray, words: np.ndarray, used: np.ndarray, n: int) -> None:
    """Where the width falls under 16 bits, the top word of ``low`` goes out, with its carry."""
    at = np.flatnonzero(width[:n] < 65536)
    if len(at):
        now = low[at]
        words[at, used[at]] = now >> WORD
        used[at] += 1
        low[at] = (now & np.uint64(0xFFFF)) << WORD
        width[at] <<= WORD


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of all blocks, one after another; fails where a checksum differs."""
    parts = [_decode_lanes(blocks[a : a + MOST_LANES]) for a in range(0, len(blocks), MOST_LANES)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _decode_lanes(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    # lanes by falling length, so that those at work are always the first
    place = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    lanes, lengths = len(blocks), np.array([blocks[i][0] for i in place])
    steps = int(lengths[0])
    most = max(len(b[2]) for b in blocks) + 2 * 4 + 4
    most += most & 1
    raw = np.zeros((lanes, most), np.uint8)
    for row, i in enumerate(place):
        coded = blocks[i][2]
        raw[row, : len(coded)] = np.frombuffer(coded, np.uint8)
    words = raw.view(">u2").astype(np.uint64)
    n_words = words.shape[1]
    code = (words[:, 0] << WORD) | words[:, 1]
    used = np.full(lanes, 2)
    width = np.full(lanes, FULL)
    model = _Model(lanes)
    cumulated = model.cumulated.reshape(-1)
    out = np.zeros((steps, lanes), np.int64)
    seen = np.zeros((lanes, steps + 1), np.int64)
    n_seen = np.zeros(lanes, np.int64)
    rows = np.arange(lanes)
    columns = np.arange(1, SYMBOLS)

    def fill(n: int) -> None:
        at = np.flatnonzero(width[:n] < 65536)
        if len(at):
            nxt = used[at]
            code[at] = (code[at] << WORD) | words[at, np.minimum(nxt, n_words - 1)] * (nxt < n_words)
            used[at] += 1
            width[at] <<= WORD

    for t in range(steps):
        n = int(np.searchsorted(-lengths, -t, "left"))  # lanes with more than t ids
        if t % EPOCH == 0:
            model.refresh(n)
        model.predict(n)
        base = model.base
        total = cumulated[base + SYMBOLS]
        unit = width[:n] // total.astype(np.uint64)
        target = np.minimum((code[:n] // unit).astype(np.int64), total - 1)
        symbols = (cumulated[base[:, None] + columns] <= target[:, None]).sum(axis=1)
        start, end = cumulated[base + symbols], cumulated[base + symbols + 1]
        code[:n] -= unit * start.astype(np.uint64)
        width[:n] = unit * (end - start).astype(np.uint64)
        fill(n)
        bits = np.maximum(symbols - 3, 0)
        span = np.where(symbols == 2, 1 << 16, np.where(symbols > 2, 1 << bits, 1))
        width[:n] //= span.astype(np.uint64)
        value = np.minimum((code[:n] // width[:n]).astype(np.int64), span - 1)
        code[:n] -= width[:n] * value.astype(np.uint64)
        fill(n)
        lane = rows[:n]
        # past the end only in a damaged block, which its checksum tells
        known = seen[lane, np.where(symbols > 2, np.minimum((1 << bits) + value - 1, steps), 0)]
        x = np.where(symbols == 0, model.id2, np.where(symbols == 1, model.id1, np.where(symbols == 2, value, known)))
        fresh = np.flatnonzero(symbols == 2)
        seen[fresh, np.minimum(n_seen[fresh], steps)] = value[fresh]
        n_seen[fresh] += 1
        out[t, :n] = x
        model.update(n, x, symbols)
    by_lane = np.ascontiguousarray(out.T)
    parts: list[np.ndarray] = [np.zeros(0, np.int64)] * lanes
    for row, i in enumerate(place):
        own = by_lane[row, : lengths[row]]
        if zlib.crc32(own.astype("<u4").tobytes()) != blocks[i][1]:
            raise ValueError("a block's checksum differs from its ids")
        parts[i] = own
    return np.concatenate(parts)


def pack_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = encode_blocks(ids)
    names, sizes = zlib.compress(doc_ids.astype("<i8").tobytes(), 1), zlib.compress(lengths.astype("<u4").tobytes(), 1)
    head = MAGIC + struct.pack("<5Q", len(doc_ids), len(ids), len(blocks), len(names), len(sizes))
    return b"".join([head, names, sizes, *[struct.pack("<3I", n, crc, len(coded)) for n, crc, coded in blocks], *[coded for *_, coded in blocks]])


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, lengths and ids of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_ids, n_blocks, n_names, n_sizes = struct.unpack_from("<5Q", data, 4)
    at = 44
    doc_ids = np.frombuffer(zlib.decompress(data[at : at + n_names]), "<i8")
    at += n_names
    lengths = np.frombuffer(zlib.decompress(data[at : at + n_sizes]), "<u4").astype(np.int64)
    at += n_sizes
    table = [struct.unpack_from("<3I", data, at + 12 * i) for i in range(n_blocks)]
    at += 12 * n_blocks
    blocks = []
    for n, crc, size in table:
        blocks.append((n, crc, data[at : at + size]))
        at += size
    ids = decode_blocks(blocks)
    if len(doc_ids) != n_docs or len(ids) != n_ids or lengths.sum() != n_ids:
        raise ValueError("a token segment is cut short")
    return doc_ids, lengths, ids


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(name)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def tokenized(texts: list[str], name: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids by the tokenizers library with ``end_id`` after each text, and how many each text has.

    The library encodes each distinct piece between safe boundaries once.
    """
    tokenizer, v = _tokenizer(name), byte_pairs.vocabulary(name)
    codes = byte_pairs._Codes()
    by_text = [byte_pairs._pieces(t, v, codes) for t in texts]
    plain = [" " + k if isinstance(k, str) else k[0] or k[1] if not isinstance(k[0], int) else "" for k in codes]
    found = tokenizer.encode_batch_fast(plain, add_special_tokens=False)
    per_piece = [[k[0]] if isinstance(k, tuple) and isinstance(k[0], int) else e.ids for k, e in zip(codes, found, strict=True)]
    per_piece.append([end_id])
    sizes = np.array([len(p) for p in per_piece], np.int64)
    flat = np.fromiter(chain.from_iterable(per_piece), np.int32, int(sizes.sum()))
    end = len(per_piece) - 1
    for p in by_text:
        p.append(end)
    n = np.array([len(p) for p in by_text], np.int64)
    rows = np.fromiter(chain.from_iterable(by_text), np.int64, int(n.sum()))
    lengths = np.add.reduceat(sizes[rows], np.cumsum(n) - n)
    return byte_pairs.ragged(flat, np.cumsum(sizes) - sizes, sizes, rows), lengths


def write_tokens(docs: DataFrame, path: str, tokenizer_name: str = "byte_bpe_50k.json", end_id: int = 2) -> None:
    """Write token files of ``docs`` in ascending doc_id order to ``path``, on a store that Spark writes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        for segment, (doc_ids, texts) in enumerate(byte_pairs.grouped(batches, SEGMENT_BYTES)):
            ids, lengths = tokenized(texts, tokenizer_name, end_id)
            data = pack_segment(np.array([NULL_ID if d is None else d for d in doc_ids], np.int64), lengths, ids)
            yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int64()), "segment": pa.array([segment], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})

    rows = text_or_empty(docs)
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(run, "file long, segment long, n_ids long, data binary").write.option("compression", "none").parquet(path)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *unpack_segment(batch.column(2)[i].as_py())


def _starts(files: DataFrame) -> DataFrame:
    """How many ids stand before each segment."""
    inside = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("file").agg(F.sum("n_ids").alias("n_file")).withColumn("before_file", F.coalesce(F.sum("n_file").over(ahead), F.lit(0)))
    rows = files.select("file", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before"))
    return rows.join(totals, "file").select("file", "segment", (F.col("before") + F.col("before_file")).alias("segment_start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, segment, place (in the segment) and ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, segment, doc_ids, lengths, ids in _segments(batches):
            ends = np.concatenate(([0], np.cumsum(lengths)))
            for a, b in byte_pairs.cuts(lengths, 4):
                lists = pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), pa.array(ids[ends[a] : ends[b]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64(), mask=doc_ids[a:b] == NULL_ID), pa.array(np.full(b - a, file)), pa.array(np.full(b - a, segment)), pa.array(np.arange(a, b)), lists], ["doc_id", "file", "segment", "place", "ids"])

    ship_package(spark)
    return spark.read.parquet(path).select("file", "segment", "data").mapInArrow(run, "doc_id long, file long, segment long, place long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and crc32 of the ids, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, segment, doc_ids, lengths, ids in _segments(batches):
            ends = np.concatenate(([0], np.cumsum(lengths)))
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), pa.array(np.full(n, file)), pa.array(np.full(n, segment)), pa.array(ends[:-1]), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "file", "segment", "offset", "n_tokens", "ids_crc32"])

    ship_package(spark)
    files = spark.read.parquet(path)
    rows = files.select("file", "segment", "data").mapInArrow(run, "doc_id long, file long, segment long, offset long, n_tokens long, ids_crc32 long")
    rows = rows.join(_starts(files.select("file", "segment", "n_ids")), ["file", "segment"])
    return rows.select("doc_id", (F.col("segment_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, tokenizer_name: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read every document's digest back from them."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_name, end_id)
    return read_digests(spark, path)
