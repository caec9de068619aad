"""Language-model scores by Katz backoff with Good-Turing discounts.

The model is learned from the training documents, all those whose
``crc32(doc_id as text) mod 7`` is not 2.  Tokens are the words of a text, A-Z lowered, and one end.
The probability of a token is found recursively:

* after its predecessor (or the start), if the pair was seen ``c`` times in training:
  ``d2(c) * c / c(predecessor)``;
* else ``alpha(predecessor)`` times the probability of the token alone, where
  ``alpha = (1 - sum of the seen pairs' probabilities) / (1 - sum of the seen tokens' own probabilities)``,
  so that all tokens after a predecessor sum to exactly 1; 1 after an unknown word;
* alone: ``d1(c) * c / N``, and what the discounts leave for an unknown word.

``d(c)`` is Katz's Good-Turing discount for ``c`` up to ``K`` and ``LARGE`` above it, which keeps a
little for the unseen after contexts with large counts only.

The tables lie in partitions by hash: words by their digest, pairs by their
predecessor, and those of a very frequent predecessor by their token too, whose sums
are then added up (at most ``2 * partitions`` predecessors can be that frequent).  A chunk
of documents counts its own distinct words and pairs first and sends each to
its partition once, as packed sorted arrays; the partition sends back the
totals in the same order.  Words get dense numbers, so pairs are exact and small.

Null text counts as empty (the end alone); a null doc_id counts as the empty
text for crc32; equal rows count each; other columns are ignored; an empty table
gives an empty result; without training tokens every word is unknown.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.llm.common import shared_folder, text_or_empty, written
from symdex.llm.words import mixed, rows_of, word_hashes

FOLDS, HELD_OUT = 7, 2
K, LARGE = 5, 0.999
CHUNK_BYTES = 8 << 20
NULL_ID = -(2**63)
END = np.uint64(0x51A7_0E4D_E11D_0C57)
#: A predecessor is frequent from this share of a partition's tokens on.
FREQUENT = 0.5


def packed(values: np.ndarray) -> bytes:
    """An array as its byte planes, compressed: the high bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def packed_sorted(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=values.dtype.type(0)))


def unpacked_sorted(data: bytes, kind) -> np.ndarray:
    return np.cumsum(unpacked(data, kind), dtype=kind)


def held_out(doc_ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d == NULL_ID else str(d).encode()) % FOLDS == HELD_OUT for d in doc_ids.tolist()], bool)


def good_turing(n: list[int]) -> np.ndarray:
    """Discount factors of counts 0 to ``K`` and above, from how many things were seen 1 to ``K + 1`` times."""
    d = np.full(K + 2, LARGE)
    d[0] = 0.0
    absolute = min(0.95, n[0] / (n[0] + 2 * n[1])) if n[0] else 0.5
    tail = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        katz = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if n[r - 1] and tail < 1 else 0.0
        d[r] = katz if 0.0 < katz < 1.0 else (r - absolute) / r
    return d


class Alone:
    """Probabilities of words by their counts."""

    def __init__(self, total: int, distinct: int, n: list[int]):
        self.total, self.distinct = total, distinct
        self.discounts = good_turing(n)
        kept = sum(self.discounts[r] * r * n[r - 1] for r in range(1, K + 1)) + LARGE * (total - sum(r * n[r - 1] for r in range(1, K + 1)))
        self.unknown = 1.0 - kept / total if total else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, self.discounts[np.minimum(counts, K + 1)] * counts / self.total, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.distinct + 1))


def text_chunks(docs: DataFrame) -> DataFrame:
    """One row for about ``CHUNK_BYTES`` of texts: chunk, doc ids, lengths and the compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=3)
        for k, (ids, texts) in enumerate(rows_of(batches, CHUNK_BYTES)):
            names = np.array([NULL_ID if d is None else d for d in ids], np.int64)
            columns = [[first + k], [names.tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [packer.compress(b"".join(texts))]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["chunk", "names", "lengths", "texts"])

    return text_or_empty(docs).mapInArrow(run, "chunk long, names binary, lengths binary, texts binary")


class Chunk:
    """The tokens of a chunk: distinct digests in order, and each token's place among them."""

    def __init__(self, names: bytes, lengths: bytes, texts: bytes):
        self.names = np.frombuffer(names, np.int64)
        sizes = np.frombuffer(lengths, np.int64)
        data = zstandard.ZstdDecompressor().decompress(texts)
        ends = np.cumsum(sizes)
        words, n = word_hashes([data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)])
        self.n = n + 1
        last = np.cumsum(self.n) - 1
        tokens = np.empty(int(self.n.sum()), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[last] = True
        tokens[is_end], tokens[~is_end] = END, words
        self.starts = last - n
        self.held = held_out(self.names)
        self.training = np.repeat(~self.held, self.n)
        self.digests, self.at = np.unique(tokens, return_inverse=True)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.at[self.training], minlength=len(self.digests))

    def number(self, replies: list[dict], offsets: np.ndarray, distinct: int) -> None:
        """Total counts and numbers of the distinct words, from the partitions' replies; an unknown word has number ``distinct``."""
        counts, numbers = [], []
        for r in sorted(replies, key=lambda r: r["part"]):
            counts.append(unpacked(r["totals"], np.int64))
            ranks = unpacked(r["ranks"], np.int64)
            numbers.append(np.where(counts[-1] > 0, ranks + offsets[r["part"]], distinct))
        self.counts, self.numbers = np.concatenate(counts), np.concatenate(numbers)

    def pair(self, distinct: int, n_start: int, parts: int, total: int) -> None:
        """Distinct pairs after known predecessors, by partition and key, and each token's place among them (-1: no known predecessor)."""
        number, count = self.numbers[self.at], self.counts[self.at]
        before = np.concatenate(([0], number[:-1]))
        n_before = np.concatenate(([0], count[:-1]))
        before[self.starts], n_before[self.starts] = distinct + 1, n_start
        self.n_before = n_before
        some = n_before > 0
        keys, place = np.unique(before[some] * (distinct + 2) + number[some], return_inverse=True)
        first = np.empty(len(keys), np.int64)
        first[place] = np.flatnonzero(some)
        self.pair_after = count[first]
        self.pair_context = keys // (distinct + 2)
        self.pair_n = n_before[first]
        self.frequent = self.pair_n * parts > FREQUENT * total
        spread = np.where(self.frequent, keys, self.pair_context).astype(np.uint64)
        part = ((mixed(spread + np.uint64(1)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.pair_keys, self.pair_part = keys[order], part[order]
        self.pair_after, self.pair_context, self.pair_n, self.frequent = (x[order] for x in (self.pair_after, self.pair_context, self.pair_n, self.frequent))
        self.pair_at = np.full(len(number), -1)
        self.pair_at[some] = back[place]
        self.pair_counts = np.bincount(self.pair_at[some & self.training], minlength=len(keys))


def _slices(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(part[a]), a, b


WORDS_SENT = "part int, chunk long, words binary, counts binary"
WORDS_BACK = "part int, chunk long, totals binary, ranks binary, figures array<long>"
PAIRS_SENT = "part int, chunk long, pairs binary, counts binary, after binary"
PAIRS_BACK = "part int, chunk long, totals binary, seen binary, mass binary, figures array<long>, contexts binary"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each partition, which stand together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["part"] != row["part"]:
                yield held[0]["part"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["part"], held


def _send_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["names"], row["lengths"], row["texts"])
                counts = chunk.word_counts()
                part = ((chunk.digests >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                yield _batch(WORDS_SENT, [(p, row["chunk"], packed_sorted(chunk.digests[a:b]), packed(counts[a:b])) for p, a, b in _slices(part)])

    return run


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _by_part(batches):
        words = [unpacked_sorted(r["words"], np.uint64) for r in rows]
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, at, np.concatenate([unpacked(r["counts"], np.int64) for r in rows]))
        ranks = np.cumsum(totals > 0) - 1
        start = 0
        for r, own in zip(rows, words, strict=True):
            mine = at[start : start + len(own)]
            start += len(own)
            yield _batch(WORDS_BACK, [(part, r["chunk"], packed(totals[mine]), packed(ranks[mine]), None)])
        n = np.bincount(np.minimum(totals, K + 2), minlength=K + 3)
        yield _batch(WORDS_BACK, [(part, None, None, None, [int(totals.sum()), int((totals > 0).sum()), *n[1 : K + 2].tolist()])])


def _send_pairs(parts: int, offsets: np.ndarray, alone: Alone, n_start: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["names"], row["lengths"], row["texts"])
                chunk.number(row["words"], offsets, alone.distinct)
                chunk.pair(alone.distinct, n_start, parts, alone.total)
                out = [(p, row["chunk"], packed_sorted(chunk.pair_keys[a:b]), packed(chunk.pair_counts[a:b]), packed(chunk.pair_after[a:b])) for p, a, b in _slices(chunk.pair_part)]
                if out:
                    yield _batch(PAIRS_SENT, out)

    return run


def _merge_pairs(alone: Alone, frequent: np.ndarray):
    """Totals of the pairs back to their chunks, and of each predecessor that a chunk has an unseen pair of: how many pairs it
    has 1 to K times, and the sum of the own probabilities of what follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            keys = [unpacked_sorted(r["pairs"], np.int64) for r in rows]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            totals, after = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            np.add.at(totals, at, np.concatenate([unpacked(r["counts"], np.int64) for r in rows]))
            after[at] = np.concatenate([unpacked(r["after"], np.int64) for r in rows])
            context = distinct // (alone.distinct + 2)
            heads = np.flatnonzero(np.diff(context, prepend=-1))
            own = np.cumsum(np.diff(context, prepend=-1) != 0) - 1
            seen = np.stack([np.add.reduceat((totals == r).astype(np.int64), heads) for r in range(1, K + 1)], axis=1)
            mass = np.add.reduceat(np.where(totals > 0, alone.probability(after), 0.0), heads)
            start = 0
            for r, k in zip(rows, keys, strict=True):
                mine = at[start : start + len(k)]
                start += len(k)
                asked = np.unique(own[mine[totals[mine] == 0]])
                yield _batch(PAIRS_BACK, [(part, r["chunk"], packed(totals[mine]), packed(seen[asked].reshape(-1)), packed(mass[asked]), None, None)])
            n = np.bincount(np.minimum(totals, K + 2), minlength=K + 3)
            split = np.flatnonzero(np.isin(context[heads], frequent))
            yield _batch(PAIRS_BACK, [(part, None, None, packed(seen[split].reshape(-1)), packed(mass[split]), n[1 : K + 2].tolist(), packed(context[heads][split]))])

    return run


def _score(parts: int, offsets: np.ndarray, alone: Alone, n_start: int, discounts: np.ndarray, frequent: dict[int, tuple[np.ndarray, float]]):
    def alphas(seen: np.ndarray, mass: np.ndarray, n: np.ndarray) -> np.ndarray:
        r = np.arange(1, K + 1)
        left = ((1 - discounts[1 : K + 1]) * r * seen).sum(axis=1) + (1 - LARGE) * (n - (r * seen).sum(axis=1))
        return left / n / (1.0 - mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["names"], row["lengths"], row["texts"])
                chunk.number(row["words"], offsets, alone.distinct)
                chunk.pair(alone.distinct, n_start, parts, alone.total)
                totals, alpha = np.zeros(len(chunk.pair_keys), np.int64), np.ones(len(chunk.pair_keys))
                replies = {r["part"]: r for r in row["pairs"] or []}
                for p, a, b in _slices(chunk.pair_part):
                    r = replies[p]
                    totals[a:b] = unpacked(r["totals"], np.int64)
                    unseen = a + np.flatnonzero(totals[a:b] == 0)
                    if not len(unseen):
                        continue
                    seen, mass = unpacked(r["seen"], np.int64).reshape(-1, K), unpacked(r["mass"], np.float64)
                    contexts, at = np.unique(chunk.pair_context[unseen], return_inverse=True)
                    n = np.zeros(len(contexts), np.int64)
                    n[at] = chunk.pair_n[unseen]
                    seen, mass = seen.copy(), mass.copy()
                    for i, c in enumerate(contexts.tolist()):
                        if c in frequent:
                            seen[i], mass[i] = frequent[c]
                    alpha[unseen] = alphas(seen, mass, n)[at]
                counts = chunk.counts[chunk.at]
                p = alone.probability(counts)
                known = chunk.pair_at >= 0
                pairs = chunk.pair_at[known]
                direct = discounts[np.minimum(totals[pairs], K + 1)] * totals[pairs] / np.maximum(chunk.n_before[known], 1)
                p[known] = np.where(totals[pairs] > 0, direct, alpha[pairs] * p[known])
                sums = [np.add.reduceat(x, chunk.starts) for x in (np.log10(p), alone.base(counts), (counts > 0).astype(np.int64))]
                names = chunk.names
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64(), mask=names == NULL_ID), pa.array(chunk.held), pa.array(chunk.n), pa.array(sums[2]), pa.array(np.full(len(names), alone.total)), pa.array(sums[1]), pa.array(sums[0])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def scores(docs: DataFrame) -> DataFrame:
    """Every document's log10 probability under the model, and under add-one unigrams."""
    spark = docs.sparkSession
    shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = written(text_chunks(docs), "katz-texts", "none")
    sent = chunks.mapInArrow(_send_words(parts), WORDS_SENT)
    back = written(sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge_words, WORDS_BACK), "katz-words", "none")
    figures = {r.part: r.figures for r in back.where("chunk is null").select("part", "figures").collect()}  # one row a partition
    offsets, at = np.zeros(parts, np.int64), 0
    for part in sorted(figures):
        offsets[part] = at
        at += figures[part][1]
    sums = [sum(f[i] for f in figures.values()) for i in range(K + 3)]
    alone = Alone(sums[0], sums[1], sums[2:])
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("i"))
    n_start = ids.where(F.crc32(F.encode("i", "UTF-8")) % FOLDS != HELD_OUT).count()
    words = back.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("part", "totals", "ranks")).alias("words"))
    sent = chunks.join(words, "chunk").mapInArrow(_send_pairs(parts, offsets, alone, n_start), PAIRS_SENT)
    # words above the limit are few: their counts sum to at most all tokens
    limit = FREQUENT * alone.total / parts

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts, ranks = unpacked(r["totals"], np.int64), unpacked(r["ranks"], np.int64)
                some = np.unique(ranks[counts > limit]) + offsets[r["part"]]
                yield pa.RecordBatch.from_arrays([pa.array(some)], ["number"])

    found = back.where("chunk is not null").mapInArrow(often, "number long").distinct().collect()
    frequent = np.array(sorted([r.number for r in found] + [alone.distinct + 1] * (n_start > limit)), np.int64)
    pairs = written(sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge_pairs(alone, frequent), PAIRS_BACK), "katz-pairs", "none")
    n = [0] * (K + 1)
    split: dict[int, tuple[np.ndarray, float]] = {}
    for r in pairs.where("chunk is null").select("figures", "contexts", "seen", "mass").toLocalIterator():  # one row a partition
        n = [a + b for a, b in zip(n, r.figures, strict=True)]
        for c, s, m in zip(unpacked(r.contexts, np.int64).tolist(), unpacked(r.seen, np.int64).reshape(-1, K), unpacked(r.mass, np.float64).tolist(), strict=True):
            before = split.get(c, (np.zeros(K, np.int64), 0.0))
            split[c] = (before[0] + s, before[1] + m)
    replies = pairs.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("part", "totals", "seen", "mass")).alias("pairs"))
    rows = chunks.join(words, "chunk").join(replies, "chunk", "left")
    return rows.mapInArrow(_score(parts, offsets, alone, n_start, good_turing(n), split), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
