"""Ranked lexical search: an impact index in shards, searched by Block-Max MaxScore.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII,
A-Z lowered.  With N documents that hold a term, L terms in all, n in the document
and df documents that hold the term, a term weighs ``w = floor(1000 * ln((2N+2)/(2df+1)))``, a document
has ``m = 25 + (75*n*N) div L``, and an occurrence count tf has the impact
``(10**9 * tf) div (1000*tf + 8*m)``; a document's score is the sum of w * impact over the
query's terms, repeats included.

Index.  Each map task turns its documents into shards of at most ``SHARD_DOCS``
documents or about ``SHARD_BYTES`` of text.  A shard holds a posting list for every
term that some query has: blocks of ``BLOCK`` postings, gaps and counts packed
in as many bits as they need, and outside the packed bytes each block's last
document and its competitive pairs (count, length), those that no other posting of the block beats in both.
The pairs give a block's greatest impact once N and L are known.  Terms that no query has are
left out early by a bit table of fixed size over term hashes.

Search.  Shards and blocks of queries meet in groups of bounded size.  For a query its lists are
sorted by their bounds (w times the list's greatest impact).  While the bounds of the lists not yet
read could lift an unseen document to the threshold - the least score of the best k
so far - the next list is essential: all of it is read and the threshold raised.  The lists that
are left are not essential: they are only looked up for documents already met, and a
document goes before any block is unpacked if its score, the greatest impact of the block it would stand in and
the bounds of later lists stay below the threshold.  What ties with the threshold is kept.
The shards of a group are searched as one; Spark merges the groups' heaps.

Results: for each row of ``queries`` (equal rows count once) its ``k`` best documents with
a score above 0, equal scores by ascending doc_id, a null doc_id last; rows of equal doc_id
are documents of their own.  Null and empty texts hold no term, as documents and as queries; a query without terms has
no rows; empty tables give an empty result; other columns are ignored.  A text is indexed whole,
in slices, however long.  Terms are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symdex.llm.bits import bit_table
from symdex.llm.common import ship_package, text_or_empty, written
from symdex.llm.words import BASE, GROUP_BYTES, INVERSE, ODD, mixed, powers, rows_of, sliced

BLOCK = 128
SHARD_DOCS, SHARD_BYTES = 1 << 14, 32 << 20
#: Queries of a block, and documents of a group of shards, on average.
QUERIES, GROUP_DOCS = 256, 1 << 14
#: A term's lists meet the queries' terms in so many groups.
SALTS = 32
BITS = 24
NULL_ID = 2**63 - 1

#: Fixed by the definition of a term: bytes of UTF-8 that are not in ``\\x00-\\x2F \\x3A-\\x40 \\x5B-\\x60 \\x7B-\\x7F``.
_TERM = np.ones(256, bool)
_TERM[:0x30] = _TERM[0x3A:0x41] = _TERM[0x5B:0x61] = _TERM[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _stretches(text: bytes) -> Iterator[bytes]:
    """The text in stretches of about ``GROUP_BYTES`` that end where a term ends."""
    at = 0
    while len(text) - at > GROUP_BYTES:
        end = at + GROUP_BYTES
        while end < len(text) and _TERM[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, one after another, and how many each text has."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    joined, owners, size = [], [], 0

    def flush() -> None:
        nonlocal joined, owners, size
        if joined:
            buf = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
            edge = np.flatnonzero(np.diff(np.concatenate(([False], _TERM[buf])).view(np.int8)))
            starts, ends = edge[0::2], edge[1::2]
            sums = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf)), out=sums[1:])
            h = (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]
            hashes.append(mixed(h ^ ((ends - starts).astype(np.uint64) * np.uint64(ODD[3]))))
            places = np.cumsum([len(t) + 1 for t in joined])
            np.add.at(counts, owners, np.diff(np.concatenate(([0], np.searchsorted(starts, places)))))
        joined, owners, size = [], [], 0

    for i, text in enumerate(texts):
        for part in _stretches(text):
            if size + len(part) > GROUP_BYTES:
                flush()
            joined.append(part)
            owners.append(i)
            size += len(part) + 1
    flush()
    return np.concatenate(hashes), counts


def _counted(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, term, times) of each different term of each text, by owner and term."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])))) if len(o) else np.zeros(0, np.int64)
    return o[first], h[first], np.diff(np.concatenate((first, [len(o)])))


# --- posting lists -------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """A width in bits, then the values in so many bits each."""
    width = int(values.max(initial=0)).bit_length()
    bits = (values[:, None] >> np.arange(width)) & 1
    return bytes([width]) + np.packbits(bits.astype(np.uint8)).tobytes()


def _unpacked(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = data[at]
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at + 1))[: n * width].reshape(n, width)
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64)), at + 1 + size


def posting_list(docs: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> bytes:
    """Ascending documents of a shard, their counts, and their lengths as terms, as one packed list."""
    lasts, offsets, pairs, body, previous = [], [0], [], [], -1
    for at in range(0, len(docs), BLOCK):
        d, t, n = docs[at : at + BLOCK], times[at : at + BLOCK], lengths[at : at + BLOCK]
        body.append(_packed(np.diff(d, prepend=previous) - 1) + _packed(t - 1))
        previous = int(d[-1])
        lasts.append(previous)
        offsets.append(offsets[-1] + len(body[-1]))
        order = np.lexsort((n, -t))
        shortest = np.minimum.accumulate(n[order])
        best = order[np.concatenate(([True], shortest[1:] < shortest[:-1]))]
        pairs.append(np.stack((t[best], n[best]), axis=1))
    n_pairs = [len(p) for p in pairs]
    head = struct.pack("<II", len(docs), len(lasts))
    return b"".join([head, *(np.array(a, t).tobytes() for a, t in ((lasts, "<u4"), (offsets, "<u4"), (n_pairs, "<u4"))), np.concatenate(pairs).astype("<i8").tobytes(), *body])


class PostingList:
    """The lists of a term in some shards as one, with the greatest impact of each block; a block is unpacked when first asked for.

    ``parts`` holds the shards' packed lists and the number of documents before each.
    """

    def __init__(self, parts: list[tuple[int, bytes]], impact, impacts_of_docs):
        self._impacts, self._where = impacts_of_docs, []
        lasts, pairs, n_pairs = [], [], []
        for before, data in parts:
            n, blocks = struct.unpack_from("<II", data)
            at = 8 + 12 * blocks + 4
            own = np.frombuffer(data, "<u4", 3 * blocks + 1, 8)
            lasts.append(own[:blocks].astype(np.int64) + before)
            n_pairs.append(own[2 * blocks + 1 :].astype(np.int64))
            pairs.append(np.frombuffer(data, "<i8", 2 * int(n_pairs[-1].sum()), at).reshape(-1, 2))
            at += 16 * len(pairs[-1])
            offsets = own[blocks : 2 * blocks].tolist()
            firsts = [before - 1, *lasts[-1][:-1].tolist()]
            self._where += [(data, at + offsets[b], min(BLOCK, n - b * BLOCK), firsts[b]) for b in range(blocks)]
        self.last, all_pairs, n_pairs = np.concatenate(lasts), np.concatenate(pairs), np.concatenate(n_pairs)
        self.block_best = np.maximum.reduceat(impact(all_pairs[:, 0], all_pairs[:, 1]), np.cumsum(n_pairs) - n_pairs)
        self.best = int(self.block_best.max())
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._whole: tuple[np.ndarray, np.ndarray] | None = None

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self._blocks:
            data, at, n, before = self._where[b]
            gaps, at = _unpacked(data, at, n)
            times, _ = _unpacked(data, at, n)
            docs = np.cumsum(gaps + 1) + before
            self._blocks[b] = docs, self._impacts(docs, times + 1)
        return self._blocks[b]

    def some(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the postings of some blocks."""
        if self._whole is not None:
            return self._whole
        parts = [self._block(b) for b in blocks.tolist()]
        out = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if len(parts) == len(self.last):
            self._whole, self._blocks = out, {}
        return out

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return self.some(np.arange(len(self.last)))


class Shard:
    """Documents (ids, lengths in terms) and the posting lists of their terms, with N and L of the whole table."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, lists: dict[int, list[tuple[int, bytes]]], n_docs: int, n_terms: int):
        self.ids, self.n_docs, self.n_terms = ids, n_docs, max(n_terms, 1)
        self._m = self._length_factor(lengths)
        self.lists = {term: PostingList(parts, self._impact_of_length, lambda docs, times: self._impact(times, self._m[docs])) for term, parts in lists.items()}

    def _length_factor(self, n: np.ndarray) -> np.ndarray:
        if 75 * int(n.max(initial=0)) * self.n_docs < 2**63:
            return 25 + (75 * n * self.n_docs) // self.n_terms
        return np.array([25 + 75 * int(x) * self.n_docs // self.n_terms for x in n], np.int64)

    @staticmethod
    def _impact(times: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * times) // (1000 * times + 8 * m)

    def _impact_of_length(self, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self._impact(times, self._length_factor(lengths))


def best_of_shard(shard: Shard, weights: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, blocks looked at) of a shard that may be among the best ``k``; all that tie with the k-th are returned."""
    lists = sorted(((w * shard.lists[t].best, t) for t, w in weights.items() if t in shard.lists), reverse=True)
    bounds = np.array([b for b, _ in lists], np.int64)
    later = np.concatenate((np.cumsum(bounds[::-1])[::-1], [0])).astype(np.int64)  # bounds from each list on
    threshold, scores, unpacked = 1, np.zeros(len(shard.ids), np.int64), 0
    none = np.zeros(0, np.int64)

    def raised(some: np.ndarray) -> int:
        return threshold if len(some) < k else max(threshold, int(np.partition(some, len(some) - k)[len(some) - k]))

    # essential lists: unseen documents could still reach the threshold
    i = 0
    while i < len(lists) and later[i] >= threshold:
        term = lists[i][1]
        docs, impacts = shard.lists[term].whole()
        unpacked += len(shard.lists[term].last)
        scores[docs] += weights[term] * impacts
        i += 1
        if i < len(lists):
            threshold = raised(scores[scores > 0])
    if i == 0:
        return none, none, 0
    docs = np.flatnonzero((scores > 0) & (scores + later[i] >= threshold))
    own = scores[docs]
    # the others: looked up for the documents met so far, after their blocks' greatest impacts
    for j in range(i, len(lists)):
        term = lists[j][1]
        postings, w = shard.lists[term], weights[term]
        block = np.searchsorted(postings.last, docs)
        gain = w * np.append(postings.block_best, 0)[block]
        stays = own + gain + later[j + 1] >= threshold
        docs, own, block = docs[stays], own[stays], block[stays]
        wanted = np.unique(block[block < len(postings.last)])
        if len(wanted):
            at, impacts = postings.some(wanted)
            unpacked += len(wanted)
            place = np.minimum(np.searchsorted(at, docs), len(at) - 1)
            own = own + np.where(at[place] == docs, w * impacts[place], 0)
        threshold = raised(own)
    stays = own >= threshold
    return docs[stays], own[stays], unpacked


# --- Spark ---------------------------------------------------------------------


def _query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, item: hash of the text, term, times) of the different rows of ``queries``."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 64):
            owner, term, times = _counted(*term_hashes(part.column(2).cast(pa.binary()).to_pylist()))
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(term.view(np.int64)), pa.array(times)], names=["item_id", "item", "term", "times"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text).alias("item"), text.alias("text")).distinct()
    return rows.mapInArrow(terms, "item_id long, item long, term long, times long")


def _index(documents: DataFrame, bits: bytes) -> DataFrame:
    """(shard, term, n, data): posting lists, and per shard a row without term: n documents with terms, their ids and lengths."""
    mask = np.uint64((1 << BITS) - 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits, np.uint8)
        shard = TaskContext.get().partitionId() << 32
        ids, lengths, size, found = [], [], 0, []

        def rows() -> Iterator[pa.RecordBatch]:
            n = np.concatenate(lengths)
            doc, term, times = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, term))
            doc, term, times = doc[order], term[order], times[order]
            starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            own = np.array([NULL_ID if i is None else i for i in ids], "<i8")
            null = np.array([i is None for i in ids], np.uint8)
            head = np.concatenate((own, n)).astype("<i8").tobytes() + null.tobytes()
            out = [(shard, None, int((n > 0).sum()), int(n.sum()), len(ids), head)]
            for a, b in pairwise([*starts, len(term)]):
                out.append((shard, int(term[a].view(np.int64)), int(b - a), 0, 0, posting_list(doc[a:b], times[a:b], n[doc[a:b]])))
                if len(out) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        names = ["shard", "term", "n", "terms", "docs", "data"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for more_ids, texts in rows_of(batches, 4 << 20):
            hashes, counts = term_hashes(texts)
            at = hashes & mask
            wanted = (table[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0
            owner = np.repeat(np.arange(len(counts)), counts)[wanted]
            own, term, times = _counted(hashes[wanted], np.bincount(owner, minlength=len(counts)))
            found.append((own + len(ids), term, times))
            ids += more_ids
            lengths.append(counts)
            size += sum(map(len, texts))
            if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                yield from rows()
                shard += 1
                ids, lengths, size, found = [], [], 0, []
        if ids:
            yield from rows()

    return text_or_empty(documents).mapInArrow(build, "shard long, term long, n long, terms long, docs long, data binary")


def search(documents: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every row of ``queries``."""
    ship_package(documents.sparkSession)
    asked = written(_query_terms(queries), "query-terms")
    index = written(_index(documents, np.packbits(bit_table(asked, "term", BITS)).tobytes()), "postings")
    shards, lists = index.where(F.col("term").isNull()), index.where(F.col("term").isNotNull())
    n_docs, n_terms, n_rows = (int(x or 0) for x in shards.agg(F.sum("n"), F.sum("terms"), F.sum("docs")).first())
    n_queries = asked.select("item_id", "item").distinct().count()
    groups, blocks = (max(1, math.ceil(n / size)) for n, size in ((n_rows, GROUP_DOCS), (n_queries, QUERIES)))

    # the terms' weights; a term that all documents hold weighs nothing
    held = lists.groupBy("term").agg(F.sum("n").alias("df")).join(asked.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = written(
        asked.join(held, "term").select("item_id", "item", "term", (F.col("times") * weight).alias("weight"), F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)).cast("int").alias("block")).where("weight > 0"),
        "query-weights",
    )

    def each(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # queries, shards and lists that meet: every block of queries goes to every group of shards, with the lists it asks for
    group = F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int")
    no_long, no_data = F.lit(None).cast("long"), F.lit(None).cast("binary")
    parts = [
        weighed.select("block", each(groups).alias("group"), F.lit(0).alias("kind"), no_long.alias("shard"), "item_id", "item", "term", "weight", no_data.alias("data")),
        shards.select(each(blocks).alias("block"), group.alias("group"), F.lit(1).alias("kind"), "shard", no_long.alias("item_id"), no_long.alias("item"), "term", F.col("docs").alias("weight"), "data"),
        lists.withColumn("salt", F.pmod(F.col("shard"), F.lit(SALTS)).cast("int"))
        .join(weighed.select("block", "term").distinct().withColumn("salt", each(SALTS)), ["term", "salt"])
        .select("block", group.alias("group"), F.lit(2).alias("kind"), "shard", no_long.alias("item_id"), no_long.alias("item"), "term", F.col("n").alias("weight"), "data"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])

    def answer(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        term = table.column("term").fill_null(0).to_numpy()
        weight = table.column("weight").to_numpy()
        shard = table.column("shard").fill_null(0).to_numpy()
        data = table.column("data")
        items: dict[tuple, dict[int, int]] = {}
        rows = np.flatnonzero(kind == 0)
        for i, item, t, w in zip(table.column("item_id").take(rows).to_pylist(), table.column("item").take(rows).to_pylist(), term[rows].tolist(), weight[rows].tolist(), strict=True):
            items.setdefault((i, item), {})[t] = w
        heads = np.flatnonzero(kind == 1)
        heads = heads[np.argsort(shard[heads], kind="stable")]
        if not len(heads) or not items:
            return pa.table({c: pa.array([], pa.int64()) for c in ("item_id", "item", "doc_id", "score")})
        sizes = weight[heads]
        before = dict(zip(shard[heads].tolist(), (np.cumsum(sizes) - sizes).tolist(), strict=True))
        raws = data.take(heads).to_pylist()
        ids = np.concatenate([np.frombuffer(r, "<i8", n) for r, n in zip(raws, sizes, strict=True)])
        lengths = np.concatenate([np.frombuffer(r, "<i8", n, 8 * n) for r, n in zip(raws, sizes, strict=True)])
        null = np.concatenate([np.frombuffer(r, np.uint8, n, 16 * n) for r, n in zip(raws, sizes, strict=True)]).astype(bool)
        lists: dict[int, list[tuple[int, bytes]]] = {}
        rows = np.flatnonzero(kind == 2)
        rows = rows[np.argsort(shard[rows], kind="stable")]
        for t, s, packed in zip(term[rows].tolist(), shard[rows].tolist(), data.take(rows).to_pylist(), strict=True):
            lists.setdefault(t, []).append((before[s], packed))
        here = Shard(ids, lengths, lists, n_docs, n_terms)
        out = [[], [], [], []]
        for (i, item), weights in items.items():
            docs, own, _ = best_of_shard(here, weights, k)
            order = np.lexsort((ids[docs], null[docs], -own))[:k]
            for column, values in zip(out, ([i] * len(order), [item] * len(order), [None if null[d] else int(ids[d]) for d in docs[order]], own[order].tolist()), strict=True):
                column += values
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("item_id", "item", "doc_id", "score"), out, strict=True)})

    found = rows.groupBy("block", "group").applyInArrow(answer, "item_id long, item long, doc_id long, score long")
    order = Window.partitionBy("item_id", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
#: The same in DuckDB SQL, every posting scored.
ORACLE = f"""
with d as (select doc_id, unnest({_TERMS}) as term from documents where text is not null),
tf as materialized (select doc_id, term, count(*)::bigint as tf from d group by all),
len as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
tot as (select count(*)::bigint as docs, sum(n)::bigint as terms from len),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, tot group by term, docs),
q as (select item_id, term, count(*)::bigint as times from (select item_id, unnest({_TERMS}) as term from benchmark where text is not null) b group by all),
m as (select doc_id, 25 + (75 * n * docs) // terms as m from len, tot),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
      from q join w using (term) join tf using (term) join m using (doc_id) group by item_id, doc_id),
r as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""
