"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Documents with equal shingle sets are one class, and only one row of each class
is joined.  Two sets whose Jaccard similarity is ``PERCENT`` % or more share a
shingle among the first ``n - ceil(PERCENT n / 100) + 1`` of each, in any one order of all
shingles; the order used puts shingles of crowded counters (a count table of
fixed size over the whole corpus) last.  Those first shingles are the incidence
matrix, and the product runs over its columns, the posting lists:

1. a star in each list: every row with the first of its size range, overlaps
   accumulated per pair; the best partner of each row is verified;
2. the components so far label the rows; ``ROUNDS`` times a few rows of each component in
   a list (``SPEAKERS``) are paired with the next ``PARTNERS`` such rows there, rows and order by
   hashes that change, and the components grow by the links that full sets
   confirm: a group of near copies soon is one;
3. each list then gives all pairs of rows in different components whose sizes fit.
   Their overlaps are summed over all lists and a pair below the bound that its
   sizes set is discarded: the least overlap that reaches the similarity, less
   what can lie behind the shorter first parts.  What remains is verified by its full sets.

So no link between different components is lost, and copies within a component are
never expanded to pairs.  Lists of crowded shingles are dealt to ``BLOCKS`` salted
blocks, each pair of blocks in a task of its own.

A document's set: distinct 4-word shingles of the lowered (A-Z) words, the whole
sequence with fewer words, empty without words.  Empty sets are linked with
nothing.  Null text has no words; rows of one doc_id with different texts are
linked as one document; a null doc_id takes part and has a null component unless
a row with an id is linked with it; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symdex.llm.bits import bit_table
from symdex.llm.common import shared_folder, text_or_empty, written
from symdex.llm.components import components
from symdex.llm.words import mixed, rows_of, shingle_hashes, word_hashes

WORDS, PERCENT = 4, 85
#: Counters of the order table: a power of two near 4 a document, within these bounds.
LEAST_BITS, MOST_BITS = 16, 22
PART = 1 << 14
#: Texts are taken in groups of this many bytes.
GROUP_BYTES = 2 << 20
#: From this level on (2**level times the mean count) a list is dealt to blocks.
HOT_LEVEL, BLOCKS = 5, 8
ROUNDS, SPEAKERS, PARTNERS = 2, 16, 48
NULL_ID = -(2**63)


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    hashes, n = shingle_hashes(*word_hashes(texts), words)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        yield np.unique(hashes[a:b])


def _node(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(shingles):
        return 0
    i = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    return int(mixed(np.array([(mixed(shingles) * (i * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64)]))[0].view(np.int64))


def shingle_levels(texts: DataFrame, words: int) -> np.ndarray:
    """For each counter of shingle hashes how many times two its count stands above the mean."""
    n_docs = max(1, texts.count())
    bits = min(MOST_BITS, max(LEAST_BITS, n_docs.bit_length() + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.int64)
        for _, group in rows_of(batches, GROUP_BYTES):
            for s in _sets(group, words):
                np.add.at(table, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
        for part in range(0, 1 << bits, PART):
            own = table[part : part + PART]
            if own.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(c), np.int64)
                totals[part] = totals[part] + own if part in totals else own
        for part, total in totals.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = texts.mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary")
    table = np.zeros(1 << bits, np.int64)
    for part, counts in parts.collect():  # at most 2**22 counters, whatever the input
        table[part : part + PART] = np.frombuffer(counts, np.int64)
    mean = max(1.0, table.sum() / len(table))
    return np.clip(np.floor(np.log2(np.maximum(table / mean, 1.0))), 0, 15).astype(np.uint8)


def document_sets(texts: DataFrame, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n, the set's name and its first shingles in the order of levels."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(levels)
    bits = len(levels).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for doc_ids, group in rows_of(batches, GROUP_BYTES):
            n, nodes, firsts = [], [], []
            for s in _sets(group, words):
                n.append(len(s))
                nodes.append(_node(s))
                level = table[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
                keys = (level << np.uint64(56)) | (s >> np.uint64(8))
                some = len(s) + percent * len(s) // -100 + 1 if len(s) else 0
                firsts.append(np.partition(keys, some - 1)[:some].view(np.int64) if some else np.zeros(0, np.int64))
            ends = np.concatenate(([0], np.cumsum([len(f) for f in firsts]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), lists], ["doc_id", "n", "node", "first"])

    return texts.mapInArrow(run, "doc_id long, n long, node long, first array<long>")


def _lists(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut only between lists; the first ``keys`` columns name the list."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        same = np.ones(batch.num_rows if rest is None else len(columns[0]), bool)
        for c in columns[:keys]:
            same &= c == c[-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield [c[:cut] for c in columns]
        rest = [c[cut:] for c in columns]
    if rest is not None and len(rest[0]):
        yield rest


def _heads(columns: list[np.ndarray]) -> np.ndarray:
    """The place of the first row of each row's list."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _pairs_batch(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
    """Pairs with their overlap so far."""
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate((at, [len(a)])))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[at], b[at], na[at], nb[at], counts)], ["a", "b", "na", "nb", "overlap"])


PAIRS = "a long, b long, na long, nb long, overlap long"


LISTS = "pair boolean, x long, y long, n long, overlap long"


def stars(postings: DataFrame, percent: int) -> DataFrame:
    """Lists with more than one row, as (token, node, n), and the stars in them: pairs of a row with the first of its list, as (first, row, size of the row, overlap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, salt, n, node in _lists(batches, 2):
            head = _heads([token, salt])
            # a crowded list may have its other rows in other blocks
            several = np.zeros(len(token), bool)
            several[head[np.flatnonzero(head != np.arange(len(token)))]] = True
            keep = several[head] | (token >> 56 >= HOT_LEVEL)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(int(keep.sum()), bool)), *[pa.array(c[keep]) for c in (token, node, n)], pa.nulls(int(keep.sum()), pa.int64())], ["pair", "x", "y", "n", "overlap"])
            keep = (node != node[head]) & (100 * n[head] >= percent * n)
            if keep.any():
                h = head[keep]
                found = _pairs_batch(node[h], node[keep], n[h], n[keep])
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(found.num_rows, bool)), *(found.column(c) for c in ("a", "b", "nb", "overlap"))], ["pair", "x", "y", "n", "overlap"])

    hot = F.shiftright("token", 56) >= HOT_LEVEL
    dealt = postings.select("token", F.when(hot, F.pmod("node", F.lit(BLOCKS))).otherwise(0).cast("long").alias("salt"), "n", "node")
    dealt = dealt.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "node")
    return dealt.mapInArrow(run, LISTS)


def crossings(postings: DataFrame, percent: int, partners: int | None = None, seed: int = 0) -> DataFrame:
    """Pairs of rows of a list that stand in different components, sizes allowing; with ``partners`` only a few rows of each component with so many next ones, in an order by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, block, _, n, node, root, side in _lists(batches, 2):
            head = _heads([token, block])
            # lists within one component have nothing to give
            mixed_list = np.zeros(len(token), bool)
            np.logical_or.at(mixed_list, head, root != root[head])
            keep = mixed_list[head]
            if partners is not None:
                keep &= np.arange(len(token)) - _heads([token, block, root]) < SPEAKERS
            token, block, n, node, root, side = (x[keep] for x in (token, block, n, node, root, side))
            if not len(token):
                continue
            head = _heads([token, block])
            same_side = block // BLOCKS == block % BLOCKS
            last = np.zeros(len(token), np.int64)
            np.maximum.at(last, head, np.arange(len(token)))
            last = last[head]
            at = np.arange(len(token))
            step = 1
            while True:  # each row with the one `step` further on in its list
                at = at[at + step <= last[at]]
                if partners is None:
                    at = at[100 * n[at] >= percent * n[at + step]]  # sizes ascend: none further on can fit
                if not len(at) or step > (partners or step):
                    break
                other = at + step
                some = (root[at] != root[other]) & (node[at] != node[other]) & (same_side[at] | (side[at] != side[other]))
                some &= 100 * np.minimum(n[at], n[other]) >= percent * np.maximum(n[at], n[other])
                if some.any():
                    yield _pairs_batch(node[at[some]], node[other[some]], n[at[some]], n[other[some]])
                step += 1

    hot = F.shiftright("token", 56) >= HOT_LEVEL
    # another deal each time, or components would stay within their blocks
    side = F.when(hot, F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(BLOCKS))).otherwise(0)
    if partners is None:
        others, rank = F.when(hot, F.sequence(F.lit(0), F.lit(BLOCKS - 1))).otherwise(F.array(F.lit(0))), F.col("n")
    else:
        others, rank = F.array(side), F.xxhash64("root", F.lit(seed))
    dealt = postings.select("token", "n", "node", "root", side.cast("long").alias("side"), F.explode(others).alias("other"))
    dealt = dealt.select("token", (F.least("side", "other") * BLOCKS + F.greatest("side", "other")).cast("long").alias("block"), rank.alias("rank"), "n", "node", "root", "side")
    by_row = ["rank", "node"] if partners is None else ["rank", "root", F.xxhash64("node", F.lit(seed)), "node"]
    dealt = dealt.repartition("token", "block").sortWithinPartitions("token", "block", *by_row)
    found = dealt.mapInArrow(run, PAIRS)
    least, most = F.least("a", "b"), F.greatest("a", "b")
    return found.select(least.alias("a"), most.alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"), "overlap")


def above_bound(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose summed overlap can still reach the similarity.

    The overlap must be at least ``percent / (100 + percent)`` of both sizes together, and
    behind the first shingles of a set of ``n`` stand ``ceil(percent n / 100) - 1`` more.
    """
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100.0 + percent) - 1e-6)
    behind = F.greatest(*[F.ceil(F.col(c) * percent / 100.0 - 1e-6) - 1 for c in ("na", "nb")])
    return pairs.where(F.col("overlap") + behind >= need).select("a", "b")


def texts_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """node and the compressed text of one of its rows, for every node."""
    wanted = written(nodes.distinct().join(classes.select("node", "rep"), "node"), "jaccard-wanted")
    table = texts.sparkSession.sparkContext.broadcast(bit_table(wanted, "rep"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packer = table.value, zstandard.ZstdCompressor(level=1)
        for doc_ids, group in rows_of(batches, GROUP_BYTES):
            some = np.flatnonzero(bits[np.array(doc_ids, np.int64) & (len(bits) - 1)]).tolist()
            own = [group[i] for i in some]
            nodes = [_node(s) for s in _sets(own, words)]
            yield pa.RecordBatch.from_arrays([pa.array([doc_ids[i] for i in some], pa.int64()), pa.array(nodes, pa.int64()), pa.array([packer.compress(t) for t in own], pa.binary())], ["rep", "node", "packed"])

    chosen = texts.mapInArrow(pack, "rep long, node long, packed binary").join(wanted, ["rep", "node"], "left_semi")
    return written(chosen.groupBy("node").agg(F.first("packed").alias("packed")), "jaccard-texts", "none")


def verified(pairs: DataFrame, chosen: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
                distinct = dict(zip([*a.tolist(), *b.tolist()], [*part.column("pa").to_pylist(), *part.column("pb").to_pylist()], strict=True))
                sets = dict(zip(distinct, _sets([unpack(t) for t in distinct.values()], words), strict=True))
                # overlaps of the block: shingles that both rows of a pair have
                both = [np.intersect1d(sets[x], sets[y], assume_unique=True).size for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                overlap = np.array(both)
                union = np.array([len(sets[x]) + len(sets[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]) - overlap
                keep = 100 * overlap >= percent * union
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    first = chosen.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    second = chosen.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
    return pairs.select("a", "b").join(first, "a").join(second, "b").mapInArrow(check, "a long, b long")


def near_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach."""
    shared_folder(docs.sparkSession)
    texts = text_or_empty(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    full = document_sets(texts, words, percent, shingle_levels(texts, words))
    # first shingles are kept once, for one row of each class: reading the texts again is cheaper than the disk for all rows
    sets = written(full.select("doc_id", "n", "node"), "jaccard-sets")
    # a null id must not name a class that has an id
    named = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    classes = sets.where("n > 0").groupBy("node").agg(F.coalesce(F.min(named), F.lit(NULL_ID)).alias("rep"))
    rows = full.where("n > 0").join(classes, "node").where("doc_id = rep").dropDuplicates(["node"])
    rows = written(rows.select("node", "rep", "n", "first"), "jaccard-rows")
    lists = written(stars(rows.select("node", "n", F.explode("first").alias("token")), percent), "jaccard-lists")
    star = lists.where("pair").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("overlap").alias("overlap"), F.max("n").alias("n"))
    # similar rows share about 7 % of their size at least in these lists; a pair that is passed over here comes up again below
    star = star.where("100 * overlap >= 2 * n")
    best = written(star.groupBy("b").agg(F.max_by("a", F.struct("overlap", "a")).alias("a")), "jaccard-star")
    postings = lists.where("not pair").select(F.col("x").alias("token"), F.col("y").alias("node"), "n")
    chosen = texts_of(postings.select("node"), rows, texts, words)
    links = verified(best, chosen, words, percent)
    # rows of one doc_id are one document
    twins = sets.where(f"n > 0 and doc_id <> {NULL_ID}").groupBy("doc_id").agg(F.min("node").alias("b"), F.count_distinct("node").alias("c")).where("c > 1")
    twins = sets.where("n > 0").join(twins, "doc_id").select(F.col("node").alias("a"), "b").distinct()
    links = written(links.unionByName(twins), "jaccard-links")

    def known() -> DataFrame:
        return postings.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))

    for seed in range(1, ROUNDS + 1):
        tried = written(above_bound(crossings(known(), percent, PARTNERS, seed), percent), "jaccard-tried")
        links = written(links.unionByName(verified(tried, chosen, words, percent)), "jaccard-links")
    pairs = written(above_bound(crossings(known(), percent), percent), "jaccard-crossing")
    more = written(verified(pairs, chosen, words, percent), "jaccard-more")
    labels = components(links.unionByName(more))
    named_rows = rows.select("node", "rep").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = named_rows.groupBy("root").agg(F.min(F.when(F.col("rep") != NULL_ID, F.col("rep"))).alias("component_id"))
    named_rows = named_rows.join(roots, "root").select("node", "component_id")
    out = sets.select("doc_id", "n", "node").join(named_rows, "node", "left")
    own = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", own).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its component, of an id the first by text and the other columns; rows without an id stay."""
    found = near_classes(docs, words, percent)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    stay = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    order = [F.col(f"`{f.name}`") for f in sorted(docs.schema.fields, key=lambda f: f.name != "text") if not f.dataType.simpleString().count("map<")]
    turn = _own_name("_turn", docs.columns)
    # filtered by its rank, a window keeps one row an id before the shuffle too
    named = stay.where("doc_id is not null").withColumn(turn, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col(turn) == 1)
    return named.drop(turn).unionByName(stay.where("doc_id is null"))


def _own_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


#: DuckDB SQL of op4_jaccard_join: all shingles joined with all, so for small tables only.
ORACLE = r"""
with recursive split as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
shingled as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
  from split),
sizes as (select doc_id, len(s)::bigint as n from shingled),
grams as (select doc_id, unnest(s) as g from shingled),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
steps as (select a, b from links union select b, a from links),
reached as (select a, b from steps union select r.a, s.b from reached r join steps s on r.b = s.a)
select doc_id, n as n_shingles, least(doc_id, coalesce((select min(b) from reached where a = doc_id), doc_id)) as component_id from sizes
"""
