"""Vector code compression: product codes, each part's entries held in a geometric near-neighbour access tree (GNAT).

Every component x becomes the integer floor(4096 * x); a vector is cut into
``parts`` equal consecutive parts.  A part position's codebook starts as that part of the
``entries`` least vec_ids.  Each of ``rounds`` rounds assigns every part to the
nearest entry (squared Euclidean distance, ties to the lower index) and
replaces each entry by the componentwise floor(sum / count) of its parts; unused entries stay.
At last the parts are assigned once more.

Assignment.  A node of the tree names some of its entries split points, deals the
others to the nearest one, and stores for each split point and each child the least
and the largest distance from the point to the child's entries (the child's own
split point included), rounded down and up to integers.  A query's distances to the split points
are exact integer squares, their roots rounded down and up.  A child goes when its
range from some split point lies strictly outside the query's distance to that point plus or
minus the best distance so far; so only entries that are farther than the best one go, never
a tie.  Entries that are left are compared by integer squares, equal ones by index.
All queries of a batch walk the tree together, one numpy mask a child.

Spark's part: the quantised vectors are written once as a table; each round is one map
over it whose tasks give the sums and counts of their entries (a fixed number
of rows a task), combined by a sum; the codebooks, ``entries`` * dimension integers,
are all that passes the driver.

Dropped rows: a vector that is null or holds null or non-finite components; one
without components or whose length ``parts`` does not divide; one of another length than
the kept row of the least vec_id.  A null vec_id comes after all others; rows of equal vec_id are
ordered by their bytes.  With fewer kept rows than entries there are as many entries as
rows.  Integers beyond ``2**27`` (for up to 64 components; less for longer
vectors, so that no squared distance leaves 64 bits) are held to that bound.  An empty table, or one
without kept rows, gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.llm.common import ship_package, written

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Split points of a node; a node of at most so many entries is a leaf.
DEGREE = 4
#: Vectors that walk the trees together.
ROWS = 4096
#: Rows of equal label are dealt to so many groups when their sum goes back to them.
SALTS = 32


def _squares(vectors: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = vectors - entry
    return np.einsum("ij,ij->i", d, d)


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers surely not above and surely not below the square roots."""
    root = np.sqrt(squares.astype(np.float64))
    slack = root * 2.0**-50
    return np.floor(root - slack).astype(np.int64), np.ceil(root + slack).astype(np.int64)


@dataclass
class Node:
    """Split points (indexes of entries), their children, and the ranges from each split point to each child."""

    splits: np.ndarray
    children: list[Node | None] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Gnat:
    """The entries of one codebook, (entries, components) of int64."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries, self.degree = entries, degree
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray) -> Node:
        if len(members) <= self.degree:
            return Node(members)
        far = _squares(self.entries[members], self.entries[members[0]])
        splits = [0]
        while len(splits) < self.degree:  # the member farthest from the split points so far; the first of several
            splits.append(int(np.argmax(np.where(np.isin(np.arange(len(members)), splits), -1, far))))
            far = np.minimum(far, _squares(self.entries[members], self.entries[members[splits[-1]]]))
        points = members[splits]
        squares = np.stack([_squares(self.entries[members], self.entries[p]) for p in points])
        owner = np.argmin(squares, axis=0)
        owner[splits] = np.arange(len(splits))
        lows, highs = _roots(squares)
        own = [owner == j for j in range(len(splits))]
        node = Node(points, low=np.stack([lows[:, o].min(axis=1) for o in own], axis=1), high=np.stack([highs[:, o].max(axis=1) for o in own], axis=1))
        for j, o in enumerate(own):
            rest = members[o & (members != points[j])]
            node.children.append(self._node(rest) if len(rest) else None)
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of each vector, and how many distances were taken."""
        best = np.full(len(vectors), -1, np.int64)
        square = np.full(len(vectors), np.iinfo(np.int64).max, np.int64)
        taken = 0

        def walk(node: Node, rows: np.ndarray) -> None:
            nonlocal taken
            here = vectors[rows]
            distances = np.empty((len(node.splits), len(rows)), np.int64)
            for i, p in enumerate(node.splits):
                distances[i] = d = _squares(here, self.entries[p])
                taken += len(rows)
                old = square[rows]
                better = (d < old) | ((d == old) & (p < best[rows]))
                square[rows[better]], best[rows[better]] = d[better], p
            if not node.children:
                return
            least, most = _roots(distances)
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                reach = _roots(square[rows])[1]
                out = ((least - node.high[:, j, None] > reach) | (node.low[:, j, None] - most > reach)).any(axis=0)
                if not out.all():
                    walk(child, rows[~out])

        if len(vectors):
            walk(self.root, np.arange(len(vectors)))
        return best, square, taken


@lru_cache(maxsize=1024)
def bound(dimension: int) -> int:
    """The largest integer a component may be so that a vector's squared distances stay below 2**62."""
    return math.isqrt((1 << 60) // max(dimension, 64))


def quantised(embeddings: DataFrame, parts: int) -> DataFrame:
    """(vec_id, label, vector: little-endian int32 of all components, n: how many) of rows that can be coded."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                column = batch.column(2)
                lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                flat = column.flatten()
                values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
                owner = np.repeat(np.arange(batch.num_rows), lengths)
                good = np.array(column.is_valid()) & (lengths > 0) & (lengths % parts == 0)
                good[owner[~np.isfinite(values)]] = False
                kept = np.flatnonzero(good)
                most = np.repeat([float(bound(n)) for n in lengths.tolist()], lengths)
                with np.errstate(invalid="ignore", over="ignore"):
                    whole_numbers = np.clip(np.floor(values * SCALE), -most, most)
                whole_numbers = np.nan_to_num(whole_numbers).astype("<i4")
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)),
                        pa.array([whole_numbers[ends[i] - lengths[i] : ends[i]].tobytes() for i in kept], pa.binary()), pa.array(lengths[kept], pa.int32()),
                    ],
                    names=["vec_id", "label", "vector", "n"],
                )

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(pack, "vec_id long, label long, vector binary, n int")


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimension).astype(np.int64)


def first_vectors(vectors: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the least vec_ids, at most ``entries`` of them, of the length of the first."""
    order = [F.col("vec_id").asc_nulls_last(), F.hex("vector")]
    first = vectors.orderBy(*order).limit(1).collect()
    if not first:
        return np.zeros((0, 0), np.int64)
    n = first[0].n
    rows = vectors.where(F.col("n") == n).orderBy(*order).limit(entries).collect()
    return np.stack([np.frombuffer(r.vector, "<i4").astype(np.int64) for r in rows])


def assigned(vectors: np.ndarray, trees: list[Gnat]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, the part's columns, index of the nearest entry, squared distance) of every part position."""
    width = vectors.shape[1] // len(trees)
    for p, tree in enumerate(trees):
        own = np.ascontiguousarray(vectors[:, p * width : (p + 1) * width])
        best, square, _ = tree.nearest(own)
        yield p, own, best, square


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(entry: number over all parts, place, total) with the count at place -1, summed over all rows."""
    parts, entries, width = books.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                for p, own, best, _ in assigned(_matrix(batch.column(0), parts * width), trees):
                    order = np.argsort(best, kind="stable")
                    found, starts, n = np.unique(best[order], return_index=True, return_counts=True)
                    sums[p, found] += np.add.reduceat(own[order], starts, axis=0)
                    counts[p, found] += n
        used = np.flatnonzero(counts)
        values = np.concatenate((counts.reshape(-1, 1), sums.reshape(-1, width)), axis=1)[used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, width), len(used)).astype(np.int32)), pa.array(values.ravel())],
            names=["entry", "place", "total"],
        )

    rows = vectors.select("vector").mapInArrow(partial, "entry int, place int, total long")
    return rows.groupBy("entry", "place").agg(F.sum("total").alias("total"))


def trained(vectors: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (parts, entries, components of a part) after ``rounds`` rounds over all rows."""
    parts, entries, width = books.shape
    for _ in range(rounds):
        totals = np.zeros((parts * entries, width + 1), np.int64)
        for r in _sums(vectors, books).collect():  # entries * dimension numbers, whatever the input
            totals[r.entry, r.place + 1] = r.total
        used = totals[:, 0] > 0
        flat = books.reshape(parts * entries, width).copy()
        flat[used] = totals[used, 1:] // totals[used, :1]
        books = flat.reshape(books.shape)
    return books


def codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row that is kept."""
    ship_package(embeddings.sparkSession)
    vectors = written(quantised(embeddings, parts), "vectors")
    first = first_vectors(vectors, entries)
    schema = "vec_id long, label long, code string, error long"
    if not len(first):
        empty = vectors.sparkSession.createDataFrame([], schema)
        return empty.select("*", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dimension = first.shape[1]
    vectors = vectors.where(F.col("n") == dimension)
    books = trained(vectors, first.reshape(len(first), parts, dimension // parts).swapaxes(0, 1).copy(), rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        digits = 2 * max(1, (books.shape[1] - 1).bit_length() + 7 >> 3)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                error, names = np.zeros(batch.num_rows, np.int64), []
                for _, _, best, square in assigned(_matrix(batch.column(2), dimension), trees):
                    error += square
                    names.append([f"{b:0{digits}x}" for b in best.tolist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map("".join, zip(*names, strict=True)), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    rows = written(vectors.mapInArrow(encode, schema), "codes")
    # the sum of a label goes back to its rows in SALTS groups, as one label may hold a third of them
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).select("label", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int")).alias("r")
    back = salted.join(sums.alias("s"), (F.col("r.label").eqNullSafe(F.col("s.label"))) & (F.col("r.salt") == F.col("s.salt")))
    return back.select("vec_id", "r.label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, every part compared with every entry; no row here needs the bound on integers."""
    lists = (
        "v as (select vec_id, label, [floor(4096 * x::double)::bigint for x in embedding] as q from embeddings "
        "where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0), "
        f"p as (select vec_id, label, part, q[part * (len(q) // {parts}) + 1 : (part + 1) * (len(q) // {parts})] as own from v, range({parts}) t(part)), "
        f"first as (select vec_id, row_number() over (order by vec_id) - 1 as entry from v order by vec_id limit {entries}), "
        "c0 as (select part, entry, own as center from p join first using (vec_id))"
    )

    def near(books: str) -> str:
        d = "list_sum([(a[1] - a[2]) * (a[1] - a[2]) for a in list_zip(own, center)])"
        return f"select vec_id, label, p.part, own, min(struct_pack(d := {d}::bigint, entry := entry)) as m from p join {books} c on c.part = p.part group by vec_id, label, p.part, own"

    steps = [lists]
    for r in range(1, rounds + 1):
        steps.append(f"a{r} as materialized ({near(f'c{r - 1}')})")
        steps.append(
            f"s{r} as (select part, entry, i, sum(x) as total, count(*) as n from (select part, m.entry as entry, unnest(own) as x, unnest(range(len(own))) as i from a{r}) u group by part, entry, i)"
        )
        floored = "((total - (((total % n) + n) % n)) // n)::bigint"
        steps.append(f"m{r} as (select part, entry, list({floored} order by i) as center from s{r} group by part, entry)")
        steps.append(f"c{r} as materialized (select o.part, o.entry, coalesce(m.center, o.center) as center from c{r - 1} o left join m{r} m on m.part = o.part and m.entry = o.entry)")
    steps.append(f"f as ({near(f'c{rounds}')})")
    steps.append("rows as (select vec_id, label, string_agg(printf('%02x', m.entry), '' order by part) as code, sum(m.d)::bigint as error from f group by vec_id, label)")
    steps.append(f"books as (select sha256(string_agg(array_to_string(center, ','), ',' order by part, entry)) as codebooks_sha256 from c{rounds})")
    return f"with {', '.join(steps)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from rows, books"


ORACLE = _oracle()
