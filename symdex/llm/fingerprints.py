"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Every shingle of five words is hashed once.  The top eight bits of the hash name
one of 256 bins and the least value of a bin is kept.  An empty bin borrows
from the first non-empty bin of its own pseudo-random probe order (optimal
densification), and the low ``BITS`` bits of each bin are packed as hex.

Two fingerprints agree by chance in ``2**-BITS`` of their bins; the likeness
corrects for that: ``(m - c) / (1 - c)``, at least 0.

Only built-in functions are used.  The sorted array of a document holds its
hashes and one sentinel a bin, the largest value of that bin, so the first
entry of every bin is either its minimum or the mark of an empty bin.

A text with fewer than five words has one shingle, the whole sequence.  A null,
empty or blank text has no shingle and the fingerprint ``''``; it is like
another such text (1.0) and unlike any other (0.0).  Equal texts have equal
fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symdex.llm.common import shared_folder, words_of

BINS, BITS, WORDS = 256, 8, 5
LOW = (1 << 56) - 1
#: Probes written out before the full probe order is searched.
SHORT_PROBES = 6


def _hash(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])


def _probes() -> list[list[int]]:
    """For each bin the order in which it looks for a donor: a multiplicative walk, its step and start mixed from the bin."""
    orders = []
    for b in range(BINS):
        mixed = (b * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64
        step, start = (mixed >> 40) % BINS | 1, (mixed >> 20) % BINS
        orders.append([(start + j * step) % BINS for j in range(BINS)])
    return orders


def _int_array(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the filled bins of column ``text``, null without a shingle."""
    own, w, h, s, d = df.columns, "_fp_words", "_fp_hashes", "_fp_sorted", "_fp_dense"
    n = F.size(w)
    df = df.withColumn(w, words_of(F.col(text)))
    few = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(w)))
    df = df.select(*own, F.when(n < WORDS, few).otherwise(F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: _hash(F.col(w), i))).alias(h))
    # bins are -128..127, the top byte as Spark shifts it; the sentinels sort last in their bin
    sentinels = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), 56).bitwiseOR(F.lit(LOW)))
    df = df.select(*own, F.when(F.size(h) > 0, F.sort_array(F.concat(h, sentinels))).alias(s))
    first = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(F.col(s), i - 1), 56)))
    df = df.select(*own, F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(LOW)) != LOW, x.bitwiseAND(F.lit(2**BITS - 1)).cast("int"))).alias(d))
    orders = _probes()
    short = [_int_array([orders[b][j] for b in range(BINS)]) for j in range(SHORT_PROBES)]
    steps, starts = _int_array([(orders[b][1] - orders[b][0]) % BINS for b in range(BINS)]), _int_array([orders[b][0] for b in range(BINS)])

    def fill(value: Column, b: Column) -> Column:
        near = [F.get(F.col(d), F.get(p, b)) for p in short]
        walk = F.transform(F.sequence(F.lit(SHORT_PROBES), F.lit(BINS - 1)), lambda j: F.get(F.col(d), (F.get(starts, b) + j * F.get(steps, b)) % BINS))
        return F.coalesce(value, *near, F.get(F.filter(walk, lambda v: v.isNotNull()), F.lit(0)))

    return df.select(*own, F.transform(d, fill).alias(out))


def packed(bins: Column) -> Column:
    """The fingerprint: the bins' low bits as hex, ``''`` without a shingle."""
    digits = F.transform(bins, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two rows of bins, corrected for chance agreement of ``BITS`` bits."""
    chance = 2.0**-BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    some = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(some)


def _ranges(texts: DataFrame) -> Column:
    """A number for ranges of ids between quantiles, ascending with the id, null ids first."""
    ranges = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = texts.select(F.percentile_approx("doc_id", [(i + 1) / ranges for i in range(ranges - 1)], 10 * ranges)).first()[0]
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.expr(f"array({', '.join(f'{c}L' for c in sorted(set(cuts)))})"), lambda c: c < F.col("doc_id")))


def with_next(texts: DataFrame) -> DataFrame:
    """Bins of every text, and text and bins of the row that follows by doc_id and text; after the last, the first.

    Rows go to ranges of ids, whose number follows the shuffle partitions; inside
    a range a window finds the next row.  The first row of each range, one row a
    range, is handed to the range before it.
    """
    texts = texts.withColumn("range", _ranges(texts))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = with_bins(texts, "text", "bins").withColumns({"next_text": F.lead("text").over(order), "next_bins": F.lead("bins").over(order), "last": F.lead(F.lit(1)).over(order).isNull()})
    heads = texts.groupBy("range").agg(F.min_by("text", F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "text")).alias("head_text"))
    around = Window.partitionBy(F.lit(0)).orderBy("range")
    after = texts.select("range").distinct().withColumn("after", F.coalesce(F.lead("range").over(around), F.first("range").over(around)))
    heads = with_bins(heads.withColumnRenamed("range", "after").join(after, "after"), "head_text", "head_bins").drop("after")
    rows = rows.join(heads, "range", "left")
    return rows.select("doc_id", "text", "bins", *[F.when(F.col("last"), F.col(f"head_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in ("text", "bins")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    shared_folder(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))})
    rows = rows.select("doc_id", "n_chars", "bins", "next_bins", "edited", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    rows = with_bins(rows, "edited", "edited_bins")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
