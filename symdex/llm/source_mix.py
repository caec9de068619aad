"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  Inside a source a document is
expected ``e`` times, ``e`` growing with the length class of the document;
``floor(e)`` whole copies are certain and the rest, ``p = e - floor(e)``, is an
inclusion probability.  Documents are ranked by random odds over inclusion odds,
``u/(1-u) / (p/(1-p))``, and taken in that order until the source's words reach
what is left of its target (fixed size, unequal probabilities).

The random number of a document is a hash of its id, so reruns agree.  Only
per-source and per-class sums and one rank threshold per source are joined back,
so a hot source is never gathered in one task: ranks are first summed in
``RANK_BINS`` bins a source and only rows inside one bin are put in order.

Null text counts as size 0; a null source is a source of its own, last in
order; rows with equal ids share their random number and are taken together;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symdex.llm.common import shared_folder, words_of

RANK_BINS = 4096


def _size() -> Column:
    return F.size(words_of(F.col("text"))).cast("long")


def _key() -> Column:
    """Sorts by code point with null last, and is never null itself."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))


def _uniform(seed: str) -> Column:
    """In (0, 1), from the id alone: 52 bits of a digest."""
    text = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def filled(items: DataFrame, part: list[str], cap: str, weight: str, total: str, name: str) -> DataFrame:
    """Share ``total`` among the items of a part by ``weight``, none above its ``cap``.

    With the items in order of ``cap/weight``, the level after the first ``j`` are
    full is ``(total - caps) / (rest of the weights)``; the highest of these levels is
    the one at which the shares add up.
    """
    order = Window.partitionBy(*part).orderBy(F.col(cap) / F.col(weight), "key", "grade")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*part)
    level = (F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    out = items.withColumn("_level", level)
    return out.withColumn(name, F.least(F.col(cap).cast("double"), F.max("_level").over(everything) * F.col(weight))).drop("_level")


def mix_plan(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix:") -> DataFrame:
    """One row per source key and length class: sizes, target, copies expected, rank threshold."""
    shared_folder(docs.sparkSession)
    narrow = docs.select(_key().alias("key"), _size().alias("size"), _uniform(seed).alias("u")).withColumn("grade", F.length(F.bin("size")).cast("long")).checkpoint()
    grades = narrow.groupBy("key", "grade").agg(F.sum("size").alias("grade_size"))
    sources = grades.groupBy("key").agg(F.sum("grade_size").alias("source_size")).withColumn("grade", F.lit(0))
    place = Window.orderBy("key")
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1))
    sources = sources.withColumns({"one": F.lit(1), "cap": F.col("source_size") * cap})
    sources = sources.withColumn("all_words", F.sum("source_size").over(Window.partitionBy("one")) * F.lit(share))
    targets = filled(sources, ["one"], "cap", "weight", "all_words", "target").select("key", "source_size", "target")
    # a length class is expected in proportion to 8 + its number of binary digits, at most `cap` times
    grades = grades.join(targets, "key").withColumns({"grade_cap": F.col("grade_size") * cap, "grade_weight": F.col("grade_size") * (F.col("grade") + 8)})
    some = filled(grades.where("grade_size > 0"), ["key"], "grade_cap", "grade_weight", "target", "grade_target")
    some = some.withColumn("expected", F.col("grade_target") / F.col("grade_size"))
    none = grades.where("grade_size = 0").withColumns({"grade_target": F.lit(0.0), "expected": F.lit(0.0)})
    plan = some.unionByName(none).withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    left = plan.groupBy("key").agg((F.first("target") - F.sum(F.col("whole") * F.col("grade_size"))).alias("left"))
    plan = plan.join(left, "key").select("key", "grade", "source_size", "target", "whole", "p", "left").checkpoint()
    ranked = narrow.join(plan.select("key", "grade", "p", "left"), ["key", "grade"]).where("p > 0").withColumn("q", _rank())
    ranked = ranked.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * RANK_BINS))
    bins = ranked.groupBy("key", "bin").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(bins.select("key", "bin", "base"), ["key", "bin"])
    before = Window.partitionBy("key", "bin").orderBy("q", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("taken_before", F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    last = ranked.where(F.col("taken_before") + F.col("size") / 2 <= F.col("left")).groupBy("key").agg(F.max("q").alias("last_q"))
    return plan.join(last, "key", "left").drop("left")


#: What the mix reads.
MAIN = ["doc_id", "text", "source"]


def _rank(prefix: str = "") -> Column:
    """Random odds over inclusion odds."""
    u, p = F.col(f"{prefix}u"), F.col(f"{prefix}p")
    return F.try_divide(u * (1 - p), (1 - u) * p)


def _with_copies(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text, source and the other columns of ``docs`` in one struct, so that no name can clash with the mix's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in MAIN]
    docs = docs.select(*MAIN, *([F.struct(*others).alias("others")] if others else []))
    plan = mix_plan(docs, **how)
    rows = docs.withColumns({"_mix_key": _key(), "_mix_size": _size(), "_mix_u": _uniform(how.get("seed", "mix:"))})
    rows = rows.withColumn("_mix_grade", F.length(F.bin("_mix_size")).cast("long"))
    rows = rows.join(plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns]), ["_mix_key", "_mix_grade"])
    drawn = (F.col("_mix_p") > 0) & (_rank("_mix_") <= F.col("_mix_last_q"))
    return rows.withColumn("_mix_copies", F.col("_mix_whole") + F.coalesce(drawn, F.lit(False)).cast("long"))


def _column(name: str) -> Column:
    return F.col(name) if name in MAIN else F.col("others").getField(name).alias(name)


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``cap``); they replace columns of the same names."""
    own = {"size": "_mix_size", "source_size": "_mix_source_size", "target": "_mix_target", "copies": "_mix_copies"}
    rows = _with_copies(docs, **how)
    return rows.select(*[_column(c) for c in docs.columns if c not in own], *[F.col(c).alias(n) for n, c in own.items()])


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    rows = _with_copies(docs, **how).where("_mix_copies > 0")
    return rows.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies").cast("int")))).select(*[_column(c) for c in docs.columns])


#: DuckDB SQL of op5_source_mix.
ORACLE = """
with sized as (
  select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::bigint as size,
         case when source is null then '1' else '0' || source end as key,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents),
graded as (select *, length(bin(size)) as grade from sized),
grades as (select key, grade, sum(size)::bigint as grade_size from graded group by all),
sources as (select key, sum(grade_size)::bigint as source_size from grades group by all),
weighted as (select *, source_size * 2 as cap, [3, 1, 2][(row_number() over (order by key) - 1) % 3 + 1] as weight, sum(source_size) over () * 1.5::double as all_words from sources),
levels as (
  select *, (all_words - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level from weighted
  window w as (order by cap::double / weight, key rows between unbounded preceding and 1 preceding)),
targets as (select key, source_size, least(cap::double, max(level) over () * weight) as target from levels),
gw as (select key, grade, grade_size, source_size, target, grade_size * 2 as cap, grade_size * (grade + 8) as weight from grades join targets using (key) where grade_size > 0),
glevels as (
  select *, (target - coalesce(sum(cap) over w, 0)::double) / (sum(weight) over (partition by key) - coalesce(sum(weight) over w, 0))::double as level from gw
  window w as (partition by key order by cap::double / weight, key, grade rows between unbounded preceding and 1 preceding)),
expected as (select key, grade, grade_size, target, least(cap::double, max(level) over (partition by key) * weight) / grade_size as expected from glevels),
plan as (select *, floor(expected)::bigint as whole, expected - floor(expected) as p from expected),
lefts as (select key, first(target) - sum(whole * grade_size)::double as left_words from plan group by key),
ranked as (
  select g.key, g.size, (u * (1 - p)) / ((1 - u) * p) as q, left_words
  from graded g join plan using (key, grade) join lefts using (key) where p > 0),
ordered as (select *, coalesce(sum(size) over (partition by key order by q, size rows between unbounded preceding and 1 preceding), 0)::double as before from ranked),
last as (select key, max(q) as last_q from ordered where before + size / 2.0 <= left_words group by key)
select g.doc_id, g.size, t.source_size, t.target,
       g.size * (coalesce(whole, 0) + case when coalesce(p, 0) > 0 and (u * (1 - p)) / ((1 - u) * p) <= last_q then 1 else 0 end)::bigint as taken
from graded g join targets t using (key) left join plan using (key, grade) left join last using (key)
"""
