"""Quality rules whose cutoffs carry a risk guarantee.

Features of a text are counted with built-in functions.  Each rule is a share in
thousandths (``RULES``); a document is rejected by a rule when its share reaches the
cutoff of its stratum (language).  Cutoffs come from the labelled rows:

* one half of them (by a hash of the id) designs: per stratum and rule the cutoff with
  the best balance of rejected bad rows against ``GOOD_COST`` times the rejected
  good rows;
* the other half, the holdout, certifies: the rules with a gain on the design half are tested
  one after the other, the best first and each from its loosest cutoff down to the designed
  one, on the good rows rejected by any rule so far.  A cutoff passes while the exact binomial
  tail ``P(Bin(n, limit) <= rejected good rows)`` stays at or under ``error / strata``.  The
  first failure ends a stratum; the last pass of each rule is used.

So with probability ``1 - error`` no stratum loses more than ``limit`` of its good rows
(Bonferroni over strata, fixed-sequence testing over rules and cutoffs).  One of four strata
needs about 220 good holdout rows; a stratum with too few labels certifies nothing and loses
nothing by these rules.

``base_failed`` is the fixed base check.  Null or empty text has no words and
fails it; a null language is a stratum of its own; null labels are ignored and
several labels of one id count as their lowest; an empty table gives an empty
result.  Columns of the input may have any names: those that do not decide are carried in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symdex.llm.common import SPACE_CHARS, shared_folder, words_of, written

#: Rule: (numerator, denominator) of the share that it limits.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "exclamations": ("n_exclamations", "n_words"),
}
LIMIT, ERROR, GOOD_COST = 0.02, 0.05, 5
WINDOW = 5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclamations"]


def _only(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_q_<feature>`` for each feature of its text."""
    own = docs.columns
    text, w, h, p = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("_q_words"), F.col("_q_hashes"), F.col("_q_places")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    df = docs.select(
        *own, words_of(text).alias("_q_words"), lines.alias("_q_line_list"),
        (F.char_length(text) - _only(text, SPACE_CHARS)).alias("_q_word_chars"),
        _only(text, "#*$%&|<>").alias("_q_n_symbols"),
        _only(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_q_n_capitals"),
        _only(text, "!").alias("_q_n_exclamations"),
    )
    n = F.size(w)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    counted = ["_q_word_chars", "_q_n_symbols", "_q_n_capitals", "_q_n_exclamations"]
    df = df.select(
        *own, *counted, n.cast("long").alias("_q_n_words"), windows.alias("_q_hashes"),
        F.size("_q_line_list").cast("long").alias("_q_n_lines"),
        (F.size("_q_line_list") - F.size(F.array_distinct("_q_line_list"))).cast("long").alias("_q_n_dup_lines"),
    )
    counted += ["_q_n_words", "_q_n_lines", "_q_n_dup_lines"]
    # only texts with a repeated window sort their windows
    some = F.size(h) > F.size(F.array_distinct(h))
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.select(*own, *counted, F.when(some, pairs).alias("_q_pairs"))
    s = F.col("_q_pairs")
    again = F.filter(s, lambda x, i: F.coalesce((i > 0) & (F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    df = df.select(*own, *counted, F.sort_array(F.transform(again, lambda x: x["i"])).alias("_q_places"))
    covered = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long"))
    return df.select(*own, *counted, F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("_q_n_repeat_words"))


def _base_failed() -> Column:
    n = F.col("_q_n_words")
    return (n < 10) | (100 * F.col("_q_n_repeat_words") > 20 * n)


def _share(rule: str) -> Column:
    """In thousandths, rounded down; 0 where there is nothing to share."""
    part, whole = (F.col(f"_q_{c}") for c in RULES[rule])
    return F.when(whole > 0, F.least(F.lit(1000).cast("long"), F.floor(1000 * part / whole)).cast("long")).otherwise(F.lit(0).cast("long"))


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("null"))


def _tail(k: Column, n: Column, p: Column) -> Column:
    """Exact ``P(Bin(n, p) <= k)``, summed in order of j with each term in logarithms; 1 where k >= n*p (over a half, never small)."""
    start = F.struct((n * F.log1p(-p)).alias("term"), F.exp(n * F.log1p(-p)).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + F.log(p / (1 - p))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    counts = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(counts, start, step, lambda acc: acc["sum"]))


def _labelled(featured: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows that pass the base check, with the shares (rule, share) of all rules."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    shares = F.array(*[F.struct(F.lit(r).alias("rule"), _share(r).alias("share")) for r in RULES])
    rows = featured.select(F.col("doc_id").cast("long").alias("doc_id"), _stratum().alias("stratum"), shares.alias("shares"), _base_failed().alias("base_failed"))
    # the base check decides on its own; the rules are judged on what passes it
    return rows.where(~F.col("base_failed")).join(known, "doc_id")


def _holdout() -> Column:
    return F.substring(F.md5(F.concat(F.lit("half:"), F.col("doc_id").cast("string"))), 1, 1) >= "8"


def cutoffs(featured: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """Certified cutoffs: stratum, rule, cutoff.  ``featured``: doc_id, lang and the features."""
    rows = _labelled(featured, labels).withColumn("holdout", _holdout()).checkpoint()
    strata = max(1, rows.select("stratum").distinct().count())
    counts = rows.where("not holdout").select("stratum", "good", F.inline("shares")).groupBy("stratum", "rule", "share").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    group = Window.partitionBy("stratum", "rule")
    above = group.orderBy(F.col("share").desc())
    gain = F.try_divide(F.sum("bad").over(above), F.sum("bad").over(group)) - GOOD_COST * F.coalesce(F.try_divide(F.sum("good").over(above), F.sum("good").over(group)), F.lit(0.0))
    table = counts.select("stratum", "rule", F.col("share").alias("cutoff"), gain.alias("gain")).where("gain > 0 and cutoff > 0")
    best = table.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("b")).select("stratum", "rule", "b.*")
    order = F.row_number().over(Window.partitionBy("stratum").orderBy(F.col("gain").desc(), "rule"))
    designed = best.select("stratum", F.struct(order.alias("no"), "rule", "cutoff").alias("d")).groupBy("stratum").agg(F.sort_array(F.collect_list("d")).alias("designs"))
    # a row a stratum; as a table its size is known, so that the planner broadcasts it only where it is small
    designed = written(designed, "quality-designs")
    # a good row is lost at the first step that rejects it: of the first rule that does, the cutoff that is its share
    share_of = F.map_from_entries("shares")
    steps = F.transform("designs", lambda d: F.when(share_of[d["rule"]] >= d["cutoff"], F.struct(d["no"].alias("no"), (-share_of[d["rule"]]).alias("down"))))
    lost = rows.where("holdout and good").join(designed, "stratum").select("stratum", F.array_min(F.filter(steps, lambda x: x.isNotNull())).alias("step"))
    lost = lost.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    total = lost.groupBy("stratum").agg(F.sum("n").alias("total"))
    # besides the steps that lose rows, the last one of each rule
    last = designed.select("stratum", F.explode("designs").alias("d")).select("stratum", "d.rule", F.struct(F.col("d.no").alias("no"), (-F.col("d.cutoff")).alias("down")).alias("step"), F.lit(0).cast("long").alias("n"))
    rules = last.select("stratum", "rule", F.col("step.no").alias("no"))
    tested = lost.where("step is not null").unionByName(last.drop("rule")).groupBy("stratum", "step").agg(F.sum("n").alias("n")).join(total, "stratum")
    along = Window.partitionBy("stratum").orderBy("step")
    tested = tested.withColumn("k", F.sum("n").over(along))
    tested = tested.withColumn("passes", _tail(F.col("k"), F.col("total"), F.lit(limit)) <= F.lit(error / strata))
    tested = tested.withColumn("failed", F.max((~F.col("passes")).cast("int")).over(along)).where("failed = 0").select("stratum", F.col("step.no").alias("no"), (-F.col("step.down")).alias("cutoff"))
    return tested.join(rules, ["stratum", "no"]).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(featured: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """``featured`` (doc_id, lang, the features and any other columns) with ``_q_base_failed``, ``_q_rejected_by`` (rules) and ``_q_kept``."""
    shared_folder(featured.sparkSession)
    limits = cutoffs(featured, labels, limit, error).groupBy(F.col("stratum").alias("_q_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_q_cutoffs"))
    rows = featured.withColumn("_q_stratum", _stratum()).join(written(limits, "quality-limits"), "_q_stratum", "left")
    broken = F.filter(F.array(*[F.when(_share(r) >= F.col("_q_cutoffs")[r], F.lit(r)) for r in RULES]), lambda r: r.isNotNull())
    rows = rows.withColumns({"_q_base_failed": _base_failed(), "_q_rejected_by": broken})
    return rows.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.size("_q_rejected_by") == 0)).drop("_q_stratum", "_q_cutoffs")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document with its counts and the verdict; the texts are read once."""
    shared_folder(docs.sparkSession)
    rows = judge(with_features(docs.select("doc_id", "lang", "text")).drop("text").checkpoint(), labels)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"_q_{c}").cast("long").alias(c) for c in names],
        F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.array_join("_q_rejected_by", ",").alias("rejected_by"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns; the counts are written beside the texts, once."""
    main = ["doc_id", "lang", "text"]
    others = [c for c in docs.columns if c not in main]
    packed = docs.select(*main, *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")] if others else []))
    rows = judge(written(with_features(packed), "quality-counts"), labels).where("_q_kept")
    return rows.select(*[F.col(c) if c in main else F.col("others").getField(c) for c in docs.columns]).toDF(*docs.columns)


#: DuckDB SQL of op8_quality_rules.
ORACLE = r"""
with split as (
  select doc_id, lang, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l
  from documents),
grams as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from split where len(w) >= 5),
windows as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from grams),
again as (select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, least(5, coalesce(lead(i) over (partition by doc_id order by i) - i, 5)) as c from again),
repeated as (select doc_id, sum(c)::bigint as n_repeat_words from covered group by doc_id),
features as (
  select s.doc_id, coalesce('=' || lang, 'null') as stratum, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint as word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
         len(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_capitals, len(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_exclamations
  from split s left join repeated r on r.doc_id = s.doc_id),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from features),
shares as (
  select doc_id, stratum, base_failed, unnest([
    {'no': 1, 'rule': 'symbols', 'part': n_symbols, 'whole': n_words}, {'no': 2, 'rule': 'duplicate_lines', 'part': n_dup_lines, 'whole': n_lines},
    {'no': 3, 'rule': 'repeated_words', 'part': n_repeat_words, 'whole': n_words}, {'no': 4, 'rule': 'capitals', 'part': n_capitals, 'whole': word_chars},
    {'no': 5, 'rule': 'exclamations', 'part': n_exclamations, 'whole': n_words}], recursive := true)
  from judged),
shared as (select doc_id, stratum, base_failed, no, rule, case when whole > 0 then least(1000, 1000 * part // whole) else 0 end::bigint as share from shares),
known as (select doc_id, min(quality) > 0 as good from labels where doc_id is not null and quality is not null group by doc_id),
labelled as (select *, substr(md5('half:' || doc_id), 1, 1) >= '8' as holdout from shared join known using (doc_id) where not base_failed),
counts as (select stratum, rule, share, count(*) filter (good) as good, count(*) filter (not good) as bad from labelled where not holdout group by all),
running as (
  select stratum, rule, share as cutoff,
         (sum(bad) over a)::double / nullif(sum(bad) over g, 0) - 5 * coalesce((sum(good) over a)::double / nullif(sum(good) over g, 0), 0) as gain
  from counts window g as (partition by stratum, rule), a as (partition by stratum, rule order by share desc)),
best as (select * from running where gain > 0 and cutoff > 0 qualify row_number() over (partition by stratum, rule order by gain desc, cutoff desc) = 1),
designed as (select stratum, rule, cutoff, row_number() over (partition by stratum order by gain desc, rule) as turn from best),
good_rows as (select l.doc_id, stratum, turn, case when share >= cutoff then -share end as down from labelled l join designed using (stratum, rule) where holdout and good),
lost as (
  select stratum, step.turn as turn, step.down as down, count(*) as n
  from (select doc_id, stratum, min({'turn': turn, 'down': down}) filter (down is not null) as step from good_rows group by all) group by all),
total as (select stratum, sum(n) as total from lost group by all),
steps as (
  select stratum, turn, down, sum(n) as n
  from (select * from lost where turn is not null union all select stratum, turn, -cutoff, 0 from designed) group by all),
along as (select *, sum(n) over (partition by stratum order by turn, down) as k from steps join total using (stratum)),
tested as (
  select *, case when k >= total * 0.02 then 1.0 else list_sum(list_transform(range(0, k::bigint + 1),
      lambda j: exp(lgamma(total + 1) - lgamma(j + 1) - lgamma(total - j + 1) + j * ln(0.02) + (total - j) * ln(0.98)))) end
    <= 0.05 / (select count(distinct stratum) from labelled) as passes
  from along),
certified as (
  select stratum, rule, min(-down) as cutoff
  from (select *, max((not passes)::int) over (partition by stratum order by turn, down) as failed from tested) t join designed d using (stratum, turn) where failed = 0 group by all),
broken as (select doc_id, string_agg(rule, ',' order by no) as rejected_by from shared join certified using (stratum, rule) where share >= cutoff group by doc_id)
select j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rejected_by is null as kept, coalesce(rejected_by, '') as rejected_by
from judged j left join broken b on b.doc_id = j.doc_id
"""
