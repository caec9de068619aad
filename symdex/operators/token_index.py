"""Inverted index of a corpus for whole-word searches of many names at once.

A row of the index says how often a token stands in a line: (token, salt, path,
pattern_idx, line, n).  Tokens are the maximal runs of ASCII word characters and, so that every
name has a key, the runs of other characters without white space that stand between two of them.

* An occurrence of a name made of word characters, bounded by ASCII ``\\b``, is a
  token equal to it; one of a name without word characters is such a run in between.  Both are
  read off the index, no text is looked at.
* Any other name holds word tokens that stand in the line as whole tokens: the name is keyed by the
  one that the fewest lines hold, and only those lines are tested with its pattern.

Frequent tokens are dealt to ``TOKEN_SALTS`` groups.  The plan is the same at every
size; how the sides of a join are brought together is left to the planner and its measured sizes.
A caller that keeps the index of its corpus as a table hands it over; otherwise the tokens of a batch's
own names are indexed for the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdex.functions.regex import WORD
from symdex.schemas import APART, SNIPPET_SEPARATOR
from symdex.session import ensure_checkpoint_dir

WORD_TOKEN = f"[{WORD}]+"
#: Word tokens, and runs without white space between two of them.
TOKEN = rf"[{WORD}]+|(?<=[{WORD}])[^{WORD}\s]+(?=[{WORD}])"
#: Rows of one token are dealt to so many groups; the names are repeated in each.
TOKEN_SALTS = 32


def token_lines(files: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The index of ``files`` (path, pattern_idx, content): one row a token and line; a path listed twice counts twice.

    ``only`` (token) keeps the index of one batch of names to their tokens, before anything is shuffled.
    """
    lines = files.select("path", "pattern_idx", F.posexplode(F.split(F.col("content"), "\n", -1)).alias("i", "text"))
    tokens = lines.select("path", "pattern_idx", (F.col("i") + 1).alias("line"),
                          F.explode_outer(F.regexp_extract_all(F.col("text"), F.lit(TOKEN), 0)).alias("token"))
    salt = F.pmod(F.xxhash64("path", "line"), F.lit(TOKEN_SALTS)).cast("int")
    tokens = tokens.where(F.col("token").isNotNull())
    if only is not None:
        tokens = tokens.join(only, "token", "left_semi")
    return tokens.groupBy("token", "path", "pattern_idx", "line").agg(
        F.count(F.lit(1)).cast("int").alias("n")).select("token", salt.alias("salt"), "path", "pattern_idx", "line", "n")


def token_counts(index: DataFrame) -> DataFrame:
    """(token, n_lines): how many lines hold each token."""
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("n_lines"))


def boundary_pattern(name: Column) -> Column:
    """Per-row pattern of a name between ASCII word boundaries (Q23, Q24)."""
    return F.concat(
        F.when(name.rlike(f"^[{WORD}]"), F.lit(f"(?<![{WORD}])")).otherwise(F.lit(f"(?<=[{WORD}])")),
        escaped(name),
        F.when(name.rlike(rf"[{WORD}]\z"), F.lit(f"(?![{WORD}])")).otherwise(F.lit(f"(?=[{WORD}])")),
    )


def escaped(name: Column) -> Column:
    return F.regexp_replace(name, r"[\\^$.|?*+()\[\]{}]", r"\\$0")


def occurrence_columns(text: Column, pattern: Column, name: Column) -> Column:
    """Start columns (1-based, code points) of all matches of ``name`` in a line: a running sum over the gaps, in the row."""
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))
    run = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), start, lambda acc, gap: F.struct(
        (acc["at"] + F.length(gap) + F.length(name)).alias("at"),
        F.concat(acc["found"], F.array(acc["at"] + F.length(gap))).alias("found")))
    return run["found"]


def snippet_of(lines: Column, line: Column) -> Column:
    start = F.greatest(line - 1, F.lit(1))
    return F.array_join(F.slice(lines, start, F.least(line + 1, F.size(lines)) - start + 1), SNIPPET_SEPARATOR)


def name_tokens(names: DataFrame) -> DataFrame:
    """(name, token): the word tokens of every name, or the name itself where it has none."""
    words = F.array_distinct(F.regexp_extract_all(F.col("name"), F.lit(WORD_TOKEN), 0))
    nm = names.select("name").where(F.trim("name") != "").distinct()
    return nm.select("name", F.explode(F.when(F.size(words) == 0, F.array("name")).otherwise(words)).alias("token"))


def keyed_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, token, direct): the token each name is looked up by, and whether the index alone answers it.

    Names that hold a token that no line holds stand nowhere and are left out, and so do
    empty names and names of white space only.
    """
    best = name_tokens(names).join(counts.hint(APART), "token", "left").groupBy("name").agg(
        F.min_by("token", F.struct("n_lines", "token")).alias("token"), F.min(F.col("n_lines").isNotNull()).alias("_all"))
    return best.where("_all").select("name", "token", (F.col("token") == F.col("name")).alias("direct"))


def name_lines(files: DataFrame, names: DataFrame, index: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(name, path, pattern_idx, line, n): how often each name stands in each line."""
    if index is None:
        # the names' own tokens only; read for the counts and for every kind of name, so the corpus is scanned once
        ensure_checkpoint_dir(files.sparkSession)
        index = token_lines(files, name_tokens(names).select("token").distinct()).checkpoint()
    if counts is None:
        counts = token_counts(index)
    keyed = keyed_names(names, counts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(TOKEN_SALTS - 1))))
    found = index.join(keyed.hint(APART), ["token", "salt"])
    direct = found.where("direct").select("name", "path", "pattern_idx", "line", "n")
    tested = lines_of(files, found.where(~F.col("direct")).select("name", "path", "pattern_idx", "line").distinct())
    n = F.size(F.split(F.col("text"), boundary_pattern(F.col("name")), -1)) - 1
    tested = tested.groupBy("name", "path", "pattern_idx", "line").agg(F.sum(n).cast("int").alias("n")).where("n > 0")
    return direct.unionByName(tested)


def lines_of(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (name, path, pattern_idx, line) with the line's text and snippet; each file is read once for all its lines."""
    per_file = wanted.groupBy("path", "pattern_idx").agg(F.collect_list(F.struct("line", "name")).alias("wanted"))
    rows = files.select("path", "pattern_idx", "content").join(per_file, ["path", "pattern_idx"])
    lines = F.split(F.col("content"), "\n", -1)
    rows = rows.select("path", "pattern_idx", F.explode(_cut(lines, F.col("wanted"))).alias("w"))
    return rows.select("w.name", "path", "pattern_idx", "w.line", "w.text", "w.snippet")


def _cut(lines: Column, wanted: Column) -> Column:
    from symdex.functions.columns import let

    return let(lines, lambda all_lines: F.transform(wanted, lambda w: F.struct(
        w["name"].alias("name"), w["line"].alias("line"), F.try_element_at(all_lines, w["line"]).alias("text"),
        snippet_of(all_lines, w["line"]).alias("snippet"))))


def occurrences(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row an occurrence in ``wanted`` (name, path, pattern_idx, line): name, path, pattern_idx, line, snippet, column."""
    name = F.col("name")
    at = occurrence_columns(F.col("text"), boundary_pattern(name), name)
    return lines_of(files, wanted).select("name", "path", "pattern_idx", "line", "snippet", F.explode(at).alias("column"))
