"""Whole-word usages of symbols across a corpus.

Plan shape for one symbol (:func:`find_usages`):

* every file row is scanned once, in place: a cheap ``contains`` prefilter,
  then the line array is filtered by the boundary regex and each matching
  line keeps its 3-line snippet cut from the same array (no per-file window,
  no shuffle);
* the first ``M`` matching *lines* are taken with a partial top-k
  (``TakeOrderedAndProject``), and only those lines are expanded into
  occurrences, because each matching line holds at least one occurrence;
* the exact totals are a separate map-side-combined count.

The definition file is looked up through a one-row DataFrame (``limit 1``,
a proven size bound) that is broadcast into the scan.

Many symbols at once (:func:`usage_scan_batch`) go through the inverted index of ``token_index``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symdex.functions import regex as RX
from symdex.operators import token_index as TI
from symdex.functions.columns import kept, let
from symdex.operators.search import lookup_symbol
from symdex.schemas import SNIPPET_SEPARATOR, USAGE_LIMIT

USAGE_EXTENSIONS = ("ts", "tsx", "js", "jsx")  # listing order of the four default patterns


def with_listing_order(files: DataFrame, extensions=USAGE_EXTENSIONS, keep_others: bool = False) -> DataFrame:
    """Keep files whose (case-sensitive) extension is listed; ``pattern_idx`` = its position (0 for the others, if kept)."""
    ext = F.regexp_extract(F.col("path"), r"\.([^./]+)$", 1)
    idx = F.array_position(F.array(*[F.lit(e) for e in extensions]), ext)
    numbered = files.withColumn("pattern_idx", idx.cast("int"))
    return numbered.withColumn("pattern_idx", F.coalesce("pattern_idx", F.lit(0))) if keep_others else numbered.where(F.col("pattern_idx") > 0)


def split_lines(files: DataFrame) -> DataFrame:
    """A3: one row per line, 1-based, the trailing empty line kept."""
    return files.select("path", F.posexplode(F.split(F.col("content"), "\n", -1)).alias("pos", "text")).select(
        "path", (F.col("pos") + 1).alias("line"), "text")


def snippet(lines: Column, line: Column) -> Column:
    """Previous, current and next line, clipped at the file ends, joined by a literal backslash-n."""
    start = F.greatest(line - 1, F.lit(1))
    stop = F.least(line + 1, F.size(lines))
    return F.array_join(F.slice(lines, start, stop - start + 1), SNIPPET_SEPARATOR)


def matching_lines(files: DataFrame, pattern: str, literal: str | None = None) -> DataFrame:
    """Lines of every file that match ``pattern``, with snippet; no shuffle.

    ``literal`` is a substring every match contains; files without it are
    skipped before the content is split.
    """
    df = files
    if literal:
        df = df.where(F.col("content").contains(literal))
    lines = F.split(F.col("content"), "\n", -1)
    hits = F.filter(
        F.transform(lines, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"))),
        lambda x: x["text"].rlike(pattern),
    )
    keep = [c for c in df.columns if c != "content"]
    # explode_outer + a null test: a plain explode makes Catalyst infer (and push
    # down) a ``size(hits) > 0`` filter, running the line regex twice
    return (
        df.select(*keep, lines.alias("_lines"), F.explode_outer(hits).alias("_h"))
        .where(F.col("_h").isNotNull())
        .select(*keep, F.col("_h.line").alias("line"), F.col("_h.text").alias("text"),
                snippet(F.col("_lines"), F.col("_h.line")).alias("snippet"))
    )


def matching_keys(files: DataFrame, pattern: str, literal: str) -> DataFrame:
    """(path, pattern_idx, line, n_occ) of every line that matches; no text leaves the scan."""
    lines = F.split(F.col("content"), "\n", -1)
    counted = F.transform(lines, lambda t, i: F.struct((i + 1).alias("line"), _occurrence_count(t, pattern).alias("n_occ")))
    hits = F.filter(counted, lambda x: x["n_occ"] > 0)
    rows = files.where(F.col("content").contains(literal)).select("path", "pattern_idx", F.explode_outer(hits).alias("h"))
    return rows.where(F.col("h").isNotNull()).select("path", "pattern_idx", "h.line", "h.n_occ")


def _occurrence_count(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def occurrences_in_line(text: Column, pattern: str, name_len: int, first_n: int) -> Column:
    """Start columns (1-based, code points) of the first ``first_n`` matches in a line.

    Uses the gaps between matches; cost is quadratic in ``first_n`` only, so it
    is used where ``first_n`` is a small bound (the response limit).
    """
    gaps = F.slice(F.split(text, pattern, -1), 1, first_n + 1)
    n = F.least(F.size(gaps) - 1, F.lit(first_n))
    return F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda k: F.aggregate(F.slice(gaps, 1, k), F.lit(1), lambda a, g: a + F.length(g)) + (k - 1) * name_len,
    )


def usage_scan(files: DataFrame, name: str) -> DataFrame:
    """Every whole-word occurrence of ``name`` (path, line, column, snippet).

    Columns are a running sum over the gaps between the matches of a line, worked out in the row: one
    scan stage, no shuffle.
    """
    pattern = RX.whole_word(name)
    hits = matching_lines(files, pattern, name)
    at = TI.occurrence_columns(F.col("text"), F.lit(pattern), F.lit(name))
    return hits.select(*[c for c in hits.columns if c != "text"], F.explode(at).alias("column"))


def locate_definition(def_files: DataFrame, name: str) -> DataFrame:
    """Definition rows of ``name`` in the given file(s) (Q5), computed inside each file row.

    A line matches when any of the four patterns does; the column is the start
    of the first pattern (in priority order) that matches.  Rows are the match
    on line 1 (if any) plus the first match after line 1.  No shuffle.
    """
    pats = RX.definition_patterns(name)
    any_pat = "|".join(f"(?:{p})" for p in pats)
    df = def_files.where(F.col("content").contains(name))
    keep = [c for c in df.columns if c != "content"]
    lines = F.split(F.col("content"), "\n", -1)

    def column_of(text):
        col = None
        for p in pats:
            pos = F.length(F.try_element_at(F.split(text, p, 2), F.lit(1))) + 1
            col = F.when(text.rlike(p), pos) if col is None else col.when(text.rlike(p), pos)
        return col.cast("int")

    def pick(all_lines):
        hits = F.filter(F.transform(all_lines, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"))),
                        lambda x: x["text"].rlike(any_pat))
        first_after = F.array_min(F.transform(F.filter(hits, lambda x: x["line"] > 1), lambda x: x["line"]))
        chosen = F.filter(hits, lambda x: (x["line"] == 1) | (x["line"] == first_after))
        return F.transform(chosen, lambda x: F.struct(
            x["line"].alias("line"), column_of(x["text"]).alias("column"),
            snippet(all_lines, x["line"]).alias("snippet")))

    rows = df.select(*keep, F.explode_outer(let(lines, pick)).alias("d")).where(F.col("d").isNotNull())
    return rows.select(*keep, F.col("d.line").alias("line"), F.col("d.column").alias("column"),
                       F.col("d.snippet").alias("snippet"))


def _one_row(df: DataFrame) -> DataFrame:
    """Tag a DataFrame of at most one row for a broadcast constant-key join."""
    return F.broadcast(df.withColumn("_one", F.lit(1)))


def find_usages(
    files: DataFrame,
    symbols: DataFrame,
    symbol,
    type: str | None = None,
    file: str | None = None,
    include_definition: bool = True,
    max_results: int | None = USAGE_LIMIT,
    extensions=USAGE_EXTENSIONS,
) -> tuple[DataFrame, DataFrame]:
    """(usage rows, totals row).

    Usage rows: symbol, type, file, line, column, snippet, is_definition,
    usage_rank.  Totals: symbol, type, total_found, limit_reached, true_total
    with the reference's capped count (Q6) and the exact one.  An unknown
    symbol gives no rows and type = the requested type or ``unknown``.
    """
    spark = files.sparkSession
    if not symbol or not isinstance(symbol, str):
        rows = spark.createDataFrame(
            [], "symbol string, type string, file string, line int, column int, snippet string, "
                "is_definition boolean, usage_rank int")
        return rows, spark.createDataFrame(
            [("", "", 0, False, 0)], "symbol string, type string, total_found int, limit_reached boolean, true_total long")
    M = max_results or USAGE_LIMIT
    # limit 1: a proven one-row side, safe to broadcast
    found = lookup_symbol(symbols, symbol, type, file).select(
        F.col("file").alias("def_file"), F.col("type").alias("def_type")).persist(StorageLevel.MEMORY_AND_DISK)

    content = files.select("path", "content")
    pattern = RX.whole_word(symbol)
    if include_definition:
        def_src = content.join(F.broadcast(found), content.path == found.def_file, "left_semi")
        defs = locate_definition(def_src, symbol).select(
            "path", "line", "column", "snippet", F.lit(True).alias("is_definition"), F.lit(0).alias("pattern_idx"))
    else:
        defs = spark.createDataFrame([], "path string, line int, column int, snippet string, "
                                         "is_definition boolean, pattern_idx int")

    listed = with_listing_order(content, extensions)
    if include_definition:  # C11: the whole definition file is skipped (Q7)
        listed = listed.join(F.broadcast(found), listed.path == found.def_file, "left_anti")
    # matching lines as keys and counts, read by the exact count and by the top-k; texts and snippets are cut
    # only for the lines that are answered
    lines = matching_keys(listed, pattern, symbol)

    # Exact counts, combined map-side
    n_other = lines.agg(F.coalesce(F.sum("n_occ"), F.lit(0)).cast("long").alias("n_other"))
    n_def = defs.agg(F.count(F.lit(1)).cast("long").alias("n_def"))
    stats = _one_row(found).join(_one_row(n_def), "_one").join(_one_row(n_other), "_one")

    # F8: definition rows first, then listing order, line, column.  The first
    # max(M, 2) matching lines hold every occurrence that can be returned.
    take = max(M, 2)
    top_lines = lines.orderBy("pattern_idx", "path", "line").limit(take)
    wanted = F.broadcast(top_lines.groupBy("path", "pattern_idx").agg(F.collect_list("line").alias("wanted")))  # ``take`` lines at most
    cut = listed.join(wanted, ["path", "pattern_idx"]).select("path", "pattern_idx", F.explode(let(F.split("content", "\n", -1), lambda all_lines: F.transform(
        "wanted", lambda n: F.struct(n.alias("line"), F.try_element_at(all_lines, n).alias("text"), snippet(all_lines, n).alias("snippet"))))).alias("w"))
    occ = cut.select("path", "pattern_idx", "w.line", "w.snippet", F.explode(occurrences_in_line(F.col("w.text"), pattern, len(symbol), take)).alias("column"))
    others = occ.select("path", "line", "column", "snippet", F.lit(False).alias("is_definition"), "pattern_idx")
    keys = [F.col("is_definition").desc(), "pattern_idx", "path", "line", "column"]
    ranked = defs.unionByName(others).orderBy(*keys).limit(take + 2)
    ranked = ranked.withColumn("usage_rank", F.row_number().over(Window.orderBy(*keys)))
    # returned = min(D + N, max(D, M)) rows (Q6); nothing when the symbol is unknown
    rows = ranked.withColumn("_one", F.lit(1)).join(stats, "_one").where(
        F.col("usage_rank") <= F.greatest(F.col("n_def"), F.lit(M))).select(
        F.lit(symbol).alias("symbol"), F.col("def_type").alias("type"), F.col("path").alias("file"),
        "line", "column", "snippet", "is_definition", "usage_rank")

    cap = F.greatest(F.col("n_def"), F.lit(M))
    total = F.col("n_def") + F.col("n_other")
    answer = stats.select(
        F.lit(symbol).alias("symbol"), F.col("def_type").alias("type"),
        F.least(total, cap + 1).cast("int").alias("total_found"),
        (total > cap).alias("limit_reached"),
        total.cast("long").alias("true_total"),
    )
    missing = spark.createDataFrame([(symbol, type or "unknown", 0, False, 0)],
                                    "symbol string, type string, total_found int, limit_reached boolean, true_total long")
    both = answer.withColumn("_hit", F.lit(1)).unionByName(missing.withColumn("_hit", F.lit(0)))
    totals = both.agg(F.max_by(F.struct(*answer.columns), F.col("_hit")).alias("r")).select("r.*")
    return kept(rows, found), kept(totals, found)


def usage_scan_batch(files: DataFrame, names: DataFrame, index: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Every whole-word occurrence of every name in ``names(name)``.

    Lines are found by the inverted index (``token_index``; built from ``files`` when no stored one is given), then the
    files that hold one are read for columns and snippets.  One plan, whatever the number of names.

    Output: name, path, pattern_idx (0 where ``files`` has none), line, column, snippet.
    """
    if "pattern_idx" not in files.columns:
        files = files.withColumn("pattern_idx", F.lit(0))
    wanted = TI.name_lines(files, names, index, counts).select("name", "path", "pattern_idx", "line").distinct()
    return TI.occurrences(files, wanted)
