"""Usage keys on ``doc_files``.

The symbol looked up is derived from the corpus itself: a one-row symbol
table naming the first ``.ts`` document (by path) that holds the word.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from symdex.functions import regex as RX
from symdex.operators import usages as U
from symdex.plans.catalog import register
from symdex.sources.fixtures import load_view, with_views

RE2_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LIMIT = 50


def _files(spark, sf):
    return load_view(spark, sf, "doc_files").select("path", "content")


def corpus_symbol(files, word: str):
    """One symbol row for ``word``: defined in the first .ts file that holds it."""
    hit = files.where(F.col("path").endswith(".ts") & F.col("content").rlike(RX.whole_word(word)))
    return hit.agg(F.min("path").alias("file")).select(
        F.lit(1).cast("long").alias("ord"), F.lit(word).alias("symbol"), F.lit("function").alias("type"), "file",
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("signature"),
        F.lit(True).alias("exported"), F.lit(None).cast("string").alias("parent_symbol"),
        F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (
            ("is_component", "boolean"), ("visibility", "string"), ("route_method", "string"),
            ("route_path", "string"), ("handler", "string"))]).alias("metadata"),
    )


# --- DuckDB building blocks ----------------------------------------------------

def _def_file_sql(word: str) -> str:
    return (f"select min(path) as def_file from doc_files where ends_with(path, '.ts') "
            f"and regexp_matches(content, '\\b{word}\\b')")


_LINES = (
    "lines as (select path, pattern_idx, unnest(generate_series(1, len(arr))) as line, unnest(arr) as text, arr "
    "from (select path, string_split(content, chr(10)) as arr, "
    "case regexp_extract(path, '\\.([^./]+)$', 1) when 'ts' then 1 when 'tsx' then 2 when 'js' then 3 "
    "when 'jsx' then 4 else 0 end as pattern_idx from doc_files) f)"
)
_SNIPPET = "array_to_string(arr[greatest(line - 1, 1):least(line + 1, len(arr))], '\\n')"


def _def_patterns(word: str) -> list[str]:
    return [f"\\b{word}{RE2_SPACE}*\\(", f"\\b{word}{RE2_SPACE}*\\{{", f"\\b{word}{RE2_SPACE}*:",
            f"\\bfunction{RE2_SPACE}+{word}\\b"]


def _defs_sql(word: str, only_def_file: bool = True) -> str:
    pats = _def_patterns(word)
    anyp = "|".join(f"(?:{p})" for p in pats)
    col = "case " + " ".join(
        f"when regexp_matches(text, '{p}') then length(string_split_regex(text, '{p}')[1]) + 1" for p in pats) + " end"
    where = "path = (select def_file from d)" if only_def_file else "true"
    return (
        f"dl as (select path, line, cast({col} as integer) as \"column\", {_SNIPPET} as snippet from lines "
        f"where {where} and contains(text, '{word}') and regexp_matches(text, '{anyp}')), "
        "defs as (select dl.* from dl where line = 1 or line = (select min(line) from dl d2 where d2.path = dl.path and d2.line > 1))"
    )


def _occ_sql(word: str, skip_def: bool = True) -> str:
    skip = "and path <> coalesce((select def_file from d), '')" if skip_def else ""
    return (
        f"ml as (select path, pattern_idx, line, text, {_SNIPPET} as snippet, string_split_regex(text, '\\b{word}\\b') as g "
        f"from lines where pattern_idx > 0 {skip} and regexp_matches(text, '\\b{word}\\b')), "
        "occ as (select path, pattern_idx, line, snippet, cast(1 + list_sum(list_transform(g[1:k], lambda x: length(x))) "
        f"+ (k - 1) * {len(word)} as integer) as \"column\" from ml, unnest(range(1, len(g))) as t(k))"
    )


def _usages_sql(word: str, limit: int) -> str:
    return with_views(
        f"with d as ({_def_file_sql(word)}), {_LINES}, {_defs_sql(word)}, {_occ_sql(word)}, "
        "u as (select path, line, \"column\", snippet, true as is_definition, 0 as pattern_idx from defs "
        "union all select path, line, \"column\", snippet, false, pattern_idx from occ), "
        "r as (select *, row_number() over (order by is_definition desc, pattern_idx, path, line, \"column\") as usage_rank from u) "
        f"select '{word}' as symbol, 'function' as type, path as file, line, \"column\", snippet, is_definition, "
        f"cast(usage_rank as integer) as usage_rank from r "
        f"where usage_rank <= greatest((select count(*) from defs), {limit})",
        "doc_files",
    )


def _totals_sql(word: str, limit: int) -> str:
    return with_views(
        f"with d as ({_def_file_sql(word)}), {_LINES}, {_defs_sql(word)}, {_occ_sql(word)}, "
        "c as (select (select count(*) from defs) as nd, (select count(*) from occ) as no) "
        f"select '{word}' as symbol, 'function' as type, cast(least(nd + no, greatest(nd, {limit}) + 1) as integer) as total_found, "
        f"nd + no > greatest(nd, {limit}) as limit_reached, cast(nd + no as bigint) as true_total from c",
        "doc_files",
    )


def _usages(spark, sf, word, limit=LIMIT):
    files = _files(spark, sf)
    return U.find_usages(files, corpus_symbol(files, word), word, "function", max_results=limit)


@register("find_usages", _usages_sql("the", LIMIT))
def find_usages(spark, sf):
    return _usages(spark, sf, "the")[0]


@register("find_usages_definition", _usages_sql("1", LIMIT))
def find_usages_definition(spark, sf):
    return _usages(spark, sf, "1")[0]


@register("limit_usages", _usages_sql("555", 7))
def limit_usages(spark, sf):
    return _usages(spark, sf, "555", 7)[0]


@register("usage_totals", _totals_sql("the", LIMIT))
def usage_totals(spark, sf):
    return _usages(spark, sf, "the")[1]


@register("usage_totals_definition", _totals_sql("1", LIMIT))
def usage_totals_definition(spark, sf):
    return _usages(spark, sf, "1")[1]


@register("usage_scan", with_views(
    f"with d as (select null as def_file), {_LINES}, {_occ_sql('the', skip_def=False)} "
    "select path, pattern_idx, line, snippet, \"column\" from occ", "doc_files"))
def usage_scan(spark, sf):
    return U.usage_scan(U.with_listing_order(_files(spark, sf)), "the")


@register("skip_definition_file", with_views(
    f"with d as ({_def_file_sql('the')}), {_LINES}, {_occ_sql('the')} "
    "select path, count(*) as occurrences from occ group by path", "doc_files"))
def skip_definition_file(spark, sf):
    files = _files(spark, sf)
    found = corpus_symbol(files, "the").select(F.col("file").alias("def_file"))
    listed = U.with_listing_order(files).join(F.broadcast(found), F.col("path") == F.col("def_file"), "left_anti")
    return U.usage_scan(listed, "the").groupBy("path").agg(F.count(F.lit(1)).alias("occurrences"))


@register("locate_definition", with_views(
    f"with d as (select null as def_file), {_LINES}, {_defs_sql('1', only_def_file=False)} "
    "select path, line, \"column\", snippet from defs", "doc_files"))
def locate_definition(spark, sf):
    return U.locate_definition(_files(spark, sf), "1").select("path", "line", "column", "snippet")


@register("snippet_context", with_views(
    f"with {_LINES} select path, line, {_SNIPPET} as snippet from lines "
    "where regexp_matches(text, '\\bthe\\b')", "doc_files"))
def snippet_context(spark, sf):
    return U.matching_lines(_files(spark, sf), RX.whole_word("the"), "the").select("path", "line", "snippet")


@register("split_lines", with_views(f"with {_LINES} select path, line, text from lines", "doc_files"))
def split_lines(spark, sf):
    return U.split_lines(_files(spark, sf))
