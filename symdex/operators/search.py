"""Symbol search, completion and lookup.

One request is a filter -> rank -> top-k chain that Catalyst turns into a
pushed-down scan plus ``TakeOrderedAndProject`` (a partial top-k per task,
no full shuffle).  Many requests at once go through :func:`rank_within_request`,
which joins the requests to an n-gram index of the symbol names instead of
comparing every request with every symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symdex.functions.columns import is_private, parse_symbol_type, parse_symbol_type_col, type_priority
from symdex.schemas import APART, AUTOCOMPLETE_LIMIT, SEARCH_LIMIT

OUTPUT_COLUMNS = [
    "ord", "symbol", "type", "file", "description", "signature", "exported", "parent_symbol", "visibility",
]


def flatten(symbols: DataFrame) -> DataFrame:
    """Symbol rows with ``metadata.visibility`` lifted to a column (other columns kept)."""
    extra = [c for c in symbols.columns if c not in OUTPUT_COLUMNS and c != "metadata"]
    return symbols.select(*[c for c in OUTPUT_COLUMNS if c != "visibility"],
                          F.col("metadata.visibility").alias("visibility"), *extra)


# --- filters (B4-B8) ---------------------------------------------------------

def filter_type(symbols: DataFrame, kind: str | None) -> DataFrame:
    return symbols if kind is None else symbols.filter(F.col("type") == kind)


def filter_file(symbols: DataFrame, file: str | None) -> DataFrame:
    """Case-sensitive substring of the path; empty means no filter."""
    return symbols if not file else symbols.filter(F.col("file").contains(file))


def filter_private(symbols: DataFrame, include_private: bool = False) -> DataFrame:
    if include_private:
        return symbols
    return symbols.filter(~is_private(F.col("symbol"), F.col("metadata.visibility")))


def match_exact(symbols: DataFrame, query: str) -> DataFrame:
    return symbols.filter(F.col("symbol") == F.lit(query))


def match_substring(symbols: DataFrame, query: str) -> DataFrame:
    """Case-insensitive contains; the empty query matches everything (Q2)."""
    return symbols.filter(F.lower("symbol").contains(F.lower(F.lit(query))))


# --- ranking (F1, F2) --------------------------------------------------------

def rank_keys(term: Column) -> list[Column]:
    """Exact name first, exported first (null = false), kind priority, insertion order."""
    return [
        F.coalesce(F.col("symbol") == term, F.lit(False)).desc(),
        F.coalesce(F.col("exported"), F.lit(False)).desc(),
        type_priority(F.col("type")).asc(),
        F.col("ord").asc(),
    ]


def limit_results(ranked: DataFrame, keys: list[Column], limit: int | None) -> DataFrame:
    """Top-``limit`` with a 1-based ``rank``; ``limit <= 0`` keeps every row (Q4).

    The rank is numbered after the cut, on at most ``limit`` rows.  Without a
    limit the result stays a distributed sort and carries no rank column
    numbering (a global ``row_number`` would pull all rows into one task).
    """
    if limit is None:
        limit = SEARCH_LIMIT
    if limit > 0:
        top = ranked.orderBy(*keys).limit(limit)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))
    return ranked.orderBy(*keys).withColumn("rank", F.lit(None).cast("int"))


def rank_symbols(symbols: DataFrame, query: str, with_keys: bool = False) -> DataFrame:
    """F1 over the whole input: a distributed sort, optionally exposing the keys."""
    out = symbols.orderBy(*rank_keys(F.lit(query)))
    if with_keys:
        out = out.select(
            "*",
            F.coalesce(F.col("symbol") == F.lit(query), F.lit(False)).alias("is_exact"),
            F.coalesce(F.col("exported"), F.lit(False)).alias("is_exported"),
            type_priority(F.col("type")).alias("priority"),
        )
    return out


def search_symbols(
    symbols: DataFrame,
    query: str,
    type: str | None = None,
    file: str | None = None,
    exact_match: bool = False,
    include_private: bool = False,
    limit: int | None = SEARCH_LIMIT,
) -> DataFrame:
    """filters B4-B8, ranking F1, cut F2.  ``type`` is a kind name or None."""
    kind = parse_symbol_type(type) if type is not None else None
    df = filter_type(symbols, kind)
    df = filter_file(df, file)
    df = filter_private(df, include_private)
    df = match_exact(df, query) if exact_match else match_substring(df, query)
    return limit_results(df, rank_keys(F.lit(query)), limit)


def search_project_symbols(symbols: DataFrame, query, type=None, file=None, exact_match=False,
                           include_private=False, limit=None) -> DataFrame:
    """Tool form: empty / non-string query -> no rows."""
    if not query or not isinstance(query, str):
        return limit_results(symbols.limit(0), rank_keys(F.lit("")), 1)
    return search_symbols(symbols, query, type, file, bool(exact_match), bool(include_private), limit)


def project_completions(ranked: DataFrame) -> DataFrame:
    """(symbol, type, signature, description, file_path) plus the rank."""
    return ranked.select("symbol", "type", "signature", "description", F.col("file").alias("file_path"), "rank")


def autocomplete_symbols(symbols: DataFrame, prefix, type=None, limit=None, include_private=False) -> DataFrame:
    """substring completion; limit missing/0 -> 10, negative -> all (Q4)."""
    if not prefix or not isinstance(prefix, str):
        return project_completions(limit_results(symbols.limit(0), rank_keys(F.lit("")), 1))
    lim = limit or AUTOCOMPLETE_LIMIT
    ranked = search_symbols(symbols, prefix, type, None, False, bool(include_private), lim)
    return project_completions(ranked)


def lookup_symbol(symbols: DataFrame, symbol: str, type: str | None = None, file: str | None = None) -> DataFrame:
    """exact name, private included, best-ranked single row."""
    return search_symbols(symbols, symbol, type, file, exact_match=True, include_private=True, limit=1)


# --- many requests at once (E4) ----------------------------------------------

#: Rows of one gram are dealt to so many groups; the searches are repeated in each.
GRAM_SALTS = 32
#: What the filters and the ranking of a search read; the index carries it, so candidates need no other table.
RANK_COLUMNS = ("ord", "symbol", "type", "file", "exported", "visibility")


def gram_index(symbols: DataFrame, sizes=(1, 2, 3)) -> DataFrame:
    """Distinct lower-case n-grams of every symbol name: (gram, salt, ord, symbol, type, file, exported, visibility).

    A name that contains a term contains every gram of the term, so an equi-join on one
    of them followed by the ``contains`` test is exact.  The rows carry all that
    filters and ranking read.  Build once per symbol table and use it for every request batch.
    """
    low = F.lower(F.col("symbol"))

    def of_size(g: int) -> Column:
        return F.when(F.length(low) >= g, F.transform(F.sequence(F.lit(1), F.length(low) - (g - 1)), lambda i: F.substring(low, i, g)))

    every = F.array_distinct(F.flatten(F.array_compact(F.array(*[of_size(g) for g in sizes]))))
    rows = flatten(symbols).select(*RANK_COLUMNS, F.explode_outer(every).alias("gram")).where(F.col("gram").isNotNull())
    return rows.select("gram", F.pmod(F.xxhash64("ord"), F.lit(GRAM_SALTS)).cast("int").alias("salt"), *RANK_COLUMNS)


def grams_asked(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """The rows of :func:`gram_index` whose gram the term of a request holds, for a batch without a stored index.

    The distinct grams of a batch's terms are few and short: they go to the tasks that spell out the names,
    so the other grams of the symbols are neither shuffled nor counted.
    """
    wanted = requests.select(F.explode(_term_grams(F.col("term"))).alias("gram")).distinct()
    return gram_index(symbols).join(F.broadcast(wanted), "gram", "left_semi")


def gram_counts(grams: DataFrame) -> DataFrame:
    """(gram, n): how many symbols hold each gram."""
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _term_grams(term: Column) -> Column:
    """The grams of a term, of the size that its search joins on."""
    low = F.lower(term)
    size = F.least(F.length(low), F.lit(3))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - size + 1), lambda i: F.substring(low, i, size)))


def rarest_gram(specs: DataFrame, counts: DataFrame) -> DataFrame:
    """``specs`` (spec, term, ...) with ``gram``: the one of the term's grams that the fewest symbols hold.

    A term with a gram that no symbol holds is in no name and is left out.
    """
    pairs = specs.select("spec", F.explode(_term_grams(F.col("term"))).alias("gram"))
    known = pairs.join(counts.hint(APART), "gram", "left").groupBy("spec").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min(F.col("n").isNotNull()).alias("_all"))
    return specs.join(known.where("_all").drop("_all").hint(APART), "spec")


SPEC_FIELDS = ("term", "kind", "file_filter", "exact_match", "include_private", "k")


def with_spec(requests: DataFrame, default_limit: int = SEARCH_LIMIT) -> DataFrame:
    """Requests (term, type, file, exact_match, include_private, limit) with a ``term``, their search spelled out as ``spec`` and its fields."""
    fields = {
        "term": F.col("term"), "kind": parse_symbol_type_col(F.col("type")), "file_filter": F.when(F.col("file") != "", F.col("file")),
        "exact_match": F.coalesce(F.col("exact_match"), F.lit(False)), "include_private": F.coalesce(F.col("include_private"), F.lit(False)),
        "k": F.greatest(F.coalesce(F.col("limit"), F.lit(default_limit)), F.lit(0)).cast("int"),
    }
    asked = requests.where(F.col("term").isNotNull() & (F.col("term") != ""))
    asked = asked.withColumn("_fields", F.struct(*[c.alias(n) for n, c in fields.items()]))
    return asked.select("*", F.to_json("_fields").alias("spec"))


def matches(asked: DataFrame, symbols: DataFrame, grams: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(spec, term, k, RANK_COLUMNS): every symbol that a search of ``asked`` (see :func:`with_spec`) matches.

    A batch repeats the same search many times; each is done once.  Exact searches join
    on the name; the others join the gram index on their rarest gram.  Without a stored index, only the grams that the
    batch asks for are spelled out, and they are never broadcast: the planner takes them for as small as the symbols' file.
    """
    specs = asked.select("spec", "_fields.*").distinct()
    stored = grams is not None
    if not stored:
        grams = grams_asked(specs.where(~F.col("exact_match")), symbols)
    if counts is None:
        counts = gram_counts(grams)
    flat = flatten(symbols).select(*RANK_COLUMNS)
    exact = flat.join(specs.where("exact_match").hint(APART), flat.symbol == specs.term)
    loose = rarest_gram(specs.where(~F.col("exact_match")), counts).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(GRAM_SALTS - 1))))
    sub = grams.join(loose if stored else loose.hint(APART), ["gram", "salt"]).where(F.lower(F.col("symbol")).contains(F.lower(F.col("term"))))
    cols = [*RANK_COLUMNS, "spec", *SPEC_FIELDS]
    return exact.select(*cols).unionByName(sub.select(*cols)).where(
        (F.col("kind").isNull() | (F.col("type") == F.col("kind")))
        & (F.col("file_filter").isNull() | F.col("file").contains(F.col("file_filter")))
        & (F.col("include_private") | ~is_private(F.col("symbol"), F.col("visibility")))
    ).select("spec", "term", "k", *RANK_COLUMNS)


def ranked_matches(found: DataFrame, salt_buckets: int = 64) -> DataFrame:
    """The best ``k`` matches of every spec with their ``rank``; ``k`` 0 keeps all, without a rank.

    Top-k runs in two windows: first per (spec, salt) so one search that matches a third of all
    symbols is spread over ``salt_buckets`` tasks, then per spec over at most salt_buckets * k rows.
    """
    keys = rank_keys(F.col("term"))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("ord"), F.lit(salt_buckets)))
    w1, w2 = Window.partitionBy("spec", "_salt").orderBy(*keys), Window.partitionBy("spec").orderBy(*keys)
    first = salted.where(F.col("k") > 0).withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= F.col("k")).drop("_r", "_salt")
    ranked = first.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= F.col("k"))
    return ranked.unionByName(found.where(F.col("k") == 0).withColumn("rank", F.lit(None).cast("int")))


def rank_within_request(
    requests: DataFrame,
    symbols: DataFrame,
    default_limit: int = SEARCH_LIMIT,
    salt_buckets: int = 64,
    grams: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Top-k symbols per request: (request_id, term, limit, RANK_COLUMNS, rank).

    ``requests``: request_id, term, type, file, exact_match, include_private, limit.
    How the sides of the joins are brought together is left to the planner and its measured sizes.
    """
    asked = with_spec(requests, default_limit)
    ranked = ranked_matches(matches(asked, symbols, grams, counts), salt_buckets)
    return asked.select("request_id", "limit", "spec").join(ranked, "spec").drop("spec", "k")
