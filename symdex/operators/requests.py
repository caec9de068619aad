"""Request lines in, answers out.

Many requests are answered at once, from a registry that the caller has brought up to date once, as the
tools do before they answer: the requests are split by tool, each tool is one plan over the tables (symbols,
files, listing), and the answers are unioned by ``request_id``.  A tool that no
request asks for has an empty side in all its joins.  Errors are rows, never exceptions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.functions.columns import extension, js_trim, parse_symbol_type_col
from symdex.operators import answers as A
from symdex.operators import file_docs as FD
from symdex.operators import registry as G
from symdex.operators.search import with_spec
from symdex.operators.usages import with_listing_order
from symdex.schemas import APART, AUTOCOMPLETE_LIMIT, DEFAULT_PATTERNS, SEARCH_LIMIT
from symdex.session import ensure_checkpoint_dir

TOOLS = ("get_doc_for_file", "search_project_symbols", "autocomplete_symbol", "get_doc_for_symbol",
         "find_usages", "refresh_registry")


def _json_type(v, path: str):
    """Variant type name of a JSON field ('STRING', 'OBJECT<...>', ...) or null."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def parse_requests(requests: DataFrame) -> DataFrame:
    """(request_id, line) -> (request_id, tool, input JSON text, error, details); blank lines dropped."""
    v = F.try_parse_json(F.col("line"))
    df = requests.where(js_trim(F.col("line")) != "").withColumn("_v", v)
    tool_t = F.when(F.col("_v").isNotNull(), _json_type(F.col("_v"), "$.tool"))
    input_t = F.when(F.col("_v").isNotNull(), _json_type(F.col("_v"), "$.input"))
    tool = F.variant_get(F.col("_v"), "$.tool", "string")
    tool_ok = (F.coalesce(tool_t, F.lit("")) == "STRING") & (F.coalesce(tool, F.lit("")) != "")
    input_ok = F.coalesce(input_t, F.lit("")).rlike("^(OBJECT|ARRAY)")
    err = (F.when(F.col("_v").isNull(), F.lit("Invalid JSON"))
           .when(~tool_ok, F.lit("Invalid request"))
           .when(~input_ok, F.lit("Invalid request")))
    details = (F.when(F.col("_v").isNull(), F.lit("Unexpected token in JSON"))
               .when(~tool_ok, F.lit('Missing or invalid "tool" field'))
               .when(~input_ok, F.lit('Missing or invalid "input" field')))
    return df.select(
        "request_id",
        F.when(tool_ok, tool).alias("tool"),
        F.when(tool_ok & input_ok, F.to_json(F.variant_get(F.col("_v"), "$.input", "variant"))).alias("input"),
        err.alias("error"), details.alias("details"),
    )


def request_fields(parsed: DataFrame) -> DataFrame:
    """Typed input fields of every tool (missing -> null; values of another type treated as missing)."""
    inp = F.try_parse_json(F.col("input"))

    def s(name):
        return F.when(_json_type(inp, f"$.{name}") == "STRING", F.variant_get(inp, f"$.{name}", "string"))

    def b(name):
        return F.when(_json_type(inp, f"$.{name}") == "BOOLEAN", F.variant_get(inp, f"$.{name}", "boolean"))

    def n(name):
        return F.when(_json_type(inp, f"$.{name}").rlike("^(INT|BIGINT|DECIMAL|DOUBLE|FLOAT|SMALLINT|TINYINT)"),
                      F.variant_get(inp, f"$.{name}", "double").cast("int"))

    def strings(name):
        return F.when(_json_type(inp, f"$.{name}") == "ARRAY<STRING>", F.variant_get(inp, f"$.{name}", "array<string>"))

    return parsed.select(
        "request_id", "tool", "error", "details",
        s("query").alias("query"), s("prefix").alias("prefix"), s("symbol").alias("symbol"), s("file").alias("file"),
        s("type").alias("type"), b("exactMatch").alias("exact_match"), b("includePrivate").alias("include_private"),
        b("includeDefinition").alias("include_definition"), b("includeRelated").alias("include_related"), b("fullScan").alias("full_scan"),
        n("limit").alias("limit"), n("maxResults").alias("max_results"), s("baseDir").alias("base_dir"), strings("patterns").alias("patterns"),
    )


#: What each tool answers, as the JSON fields of its response.
METADATA_T = "struct<isComponent:boolean,visibility:string,method:string,path:string,handler:string>"
RECORD_T = ("struct<symbol:string,type:string,file:string,description:string,signature:string,exported:boolean,parentSymbol:string,"
            f"metadata:{METADATA_T}>")
COMPLETION_T = "struct<symbol:string,type:string,signature:string,description:string,filePath:string>"
SYMBOL_DOC_T = ("struct<name:string,type:string,file:string,description:string,signature:string,exported:boolean,visibility:string,"
                f"metadata:{METADATA_T},relatedSymbols:array<{A.RELATED}>>")
USAGES_T = f"struct<symbol:string,type:string,usages:array<{A.USAGE}>,totalFound:int,limitReached:boolean>"
METHOD_T = "struct<name:string,params:array<string>,returnType:string,description:string,visibility:string>"
PROPERTY_T = "struct<name:string,type:string,description:string,visibility:string>"
FILE_DOC_T = ("struct<filePath:string,functions:array<struct<name:string,params:array<string>,returnType:string,description:string,exported:boolean>>,"
              f"classes:array<struct<name:string,description:string,exported:boolean,methods:array<{METHOD_T}>,properties:array<{PROPERTY_T}>,isComponent:boolean>>,"
              f"interfaces:array<struct<name:string,description:string,exported:boolean,properties:array<{PROPERTY_T}>,methods:array<{METHOD_T}>>>,"
              "typeAliases:array<struct<name:string,type:string,description:string,exported:boolean>>,"
              "routes:array<struct<method:string,path:string,handler:string,description:string>>>")
REFRESH_T = "struct<refreshed:boolean,filesProcessed:int,filesRemoved:int,symbols:int>"
PAYLOADS = {
    "results": f"array<{RECORD_T}>", "completions": f"array<{COMPLETION_T}>", "symbol_doc": SYMBOL_DOC_T, "usages": USAGES_T,
    "file_doc": FILE_DOC_T, "refresh": REFRESH_T,
}


def _answers(df: DataFrame, error=None, details=None, part=None, **payload) -> DataFrame:
    """Answer rows: request_id, part, tool, error, details and the payload columns, null but for the tool's own."""
    none = F.lit(None)
    return df.select(
        "request_id", (F.lit(0) if part is None else part).cast("int").alias("part"), "tool",
        (none if error is None else error).cast("string").alias("error"), (none if details is None else details).cast("string").alias("details"),
        *[payload.get(name, none).cast(t).alias(name) for name, t in PAYLOADS.items()])


def dispatch_requests(requests: DataFrame, symbols: DataFrame, files: DataFrame | None = None,
                      listing: DataFrame | None = None, summary: DataFrame | None = None,
                      base_dir: str = "/", grams=None, gram_counts=None, tokens=None, token_counts=None) -> DataFrame:
    """Answer every request row; one plan per tool, results unioned by request.

    Output: request_id, part, tool, error, details and one payload column a tool (``PAYLOADS``): results, completions,
    symbol_doc, usages, file_doc, refresh.  A list without a limit comes in parts, numbered from 0.

    ``files``: path, content of the files on disk; ``listing``: their path and mtime.  The tools bring the registry up to date before they
    answer: the caller does so once for the batch (``sources.store.refresh_store``) and hands its ``summary`` over, which is what
    a plain refresh request is told; a request for a full scan is told what that scan would give.  ``grams``, ``tokens`` and
    their counts are stored indexes; without them they are derived from the tables.
    """
    spark = symbols.sparkSession
    if files is None:
        files = spark.createDataFrame([], "path string, content string")
    # parsed once: every tool reads the fields many times, and each would parse the line again
    ensure_checkpoint_dir(spark)
    fields = request_fields(parse_requests(requests)).checkpoint()
    ok = fields.where(F.col("error").isNull())
    tool = F.col("tool")
    unknown = _answers(ok.where(~tool.isin(*TOOLS)), F.lit("Unknown tool"), F.concat(F.lit('Tool "'), tool, F.lit('" not supported')))
    out = [_answers(fields.where(F.col("error").isNotNull()), F.col("error"), F.col("details")), unknown]

    listed = with_listing_order(files, keep_others=True)
    searches, completions = ok.where(tool == "search_project_symbols"), ok.where(tool == "autocomplete_symbol")
    lists = _lists(_search_terms(searches).unionByName(_completion_terms(completions)), symbols, grams, gram_counts)
    out.append(_search_answers(searches, lists))
    out.append(_completion_answers(completions, lists))
    named = A.looked_up(A.as_lookup(ok.where(tool.isin("get_doc_for_symbol", "find_usages"))), symbols).checkpoint()
    out.append(_symbol_answers(ok.where(tool == "get_doc_for_symbol"), symbols, named))
    out.append(_usage_answers(ok.where(tool == "find_usages"), symbols, listed, tokens, token_counts, named))
    out.append(_file_answers(ok.where(tool == "get_doc_for_file"), files))
    out.append(_refresh_answers(ok.where(tool == "refresh_registry"), symbols, listing, files, summary, base_dir))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def _term(df: DataFrame, field: str, limit) -> DataFrame:
    private, exact = F.coalesce("include_private", F.lit(False)), F.coalesce("exact_match", F.lit(False))
    auto = field == "prefix"
    return df.select("request_id", F.col(field).alias("term"), "type", (F.lit(None).cast("string") if auto else F.col("file")).alias("file"),
                     (F.lit(False) if auto else exact).alias("exact_match"), private.alias("include_private"), limit.alias("limit"))


def _search_terms(asked: DataFrame) -> DataFrame:
    return _term(asked, "query", F.coalesce("limit", F.lit(SEARCH_LIMIT)))


def _completion_terms(asked: DataFrame) -> DataFrame:
    return _term(asked, "prefix", F.when(F.coalesce("limit", F.lit(0)) == 0, F.lit(AUTOCOMPLETE_LIMIT)).otherwise(F.col("limit")))


def _lists(terms: DataFrame, symbols: DataFrame, grams, counts) -> DataFrame:
    """(spec, part, records) of the searches of ``terms``: made once, for the searches that have a list and for the requests they answer."""
    lists = A.search_lists(with_spec(terms), symbols, grams, counts)
    return lists.select("spec", "part", F.col("records").cast(PAYLOADS["results"]).alias("records")).checkpoint()


def _listed(asked: DataFrame, terms: DataFrame, lists: DataFrame) -> DataFrame:
    """``asked`` with the ``part``s of the ``records`` that answer its ``terms`` (:func:`_term`); null without a hit."""
    hits = with_spec(terms).select("request_id", "spec").join(lists.select("spec").distinct().hint(APART), "spec")
    return A.handed_out(asked.select("request_id", "tool").join(hits.hint(APART), "request_id", "left"), lists)


def _search_answers(asked: DataFrame, lists: DataFrame) -> DataFrame:
    none = F.array().cast(PAYLOADS["results"])  # an empty query has no results (B11)
    found = _listed(asked, _search_terms(asked), lists)
    return _answers(found, part=F.coalesce("part", F.lit(0)), results=F.coalesce("records", none))


def _completion_answers(asked: DataFrame, lists: DataFrame) -> DataFrame:
    none = F.array().cast(PAYLOADS["completions"])
    own = lists.withColumn("records", F.transform("records", A.as_completion).cast(PAYLOADS["completions"]))
    found = _listed(asked, _completion_terms(asked), own)
    return _answers(found, part=F.coalesce("part", F.lit(0)), completions=F.coalesce("records", none))


def _symbol_answers(asked: DataFrame, symbols: DataFrame, named: DataFrame) -> DataFrame:
    found = A.symbol_docs(asked.select("request_id", "symbol", "type", "file", "include_related"), symbols, named)
    error = (F.when(F.coalesce(F.col("symbol"), F.lit("")) == "", F.lit("Missing or invalid symbol name"))
             .when(F.col("doc").isNull(), F.concat(F.lit("Symbol '"), F.col("symbol"), F.lit("' not found"))))
    return _answers(asked.join(found.hint(APART), "request_id", "left"), error, part=F.coalesce("part", F.lit(0)), symbol_doc=F.col("doc"))


def _usage_answers(asked: DataFrame, symbols: DataFrame, listed: DataFrame, tokens, counts, named: DataFrame) -> DataFrame:
    found = A.usages(asked.select("request_id", "symbol", "type", "file", "include_definition", "max_results"), symbols, listed, tokens, counts, named)
    found = found.select("request_id", F.struct("symbol", "type", "usages", "totalFound", "limitReached").cast(USAGES_T).alias("u"))
    no_name = F.coalesce(F.col("symbol"), F.lit("")) == ""
    unknown = F.when(F.coalesce(F.col("type"), F.lit("")) == "", F.lit("unknown")).otherwise(F.col("type"))
    none = F.struct(F.coalesce(F.col("symbol"), F.lit("")).alias("symbol"), F.when(no_name, F.lit("")).otherwise(unknown).alias("type"),
                    F.array().cast(f"array<{A.USAGE}>").alias("usages"), F.lit(0).alias("totalFound"), F.lit(False).alias("limitReached")).cast(USAGES_T)
    return _answers(asked.join(found.hint(APART), "request_id", "left"), usages=F.coalesce("u", none))


def _file_answers(asked: DataFrame, files: DataFrame) -> DataFrame:
    """get_doc_for_file: invalid input, not found, unsupported, unreadable or the file's documentation (B2)."""
    wanted = asked.select(F.col("file").alias("path"))
    # parsing is by far the largest expression there is: a job of its own keeps it out of the plan of all tools
    docs = FD.requested_file_docs(wanted, files).checkpoint()
    own = asked.join(docs.withColumnRenamed("error", "_error").withColumnRenamed("details", "_details").hint(APART), F.col("file").eqNullSafe(F.col("path")), "left")
    return _answers(own, F.col("_error"), F.col("_details"),
                    file_doc=F.when(F.col("doc").isNotNull(), A.file_doc_record(F.col("path"), F.col("doc"))))


def _refresh_answers(asked: DataFrame, symbols: DataFrame, listing: DataFrame | None, files: DataFrame, summary: DataFrame | None, base_dir: str) -> DataFrame:
    """refresh_registry: the summary of the batch's own refresh, or of the full scan that the request describes."""
    full = F.coalesce(F.col("full_scan"), F.lit(False))
    if summary is None:
        summary = G.symbol_count(symbols).select(F.lit(True).alias("refreshed"), F.lit(0).alias("files_processed"), F.lit(0).alias("files_removed"), "symbols")
    one = F.struct(F.col("refreshed"), F.col("files_processed").alias("filesProcessed"), F.col("files_removed").alias("filesRemoved"),
                   F.col("symbols").cast("int").alias("symbols")).cast(REFRESH_T)
    told = F.broadcast(summary.select(one.alias("r"), F.lit(1).alias("_one")).checkpoint())  # one row
    keyed = asked.withColumn("_one", F.lit(1))
    if listing is None:
        return _answers(keyed.join(told, "_one"), refresh=F.col("r"))
    plain = _answers(keyed.where(~full).join(told, "_one"), refresh=F.col("r"))
    patterns = F.array(*[F.lit(p) for p in DEFAULT_PATTERNS])
    scans = asked.where(full).select(
        "request_id", "tool", F.when(F.col("base_dir") != "", F.col("base_dir")).otherwise(F.lit(base_dir)).alias("base_dir"),
        F.coalesce("patterns", patterns).alias("patterns")).withColumn("scan", F.to_json(F.struct("base_dir", "patterns")))
    asked_scans = scans.select("scan", "base_dir", "patterns").distinct().checkpoint()
    if asked_scans.isEmpty():  # parsing is the largest plan there is
        return plain
    told = G.scan_summaries(asked_scans, symbols, listing, files).checkpoint()
    return plain.unionByName(_answers(scans.join(told, "scan"), refresh=F.struct(
        F.lit(True).alias("refreshed"), "files_processed", F.lit(0).alias("files_removed"), "symbols").cast(REFRESH_T)))


def summarised(answers: DataFrame) -> DataFrame:
    """One row a request: request_id, tool, error, details, result_count, first_symbol."""
    first = (F.when(F.col("results").isNotNull(), F.try_element_at("results", F.lit(1))["symbol"])
             .when(F.col("completions").isNotNull(), F.try_element_at("completions", F.lit(1))["symbol"])
             .when(F.col("symbol_doc").isNotNull(), F.col("symbol_doc.name")))
    rows = answers.select("request_id", "part", "tool", "error", "details", _count().alias("n"), first.alias("first"))
    total = rows.groupBy("request_id").agg(F.max("tool").alias("tool"), F.max("error").alias("error"), F.max("details").alias("details"), F.sum(
        F.when((F.col("part") == 0) | F.col("tool").isin("search_project_symbols", "autocomplete_symbol"), F.col("n"))).cast("int").alias("result_count"),
        F.min_by("first", "part").alias("first_symbol"))
    return total


def _count():
    """How many results an answer row holds."""
    count = (F.when(F.col("results").isNotNull(), F.size("results")).when(F.col("completions").isNotNull(), F.size("completions"))
             .when(F.col("symbol_doc").isNotNull(), F.lit(1)).when(F.col("usages").isNotNull(), F.col("usages.totalFound"))
             .when(F.col("refresh").isNotNull(), F.col("refresh.filesProcessed"))
             .when(F.col("file_doc").isNotNull(), _sizes("functions", "classes", "interfaces", "typeAliases", "routes")))
    return F.coalesce(count, F.lit(0))


def _sizes(*fields: str):
    total = F.lit(0)
    for f in fields:
        total = total + F.coalesce(F.size(F.col(f"file_doc.{f}")), F.lit(0))
    return total


def emit_responses(answers: DataFrame, counts: bool = False) -> DataFrame:
    """(request_id, part, json), one JSON line an answer row; undefined (null) fields are omitted.

    ``counts`` adds the number of results to the line of an error.
    """
    options = {"ignoreNullFields": "true"}

    def own(*fields):
        return F.to_json(F.struct(*fields), options)

    tool, error = F.col("tool"), F.col("error")
    json = (F.when(F.col("symbol_doc").isNotNull(), own(F.lit(True).alias("found"), F.col("symbol_doc").alias("symbol")))
            .when(F.coalesce(tool, F.lit("")).eqNullSafe("get_doc_for_symbol") & F.col("details").isNull(), own(F.lit(False).alias("found"), "error"))
            .when(error.isNotNull(), own("error", "details", *([_count().alias("resultCount")] if counts else [])))
            .when(F.col("results").isNotNull(), own("results"))
            .when(F.col("completions").isNotNull(), own("completions"))
            .when(F.col("usages").isNotNull(), F.to_json("usages", options))
            .when(F.col("file_doc").isNotNull(), F.to_json("file_doc", options))
            .otherwise(F.to_json("refresh", options)))
    return answers.select("request_id", "part", json.alias("json"))


def parse_symbol_type(requests: DataFrame) -> DataFrame:
    """B3 over the type field of every parsed request."""
    return request_fields(parse_requests(requests)).select(
        "request_id", F.col("type").alias("type_text"), parse_symbol_type_col(F.col("type")).alias("kind"))

