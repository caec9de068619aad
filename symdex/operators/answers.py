"""The records that answer requests, for many requests at once.

Every builder reduces its requests to their distinct searches, answers each search
once, and hands the answer back to every request that asked for it.  Lists are bounded: by the
limit of the request, or, where a request sets none, by being handed out in
``part``s of at most ``2 * PART`` records in order.  The lists of searches meet their requests
last (:func:`handed_out`), so no shuffle carries a list for every request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symdex.functions import regex as RX
from symdex.functions.columns import let, type_priority
from symdex.operators import token_index as TI
from symdex.operators.related import MEMBER_OWNER_TYPES, best_symbol_per_name
from symdex.operators.search import matches, ranked_matches, with_spec
from symdex.schemas import APART, USAGE_LIMIT
from symdex.session import ensure_checkpoint_dir

#: A part of a list without a limit ends where so many records are reached; a power of two.
PART = 1 << 16
USAGE_SALTS = 64
#: A group of requests that share a list, and a task that hands lists out, hold about so many records.
RECORDS_APART = 1 << 18


def metadata_record(metadata: Column) -> Column:
    """The metadata as it is answered; null where a symbol has none."""
    fields = {"isComponent": "is_component", "visibility": "visibility", "method": "route_method", "path": "route_path", "handler": "handler"}
    none = None
    for f in fields.values():
        none = metadata[f].isNull() if none is None else none & metadata[f].isNull()
    return F.when(~none, F.struct(*[metadata[f].alias(name) for name, f in fields.items()]))


def symbol_record() -> Column:
    return F.struct("symbol", "type", "file", "description", "signature", "exported", F.col("parent_symbol").alias("parentSymbol"),
                    metadata_record(F.col("metadata")).alias("metadata"))


COMPLETION = ("symbol", "type", "signature", "description", "filePath")


def as_completion(record: Column) -> Column:
    return F.struct(record["symbol"].alias("symbol"), record["type"].alias("type"), record["signature"].alias("signature"),
                    record["description"].alias("description"), record["file"].alias("filePath"))


def in_parts(rows: DataFrame, key: str, coarse: list[str], record: str = "record") -> DataFrame:
    """(key, part, records): rows (key, coarse..., ord, record) as ordered lists of bounded size.

    The order is (coarse..., ord).  Rows are first listed by ``ord div PART``, which holds at most PART
    of them as ord is unique; whole lists are then put together until PART records are reached.
    """
    lists = rows.withColumn("_block", F.shiftright("ord", PART.bit_length() - 1)).groupBy(key, *coarse, "_block").agg(
        F.sort_array(F.collect_list(F.struct("ord", record))).alias("_list"))
    order = Window.partitionBy(key).orderBy(*coarse, "_block")
    before = F.coalesce(F.sum(F.size("_list")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = lists.withColumn("_part", F.floor(before / PART)).groupBy(key, "_part").agg(
        F.sort_array(F.collect_list(F.struct(*coarse, "_block", "_list"))).alias("_lists"))
    numbered = parts.withColumn("part", (F.row_number().over(Window.partitionBy(key).orderBy("_part")) - 1).cast("int"))
    return numbered.select(key, "part", F.flatten(F.transform("_lists", lambda x: F.transform(x["_list"], lambda r: r[record]))).alias("records"))


def search_lists(asked: DataFrame, symbols: DataFrame, grams: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(spec, part, records): the symbols that answer each search of ``asked`` (with_spec), in rank order; a search without a hit has no row."""
    ranked = ranked_matches(matches(asked, symbols, grams, counts))
    fields = symbols.select("ord", "description", "signature", "parent_symbol", "metadata")
    keys = {"not_exact": F.coalesce(F.col("symbol") != F.col("term"), F.lit(True)), "not_exported": ~F.coalesce(F.col("exported"), F.lit(False)),
            "priority": type_priority(F.col("type"))}
    rows = ranked.join(fields.hint(APART), "ord").select("spec", "rank", "ord", *[c.alias(n) for n, c in keys.items()], symbol_record().alias("record"))
    limited = rows.where(F.col("rank").isNotNull()).groupBy("spec").agg(F.sort_array(F.collect_list(F.struct("rank", "record"))).alias("r"))
    limited = limited.select("spec", F.lit(0).alias("part"), F.transform("r", lambda x: x["record"]).alias("records"))
    return limited.unionByName(in_parts(rows.where(F.col("rank").isNull()), "spec", list(keys)))


def handed_out(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """Every row of ``asked`` (request_id, spec, ...) beside the parts of its list in ``lists`` (spec, part, records), null where it has none.

    A list may be long and asked for by many: the rows that ask for it are dealt by salt, and only they and a copy
    of the list for each salt are shuffled.  What comes out is as large as requests times records and should not be shuffled again.
    Salts and tasks are counted from the records that are handed out, so a task holds few long rows, however many requests there are;
    ``lists`` is read twice and should be a table.
    """
    ensure_checkpoint_dir(asked.sparkSession)
    asked = asked.checkpoint()  # ids and searches, read for the loads, the copies and the answers
    sizes = lists.groupBy("spec").agg(F.sum(F.size("records")).alias("_n"))
    loads = asked.groupBy("spec").agg(F.count(F.lit(1)).alias("_asked")).join(sizes.hint(APART), "spec", "left").select(
        "spec", (F.col("_asked") * (F.coalesce("_n", F.lit(0)) + 1) / RECORDS_APART).alias("_load")).checkpoint()
    tasks = int(loads.agg(F.ceil(F.sum("_load"))).first()[0] or 1)
    salts = loads.where(F.col("_load") > 1).select("spec", F.ceil("_load").cast("int").alias("_salts"))
    spread = F.when(F.col("spec").isNull(), F.lit(tasks)).otherwise(F.coalesce("_salts", F.lit(1)))  # without a hit, anywhere
    dealt = asked.join(F.broadcast(salts), "spec", "left").withColumn("_salt", F.pmod(F.xxhash64("request_id"), spread)).drop("_salts")
    copies = dealt.select("spec", "_salt").distinct().join(lists.hint(APART), "spec")
    by = [tasks, "spec", "_salt"]
    return dealt.repartition(*by).join(copies.repartition(*by).hint(APART), ["spec", "_salt"], "left").drop("_salt")


def looked_up(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(spec, found: the best symbol's row) of every exact lookup in ``requests`` (with_spec, k 1), private symbols included."""
    ranked = ranked_matches(matches(requests, symbols, grams=no_grams(symbols), counts=no_counts(symbols))).select("spec", "ord")
    rest = symbols.select("ord", F.struct("ord", "symbol", "type", "file", "description", "signature", "exported", "parent_symbol", "metadata").alias("found"))
    return ranked.join(rest.hint(APART), "ord").drop("ord")


def no_grams(symbols: DataFrame) -> DataFrame:
    """An empty gram index, for requests that are all exact."""
    return symbols.sparkSession.createDataFrame(
        [], "gram string, salt int, ord long, symbol string, type string, file string, exported boolean, visibility string")


def no_counts(symbols: DataFrame) -> DataFrame:
    return symbols.sparkSession.createDataFrame([], "gram string, n long")


def as_lookup(requests: DataFrame, *keep: str) -> DataFrame:
    """Requests (request_id, symbol, type, file, ...) as exact searches for one symbol; those without a name are left out."""
    return with_spec(requests.select(
        "request_id", F.col("symbol").alias("term"), "type", "file", F.lit(True).alias("exact_match"), F.lit(True).alias("include_private"),
        F.lit(1).alias("limit"), *keep))


# --- symbol documentation (B10, F6) ---------------------------------------------

RELATED = "struct<symbol:string,type:string,relationship:string,description:string>"


def _related(relationship: str, symbol: str, kind: str, description: str) -> Column:
    return F.struct(F.col(symbol).alias("symbol"), F.col(kind).alias("type"), F.lit(relationship).alias("relationship"),
                    F.col(description).alias("description"))


def members(symbols: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, part, records): the members of every owner name, exported first, by kind and insertion order."""
    kids = symbols.where(F.col("parent_symbol").isNotNull()).join(owners.select(F.col("owner").alias("parent_symbol")).hint(APART), "parent_symbol", "left_semi")
    rows = kids.select(
        F.col("parent_symbol").alias("owner"), (~F.coalesce(F.col("exported"), F.lit(False))).alias("not_exported"), type_priority(F.col("type")).alias("priority"),
        "ord", _related("child", "symbol", "type", "description").alias("record"))
    return in_parts(rows, "owner", ["not_exported", "priority"])


def symbol_docs(requests: DataFrame, symbols: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(request_id, part, doc): the documentation of the symbol each request names; no row where there is none.

    ``requests``: request_id, symbol, type, file, include_related.  The related list holds the parent, then the members;
    it is null when it would be empty or is not asked for.  ``found`` is what :func:`looked_up` gives for them, and maybe for others.
    """
    ensure_checkpoint_dir(symbols.sparkSession)
    asked = as_lookup(requests, "include_related")
    if found is None:
        found = looked_up(asked, symbols).checkpoint()
    found = found.join(asked.select("spec").distinct().hint(APART), "spec", "left_semi")
    wanted = found.where(F.col("found.parent_symbol").isNotNull()).select(F.col("found.parent_symbol").alias("symbol")).distinct()
    parents = best_symbol_per_name(symbols.join(wanted.hint(APART), "symbol", "left_semi")).select(
        F.col("parent_name"), _related("parent", "parent_name", "parent_type", "parent_description").alias("parent"))
    is_owner = F.col("found.type").isin(*MEMBER_OWNER_TYPES)
    lists = members(symbols, found.where(is_owner).select(F.col("found.symbol").alias("owner")).distinct())
    full = (found.join(parents.hint(APART), F.col("found.parent_symbol") == F.col("parent_name"), "left")
            .join(lists.hint(APART), is_owner & (F.col("found.symbol") == F.col("owner")), "left"))
    none = F.array().cast(f"array<{RELATED}>")
    first = F.coalesce(F.col("part"), F.lit(0)) == 0
    related = F.concat(F.when(first & F.col("parent").isNotNull(), F.array("parent")).otherwise(none), F.coalesce(F.col("records"), none)).cast(f"array<{RELATED}>")
    # one row a search and part, in a job of its own: the plan that hands them out stays small
    full = full.select("spec", F.coalesce("part", F.lit(0)).alias("part"), "found", F.when(F.size(related) > 0, related).alias("related")).checkpoint()
    given = asked.select("request_id", "spec", F.coalesce(F.col("include_related"), F.lit(True)).alias("include_related")).join(full.hint(APART), "spec")
    given = given.where(F.col("include_related") | (F.col("part") == 0))
    f = F.col("found")
    return given.select("request_id", "part", F.struct(
        f["symbol"].alias("name"), f["type"].alias("type"), f["file"].alias("file"), f["description"].alias("description"), f["signature"].alias("signature"),
        f["exported"].alias("exported"), f["metadata"]["visibility"].alias("visibility"), metadata_record(f["metadata"]).alias("metadata"),
        F.when(F.col("include_related"), F.col("related")).alias("relatedSymbols")).alias("doc"))


# --- usages (F7) -----------------------------------------------------------------

USAGE = "struct<file:string,line:int,column:int,snippet:string,isDefinition:boolean>"


def _usage(is_definition: bool, path: Column, hit: Column) -> Column:
    return F.struct(path.alias("file"), hit["line"].alias("line"), hit["column"].alias("column"), hit["snippet"].alias("snippet"),
                    F.lit(is_definition).alias("isDefinition"))


def definitions(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, path, definitions): for ``wanted`` (name, path) the definition rows of the name in that file.

    A line matches when one of the four patterns does; the first pattern that matches gives the column.  Rows are the match on
    line 1, if any, and the first one after it.  A file is split into lines once for all its names.
    """
    per_file = wanted.groupBy("path").agg(F.collect_set("name").alias("names"))
    rows = files.select("path", "content").dropDuplicates(["path"]).join(per_file, "path")

    def patterns(name: Column) -> list[Column]:
        left = F.when(name.rlike(f"^[{RX.WORD}]"), F.lit(f"(?<![{RX.WORD}])")).otherwise(F.lit(f"(?<=[{RX.WORD}])"))
        right = F.when(name.rlike(rf"[{RX.WORD}]\z"), F.lit(f"(?![{RX.WORD}])")).otherwise(F.lit(f"(?=[{RX.WORD}])"))
        own = TI.escaped(name)
        return [*(F.concat(left, own, F.lit(f"{RX.JS_SPACE}*{end}")) for end in (r"\(", r"\{", ":")),
                F.concat(F.lit(f"(?<![{RX.WORD}])function{RX.JS_SPACE}+"), own, right)]

    def column_of(text: Column, pats: list[Column]) -> Column:
        out = None
        for p in pats:
            at = F.length(F.try_element_at(F.split(text, p, 2), F.lit(1))) + 1
            out = F.when(F.regexp_like(text, p), at) if out is None else out.when(F.regexp_like(text, p), at)
        return out

    def of_name(lines: Column, name: Column) -> Column:
        pats = patterns(name)
        tried = F.transform(F.filter(F.transform(lines, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"))), lambda x: x["text"].contains(name)),
                            lambda x: F.struct(x["line"].alias("line"), column_of(x["text"], pats).alias("column")))
        hits = F.filter(tried, lambda x: x["column"].isNotNull())
        later = F.array_min(F.transform(F.filter(hits, lambda x: x["line"] > 1), lambda x: x["line"]))
        return let(later, lambda at: F.transform(F.filter(hits, lambda x: (x["line"] == 1) | (x["line"] == at)), lambda x: F.struct(
            x["line"].cast("int").alias("line"), x["column"].cast("int").alias("column"), TI.snippet_of(lines, x["line"]).alias("snippet"))))

    per_name = let(F.split(F.col("content"), "\n", -1), lambda lines: F.transform("names", lambda n: F.struct(n.alias("name"), of_name(lines, n).alias("hits"))))
    return rows.select("path", F.explode(per_name).alias("d")).select("d.name", "path", F.transform("d.hits", lambda h: _usage(True, F.col("path"), h)).alias("definitions"))


def usages(requests: DataFrame, symbols: DataFrame, files: DataFrame, index: DataFrame | None = None, counts: DataFrame | None = None,
           found: DataFrame | None = None) -> DataFrame:
    """(request_id, symbol, type, usages, totalFound, limitReached) of every request whose symbol is known (Q5-Q8).

    ``requests``: request_id, symbol, type, file, include_definition, max_results; ``files``: path, content, pattern_idx (all that definitions are
    looked for in; those with a pattern_idx above 0 are searched).  Keys first: lines are counted and ranked by the index, and only the files of the
    lines that are answered are read.  ``found`` is what :func:`looked_up` gives for the requests, and maybe for others.
    """
    ensure_checkpoint_dir(symbols.sparkSession)
    most = F.when(F.coalesce(F.col("max_results"), F.lit(0)) == 0, F.lit(USAGE_LIMIT)).otherwise(F.col("max_results"))
    asked = as_lookup(requests, "include_definition", "max_results").withColumns({
        "with_def": F.coalesce(F.col("include_definition"), F.lit(True)), "most": most})
    if found is None:
        found = looked_up(asked, symbols).checkpoint()
    # requests that differ in their id only have one answer
    own = ["spec", "with_def", "most"]
    jobs = asked.select(*own).distinct().join(found.hint(APART), "spec").select(
        *own, F.col("found.symbol").alias("name"), F.col("found.type").alias("type"), F.col("found.file").alias("def_file"))
    # what is searched: a name, without the definition's file where the definition is asked for
    jobs = jobs.withColumn("skip", F.when(F.col("with_def"), F.col("def_file"))).withColumn("target", F.to_json(F.struct("name", "skip")))
    targets = jobs.groupBy("target", "name", "skip").agg(F.greatest(F.max("most"), F.lit(1)).alias("cap"))

    listed = files.where(F.col("pattern_idx") > 0)
    lines = TI.name_lines(listed, targets.select("name"), index, counts)
    # Q7: the whole definition file is left out
    hits = lines.join(targets.hint(APART), "name").where(F.col("skip").isNull() | (F.col("path") != F.col("skip"))).checkpoint()  # counted and ranked
    totals = hits.groupBy("target").agg(F.sum("n").alias("others"))
    order = ["pattern_idx", "path", "line"]
    w1 = Window.partitionBy("target", "_salt").orderBy(*order)
    w2 = Window.partitionBy("target").orderBy(*order)
    top = hits.withColumn("_salt", F.pmod(F.xxhash64("path", "line"), F.lit(USAGE_SALTS))).withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= F.col("cap"))
    top = top.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= F.col("cap"))
    at = TI.occurrences(listed, top.select("name", *order).distinct())
    rows = top.select("target", "name", "cap", *order).join(at.hint(APART), ["name", *order])
    w3 = Window.partitionBy("target").orderBy(*order, "column")
    rows = rows.withColumn("_r", F.row_number().over(w3)).where(F.col("_r") <= F.col("cap"))
    hit = F.struct(F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column"), "snippet")
    others = rows.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("_r", _usage(False, F.col("path"), hit).alias("u")))).alias("l")).select(
        "target", F.transform("l", lambda x: x["u"]).alias("listed"))

    defs = definitions(files, jobs.where("with_def").select("name", F.col("def_file").alias("path")).distinct()).withColumnRenamed("path", "_def")
    none = F.array().cast(f"array<{USAGE}>")
    full = (jobs.join(totals.hint(APART), "target", "left").join(others.hint(APART), "target", "left")
            .join(defs.withColumnRenamed("name", "_name").hint(APART), (F.col("name") == F.col("_name")) & (F.col("skip") == F.col("_def")), "left"))
    full = full.withColumn("own", F.coalesce("definitions", none).cast(f"array<{USAGE}>")).withColumn("d", F.size("own")).withColumn("all", F.col("d") + F.coalesce("others", F.lit(0)))
    cap = F.greatest("d", "most")
    answers = full.select(
        *own, F.col("name").alias("symbol"), "type",
        F.concat("own", F.slice(F.coalesce("listed", none).cast(f"array<{USAGE}>"), F.lit(1), F.greatest(F.col("most") - F.col("d"), F.lit(0)))).alias("usages"),
        F.least("all", cap + 1).cast("int").alias("totalFound"), (F.col("all") > cap).alias("limitReached")).checkpoint()
    return asked.select("request_id", *own).join(answers.hint(APART), own).drop(*own)


# --- file documentation (F1 of X21, B2) --------------------------------------------

def file_doc_record(path: Column, doc: Column) -> Column:
    """The nested documentation of a file as it is answered (D3)."""
    def method(m):
        return F.struct(m["name"].alias("name"), m["params"].alias("params"), m["return_type"].alias("returnType"), m["description"].alias("description"),
                        m["visibility"].alias("visibility"))

    def prop(p):
        return F.struct(p["name"].alias("name"), p["type"].alias("type"), p["description"].alias("description"), p["visibility"].alias("visibility"))

    functions = F.transform(doc["functions"], lambda f: F.struct(
        f["name"].alias("name"), f["params"].alias("params"), f["return_type"].alias("returnType"), f["description"].alias("description"), f["exported"].alias("exported")))
    classes = F.transform(doc["classes"], lambda c: F.struct(
        c["name"].alias("name"), c["description"].alias("description"), c["exported"].alias("exported"), F.transform(c["methods"], method).alias("methods"),
        F.transform(c["properties"], prop).alias("properties"), c["is_component"].alias("isComponent")))
    interfaces = F.transform(doc["interfaces"], lambda c: F.struct(
        c["name"].alias("name"), c["description"].alias("description"), c["exported"].alias("exported"), F.transform(c["properties"], prop).alias("properties"),
        F.transform(c["methods"], method).alias("methods")))
    return F.struct(path.alias("filePath"), functions.alias("functions"), classes.alias("classes"), interfaces.alias("interfaces"),
                    doc["type_aliases"].alias("typeAliases"), doc["routes"].alias("routes"))
