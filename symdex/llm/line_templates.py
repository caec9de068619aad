"""Line dedup by a log-template tree of fixed depth.

A line goes to a leaf by its number of tokens and its first ``DEPTH`` tokens.  A token with a
digit is a variable field, ``<*>``, from the start; a leading token that fewer than ``MIN_DOCS``
documents have at that place, in lines of as many tokens, takes the ``<*>`` child too, so that
"Posted by Alice ..." and "Posted by Bob ..." meet in one leaf.  A path has at most
``WILD`` such children; a line with more rare leading tokens, or with more than a template may have
varying places, is in no leaf: prose would else meet in leaves without a frequent word.
Inside a leaf a token stays in the template of its line where at least ``MIN_DOCS`` documents
have it at that place, else the place becomes ``<*>``.  A template recurs when ``MIN_DOCS``
documents hold a line of it and enough of it is fixed (documents of equal texts count as one, so
that a text does not recur by its own copies):

* of a template with places that vary without a digit, at least ``MIN_TOKENS`` tokens and
  ``SHARE`` percent of those that are no digit fields;
* of one whose lines are equal but for digit fields, whatever its length, all that is no
  digit field.

Beside digit fields one fixed token has a letter: rows of figures are no template.
Lines of recurring templates are dropped, all of them, in every document: a text
of little else becomes short or empty.

Counting runs on aggregates: a line is counted once a text, equal lines are
summed before they are shuffled, leading tokens are counted over distinct lines, and only lines
of leaves with enough documents come with their text (a bit table of fixed size lets the second
scan skip the others; the join behind it is exact, so a full table costs a shuffle of more texts and
no result; another such table tells which texts may have copies, and only lines of these are joined with
the first of each).  A very common line or leaf is therefore never gathered.

Lines are the ``\\n``-split parts of the whole text; blank lines stay.  A null text
stays null and has no lines; rows of one doc_id count as one document, equal rows too;
a null doc_id is an id like any other; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.llm.bits import bit_table
from symdex.llm.common import shared_folder, ship_package, written
from symdex.llm.words import sliced

DEPTH, WILD, MIN_TOKENS, MIN_DOCS, SHARE = 4, 1, 4, 10, 80
BITS = 23
ANY = "<*>"
_DIGIT = re.compile(r"\d")


def _signed(data: bytes) -> int:
    h = xxhash.xxh64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def line_tokens(line: str) -> list[str]:
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [ANY if _DIGIT.search(t) else t for t in tokens]
    return tokens


def line_key(line: str) -> tuple[int, list[str]] | None:
    """Name of a line and its tokens; None for a blank line."""
    tokens = line_tokens(line)
    return (_signed(" ".join(tokens).encode()), tokens) if tokens else None


def leading(tokens: list[str], depth: int) -> list[int]:
    """Names of the first tokens by their place and the number of tokens; 0 for a digit field."""
    return [0 if t == ANY else _signed(f"{len(tokens)} {place} {t}".encode()) or 1 for place, t in enumerate(tokens[:depth])]


def _doc_lines(batches: Iterator[pa.RecordBatch], kept: Callable[[list[str]], object]) -> Iterator[tuple[list, list, list]]:
    """Document (and text digest), line and what is ``kept`` of its tokens for the lines of each document, equal ones once."""
    docs, lines, values = [], [], []
    for batch in sliced(batches):
        names = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
        for doc, text in zip(names, batch.column(1).to_pylist(), strict=True):
            found = {}
            for line in (text or "").split("\n"):
                key = line_key(line)
                if key and key[0] not in found:
                    found[key[0]] = kept(key[1])
            docs += [doc] * len(found)
            lines += found.keys()
            values += found.values()
            if len(docs) >= 20_000:
                yield docs, lines, values
                docs, lines, values = [], [], []
    yield docs, lines, values


def leaves_of(lines: DataFrame, min_docs: int, least: int, share: int) -> DataFrame:
    """(line, leaf) of ``lines`` (line, docs, size, words, lead) in leaves of enough documents."""
    leads = lines.select("line", "docs", "size", "words", F.explode("lead").alias("token"))
    frequent = leads.where("token != 0").groupBy("token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("token", F.lit(True).alias("frequent"))
    met = leads.join(frequent, "token", "left")
    # a token's name holds its place, so the frequent ones make the path in any order
    path = F.bit_xor(F.when(F.col("frequent"), F.col("token")).otherwise(0))
    rare = F.count_if(F.col("frequent").isNull() & (F.col("token") != 0))
    rows = met.groupBy("line").agg(*[F.min(c).alias(c) for c in ("docs", "size", "words")], path.alias("path"), rare.alias("rare"))
    stays = F.col("words") - F.col("rare")
    rows = rows.where((F.col("rare") == 0) | ((F.col("rare") <= WILD) & (stays >= least) & (100 * stays >= share * F.col("words"))))
    rows = written(rows.select("line", "docs", F.xxhash64("size", "path").alias("leaf")), "line-paths")
    leaves = rows.groupBy("leaf").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    return rows.join(leaves, "leaf", "left_semi").select("line", "leaf")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, least: int = MIN_TOKENS, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc, line) of the lines to drop, and their templates with document counts.

    ``docs`` has columns doc (any long that names a row) and text.
    """
    ship_package(docs.sparkSession)
    docs = docs.select("doc", "text", F.xxhash64("text").alias("same"))
    # a text stands for its copies: the first of each, where the table says that there may be some
    firsts = written(docs.groupBy("same").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("rows")), "line-firsts")
    copied = docs.sparkSession.sparkContext.broadcast(bit_table(firsts.where("rows > 1"), "same", BITS))

    def may_have_copies(names: list) -> np.ndarray:
        return copied.value[np.array([same for _, same in names], np.int64) & ((1 << BITS) - 1)].astype(bool)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, line, measures in _doc_lines(batches, lambda t: (len(t), len(t) - t.count(ANY), leading(t, depth))):
            yield pa.RecordBatch.from_pydict({
                "doc": pa.array([doc for doc, _ in d], pa.int64()), "same": pa.array([same for _, same in d], pa.int64()), "copied": pa.array(may_have_copies(d), pa.bool_()),
                "line": pa.array(line, pa.int64()), "size": pa.array([m[0] for m in measures], pa.int32()), "words": pa.array([m[1] for m in measures], pa.int32()),
                "lead": pa.array([m[2] for m in measures], pa.list_(pa.int64())),
            })

    seen = written(docs.mapInArrow(names, "doc long, same long, copied boolean, line long, size int, words int, lead array<long>"), "line-names")
    own = ["doc", "line", "size", "words", "lead"]
    # the rows of a repeated id with equal texts are one too
    some = seen.where("copied").join(firsts.select("same", "doc"), ["same", "doc"], "left_semi").select(*own).dropDuplicates(["doc", "line"])
    some = written(some, "line-firsts-names")
    once = seen.where("not copied").select(*own).unionByName(some)
    distinct = once.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), *[F.min(c).alias(c) for c in own[2:]])
    leaves = written(leaves_of(written(distinct, "line-distinct"), min_docs, least, share), "line-leaves")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_table(leaves, "line", BITS))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for d, line, joined in _doc_lines(batches, " ".join):
            alone = (~may_have_copies(d)).astype(np.int64)
            keep = np.flatnonzero(table[np.array(line, np.int64) & ((1 << BITS) - 1)]) if line else []
            yield pa.RecordBatch.from_pydict({"line": pa.array([line[i] for i in keep], pa.int64()), "tokens": pa.array([joined[i] for i in keep], pa.string()), "n": pa.array([int(alone[i]) for i in keep], pa.int64())})

    lines = docs.mapInArrow(texts, "line long, tokens string, n long")
    lines = lines.unionByName(some.select("line", F.lit(None).cast("string").alias("tokens"), F.lit(1).cast("long").alias("n")))
    lines = lines.groupBy("line").agg(F.sum("n").alias("docs"), F.min("tokens").alias("tokens"))
    lines = written(lines.join(leaves, "line"), "line-texts")
    places = lines.select("leaf", "line", "docs", F.posexplode(F.split("tokens", " ", -1)).alias("place", "token"))
    common = places.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where((F.col("n") >= min_docs) & (F.col("token") != ANY))
    marked = places.join(common.withColumn("fixed", F.lit(True)), ["leaf", "place", "token"], "left")
    entry = F.struct("place", F.when(F.col("fixed"), F.col("token")).otherwise(ANY).alias("token"))
    shaped = marked.groupBy("leaf", "line").agg(F.sort_array(F.collect_list(entry))["token"].alias("shape"), F.count_if("fixed").alias("n_fixed"), F.count_if(F.col("token") != ANY).alias("n_words"), F.max(F.col("fixed") & F.col("token").rlike(r"\p{L}")).alias("letters"), F.first("docs").alias("docs"))
    varied = (F.col("n_fixed") >= least) & (100 * F.col("n_fixed") >= share * F.col("n_words"))
    equal = F.col("docs") >= min_docs
    enough = (varied | equal) & (F.coalesce("letters", F.lit(False)) | (F.col("n_words") == F.size("shape")))
    shaped = written(shaped.where(enough).select("line", F.array_join("shape", " ").alias("template")), "line-shapes")
    hits = once.select("doc", "line").join(shaped, "line")
    templates = hits.select("template", "doc").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    templates = written(templates, "line-templates")
    drop = shaped.join(templates.select("template"), "template", "left_semi").select("line")
    return seen.select("doc", "line").join(drop, "line", "left_semi"), templates


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, least: int = MIN_TOKENS, share: int = SHARE, counts: bool = False) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped from text; with ``counts`` also ``_n_lines`` and ``_n_dropped``."""
    shared_folder(docs.sparkSession)
    own = _free("_doc", docs.columns), _free("_drops", docs.columns), _free("_new", docs.columns)
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    found, _ = recurring_lines(docs.select(name.alias("doc"), F.col("text").cast("string").alias("text")), min_docs, depth, least, share)
    drops = found.groupBy(F.col("doc").alias(own[0])).agg(F.collect_set("line").alias(own[1]))

    @F.pandas_udf("struct<text string, dropped long>")
    def rewrite(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out, n = [], []
        for text, gone in zip(texts, drops):
            if text is None or gone is None:
                out.append(text)
                n.append(0)
                continue
            gone, lines = set(gone), text.split("\n")
            kept = [x for x in lines if (k := line_key(x)) is None or k[0] not in gone]
            out.append("\n".join(kept))
            n.append(len(lines) - len(kept))
        return pd.DataFrame({"text": out, "dropped": n})

    rows = docs.withColumn(own[0], name).join(drops, own[0], "left")
    some = F.col(own[1]).isNotNull()
    # texts without such a line do not go to Python
    rows = rows.withColumn(own[2], rewrite(F.when(some, F.col("text")), own[1]))
    text = F.when(some, F.col(f"{own[2]}.text")).otherwise(F.col("text"))
    extra = []
    if counts:
        n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
        extra = [n_lines.alias("_n_lines"), F.coalesce(f"{own[2]}.dropped", F.lit(0)).cast("long").alias("_n_dropped")]
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *extra)


def _free(name: str, taken: list[str]) -> str:
    """``name``, longer where a column has it."""
    while name in taken:
        name += "_"
    return name


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that is left."""
    rows = without_recurring_lines(docs.select("doc_id", "text"), counts=True)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
