"""File documentation and symbol rows (A2, B1, B2, D3, E3, G2, X21, U1 dispatch).

A file row is turned into its nested documentation by the extractor of its
language (first registered extension wins), and the documentation into
symbol rows in registration order, all inside the row: ``posexplode`` of one
array gives the within-file position.  The only cross-row step is the
insertion order ``ord``, taken from ``monotonically_increasing_id`` over the
exploded rows (partition order, then row order) plus the batch number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdex.functions.columns import let


from symdex.schemas import ALIAS_T, CLASS_T, FUNC_T, IFACE_T, LANGUAGE_BY_EXTENSION, ROUTE_T

# Extractors by language; ``register_extractor`` adds to it (U1).  Built-in
# languages are staged (see ``_builtin_stages``) and map to None here.
_EXTRACTORS: dict[str, object] = {}
_EXTENSIONS: list[tuple[tuple[str, ...], str]] = []


def register_extractor(extensions, language: str, fn) -> None:
    """Plug a language in.

    ``fn(content: Column) -> Column`` returns a struct with the five DOC_T
    fields (functions, classes, interfaces, type_aliases, routes).  Dispatch is
    by extension, first registered wins, as for the built-in languages.
    """
    _builtins()
    _EXTENSIONS.append((tuple(e.lower().lstrip(".") for e in extensions), language))
    _EXTRACTORS[language] = fn


def _builtins() -> None:
    if _EXTENSIONS:
        return
    _EXTENSIONS.extend(LANGUAGE_BY_EXTENSION)
    _EXTRACTORS.update({lang: None for _exts, lang in LANGUAGE_BY_EXTENSION})


def language_of(path: Column, extensions=None) -> Column:
    """B1 over the registered extensions (first registered wins)."""
    _builtins()
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    chain = None
    for exts, lang in (extensions if extensions is not None else _EXTENSIONS):
        cond = ext.isin(*exts)
        chain = F.when(cond, F.lit(lang)) if chain is None else chain.when(cond, F.lit(lang))
    return chain


_DOC_EXPR: dict[tuple, Column] = {}


def _doc_expression(spark, extensions, extractors) -> Column:
    """The per-file document expression, built once per session (it is large)."""
    from symdex.operators.extract_python import python_file_doc
    from symdex.operators.extract_ts import script_file_doc

    key = (spark.sparkContext.applicationId, tuple(extensions), tuple(sorted(map(str, extractors.items()))))
    if key not in _DOC_EXPR:
        lang = F.col("language")
        doc = (F.when(lang == "py", conform_doc(python_file_doc(F.col("content")), keep_empty=True))
               .when(lang.isin("ts", "js"), conform_doc(script_file_doc(F.col("content"), lang, F.col("path")),
                                                        keep_empty=False)))
        for _exts, name in extensions:
            if extractors.get(name) is not None:
                doc = doc.when(lang == name, conform_doc(extractors[name](F.col("content")), keep_empty=True))
        _DOC_EXPR[key] = doc
    return _DOC_EXPR[key]


def file_docs(files: DataFrame, plugins=()) -> DataFrame:
    """X21 + B2: (path, language, doc, error, details) per file row.

    ``files``: (path, content).  One projection over the rows, no shuffle: the
    parallelism is that of the input, which the caller chooses (a corpus scan has
    many partitions).  Unsupported extensions and files without readable content (null)
    give an error row and no document (nothing is thrown).
    ``plugins``: extra ``(extensions, language, fn)`` extractors for this call
    only (U1), tried after the registered ones.
    """
    _builtins()
    extensions = list(_EXTENSIONS) + [(tuple(e.lower().lstrip(".") for e in exts), name) for exts, name, _ in plugins]
    extractors = dict(_EXTRACTORS)
    extractors.update({name: fn for _, name, fn in plugins})
    lang = F.col("language")
    df = files.select("path", "content").withColumn("language", language_of(F.col("path"), extensions))
    ext = F.lower(F.regexp_extract(F.col("path"), r"(\.[^./]*)$", 1))
    return df.select(
        "path", "language", F.when(F.col("content").isNotNull(), _doc_expression(files.sparkSession, extensions, extractors)).alias("doc"),
        F.when(lang.isNull(), F.lit("Unsupported file type")).when(F.col("content").isNull(), F.lit("Parsing error")).alias("error"),
        F.when(lang.isNull(), F.concat(F.lit("No parser available for file type: "), ext))
        .when(F.col("content").isNull(), F.concat(F.lit("File cannot be read: "), F.col("path"))).alias("details"),
    )


def requested_file_docs(wanted: DataFrame, files: DataFrame, plugins=()) -> DataFrame:
    """B2 + X21 for the paths asked for: (path, language, doc, error, details), one row a different path of ``wanted``.

    An empty path, a path that is not in ``files``, an extension without a parser and a file without readable content
    (null) give error rows.  Only the files asked for are parsed, each once.
    """
    asked = wanted.select(F.col("path").alias("_p")).distinct()
    have = files.select("path", "content").join(asked, F.col("path") == F.col("_p"), "left_semi").dropDuplicates(["path"])
    rows = asked.join(file_docs(have, plugins), F.col("_p") == F.col("path"), "left")
    path = F.col("_p")
    empty, missing = F.coalesce(path, F.lit("")) == "", F.col("path").isNull()
    return rows.select(
        path.alias("path"), "language", "doc",
        F.when(empty, F.lit("Invalid input")).when(missing, F.lit("File not found")).otherwise(F.col("error")).alias("error"),
        F.when(empty, F.lit('Missing or invalid "file" field')).when(missing, F.concat(F.lit("File not found at path: "), path))
        .otherwise(F.col("details")).alias("details"))


def conform_doc(doc: Column, keep_empty: bool) -> Column:
    """Cast an extractor's struct (all five fields) to DOC_T; empty arrays -> null unless kept (D3)."""
    def body(d):
        parts = []
        for f, t in (("functions", FUNC_T), ("classes", CLASS_T), ("interfaces", IFACE_T),
                     ("type_aliases", ALIAS_T), ("routes", ROUTE_T)):
            v = F.coalesce(d.getField(f).cast(f"array<{t}>"), F.array().cast(f"array<{t}>"))
            if not keep_empty:
                v = F.when(F.size(v) > 0, v)
            parts.append(v.alias(f))
        return F.struct(*parts)
    return let(doc, body)


def _signature(params: Column, ret: Column) -> Column:
    suffix = F.when(ret.isNotNull() & (ret != ""), F.concat(F.lit(": "), ret)).otherwise(F.lit(""))
    return F.concat(F.lit("("), F.array_join(params, ", "), F.lit(")"), suffix)


def _sym(symbol, kind, desc, sig, exported, parent=None, is_component=None, visibility=None,
         r_method=None, r_path=None, handler=None) -> Column:
    n = lambda v, t="string": v if v is not None else F.lit(None).cast(t)
    return F.struct(
        symbol.alias("symbol"), F.lit(kind).alias("type"), n(desc).alias("description"), n(sig).alias("signature"),
        n(exported, "boolean").alias("exported"), n(parent).alias("parent_symbol"),
        n(is_component, "boolean").alias("is_component"), n(visibility).alias("visibility"),
        n(r_method).alias("route_method"), n(r_path).alias("route_path"), n(handler).alias("handler"),
    )


def doc_symbols(doc: Column) -> Column:
    """Nested documentation -> symbol structs in registration order."""
    empty = lambda t: F.array().cast(f"array<{t}>")
    arr = lambda f, t: F.coalesce(doc.getField(f), empty(t))
    funcs = F.transform(arr("functions", FUNC_T), lambda f: _sym(
        f["name"], "function", f["description"], _signature(f["params"], f["return_type"]), f["exported"]))
    classes = F.flatten(F.transform(arr("classes", CLASS_T), lambda c: F.concat(
        F.array(_sym(c["name"], "class", c["description"], None, c["exported"], is_component=c["is_component"])),
        F.transform(c["methods"], lambda m: _sym(
            m["name"], "method", m["description"], _signature(m["params"], m["return_type"]), c["exported"],
            c["name"], visibility=F.coalesce(m["visibility"], F.lit("public")))),
        F.transform(c["properties"], lambda p: _sym(
            p["name"], "property", p["description"],
            F.when(p["type"].isNotNull() & (p["type"] != ""), F.concat(F.lit(": "), p["type"])).otherwise(F.lit("")),
            c["exported"], c["name"], visibility=F.coalesce(p["visibility"], F.lit("public")))),
    )))
    ifaces = F.flatten(F.transform(arr("interfaces", IFACE_T), lambda c: F.concat(
        F.array(_sym(c["name"], "interface", c["description"], None, c["exported"])),
        F.transform(c["properties"], lambda p: _sym(
            p["name"], "property", p["description"],
            F.when(p["type"].isNotNull() & (p["type"] != ""), F.concat(F.lit(": "), p["type"])).otherwise(F.lit("")),
            c["exported"], c["name"])),
        F.transform(c["methods"], lambda m: _sym(
            m["name"], "method", m["description"], _signature(m["params"], m["return_type"]), c["exported"], c["name"])),
    )))
    aliases = F.transform(arr("type_aliases", ALIAS_T), lambda a: _sym(
        a["name"], "type", a["description"], F.concat(F.lit(": "), a["type"]), a["exported"]))
    routes = F.transform(arr("routes", ROUTE_T), lambda r: _sym(
        F.concat_ws(" ", r["method"], r["path"]), "route", r["description"], None, None,
        r_method=r["method"], r_path=r["path"], handler=r["handler"]))
    return F.concat(funcs, classes, ifaces, aliases, routes)


SYMBOL_FIELDS = ["symbol", "type", "description", "signature", "exported", "parent_symbol",
                 "is_component", "visibility", "route_method", "route_path", "handler"]


def flatten_file_docs(docs: DataFrame) -> DataFrame:
    """(path, doc) -> (file, seq, symbol fields...), seq = registration position in the file."""
    # The outer generator plus an explicit null test keeps Catalyst from inferring a
    # ``size(array) > 0`` filter that it would push below the projection and so
    # evaluate the whole extraction twice.
    syms = docs.select(F.col("path").alias("file"), let(F.col("doc"), doc_symbols).alias("_syms"))
    return syms.select("file", F.posexplode_outer("_syms").alias("seq", "s")).where(F.col("seq").isNotNull()).select(
        "file", "seq", *[F.col(f"s.{f}").alias(f) for f in SYMBOL_FIELDS])


def doc_symbol_counts(files: DataFrame) -> DataFrame:
    """(path, n_symbols): how many symbols each file that can be parsed has, keys counted once."""
    docs = file_docs(files.select("path", "content")).where(F.col("error").isNull())
    keys = let(F.col("doc"), lambda d: F.size(F.array_distinct(F.transform(doc_symbols(d), lambda s: F.struct(s["symbol"], s["type"], s["parent_symbol"])))))
    return docs.select("path", keys.alias("n_symbols"))


def next_ord(symbols: DataFrame) -> int:
    """First free insertion number of a symbol table (one scalar aggregate)."""
    top = symbols.agg(F.max("ord").alias("m")).first()["m"]
    return 0 if top is None else int(top) + 1


def in_file_order(files: DataFrame) -> DataFrame:
    """Files in ranges of their paths.  Rows that each file is then turned into, in place, stay in order of path and place."""
    return files.repartitionByRange("path").sortWithinPartitions("path")


def insertion_order(rows: DataFrame, offset: int = 0) -> DataFrame:
    """Unique ``ord``, increasing by path and place in the file: ``offset`` + ``monotonically_increasing_id``.

    ``rows`` are the symbols of files that were put in order before they were parsed (:func:`in_file_order`), so
    the order does not depend on how the input was split and the range shuffle samples paths, not parsed
    files; files of a later batch start above every existing ``ord``
    (``offset`` = :func:`next_ord`) and so move to the end (Q1).  Gaps between
    partitions are harmless.
    """
    return rows.withColumn("ord", F.lit(offset).cast("long") + F.monotonically_increasing_id())


def to_symbol_table(rows: DataFrame, offset: int = 0) -> DataFrame:
    """Flattened rows -> the symbol-table schema."""
    ordered = insertion_order(rows, offset)
    return ordered.select(
        "ord", "symbol", "type", "file", "description", "signature", "exported", "parent_symbol",
        F.struct("is_component", "visibility", "route_method", "route_path", "handler").alias("metadata"),
    )


def extract_symbols(files: DataFrame, offset: int = 0) -> DataFrame:
    """Files -> symbol table rows (the ``extract`` step of a refresh)."""
    return to_symbol_table(flatten_file_docs(file_docs(in_file_order(files.select("path", "content")))), offset)
