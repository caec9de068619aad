"""Source-file scans and sinks.

A corpus is listed folder by folder in parallel and, where contents are asked for, read
by tasks of about equal numbers of files.  Spark's own file sources leave out every
name that starts with ``_``, which a corpus is full of (``__init__.py``, ``__tests__``), so files are listed and
read through Arrow's file systems (local, HDFS, S3, GCS, Azure).  A root of another scheme is read with
``binaryFile``, without those names.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.operators.registry import union_listings
from symdex.schemas import DEFAULT_PATTERNS

#: Scheme and authority of a URI, before its path.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?"
#: The driver lists folders level by level until there are so many to deal out.
FOLDERS = 256
#: Files that one task reads, about.
FILES_PER_TASK = 2_000
#: Files of a folder that a listing task holds at a time.
ENTRIES = 10_000


def read_source_text(files: DataFrame) -> DataFrame:
    """A2: file bytes -> UTF-8 text; invalid byte sequences are replaced."""
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def file_system(uri: str) -> tuple[pafs.FileSystem, str] | None:
    """Arrow's file system for a URI or a local path, and the path in it; None for a scheme it does not know."""
    if not re.match(_SCHEME, uri):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(_SCHEME, "", uri)
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        return None


def _entries_of(system: pafs.FileSystem, folder: str) -> Iterator[tuple]:
    """(path, is_file, mtime in ns, size) of the files and folders in a folder; a local one is read entry by entry, however many there are."""
    if not isinstance(system, pafs.LocalFileSystem):
        for i in system.get_file_info(pafs.FileSelector(folder)):
            if i.type in (pafs.FileType.File, pafs.FileType.Directory):
                yield i.path, i.type == pafs.FileType.File, i.mtime_ns, i.size
        return
    with os.scandir(folder) as found:
        for e in found:
            try:
                if e.is_dir():
                    yield e.path, False, None, None
                elif e.is_file():
                    own = e.stat()
                    yield e.path, True, own.st_mtime_ns, own.st_size
            except FileNotFoundError:  # gone since
                continue


def _listing(spark: SparkSession, base_dir: str) -> DataFrame | None:
    """(path, mtime, length) of all files below a folder, hidden names too; None where Arrow has no file system.

    The driver lists the first levels only; the folders it finds are listed, with all below them, by tasks.
    """
    known = file_system(base_dir)
    if known is None:
        return None
    system, root = known
    root = re.sub("/+", "/", root).rstrip("/") or "/"
    if system.get_file_info(root).type != pafs.FileType.Directory:
        raise ValueError(f"files listed for {base_dir} are not below it: no such folder")
    schema = "path string, mtime timestamp, length long"

    def entries(files: list[tuple]) -> pa.RecordBatch:
        paths, times, sizes = zip(*files)
        at = pa.array([t // 1000 for t in times], pa.int64()).cast(pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), at, pa.array(sizes, pa.int64())], names=["path", "mtime", "length"])

    whole, single = [root], []
    while whole and len(whole) + len(single) < FOLDERS:
        level = [i.path for f in whole for i in system.get_file_info(pafs.FileSelector(f)) if i.type == pafs.FileType.Directory]
        single += whole
        whole = level
    folders = [(f, True) for f in whole] + [(f, False) for f in single]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(base_dir)
        for batch in batches:
            for folder, below in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting = [folder]
                while waiting:
                    files = []
                    for path, is_file, mtime, size in _entries_of(own, waiting.pop()):
                        if is_file:
                            files.append((path, mtime, size))
                        elif below:
                            waiting.append(path)
                        if len(files) == ENTRIES:
                            yield entries(files)
                            files = []
                    if files:
                        yield entries(files)

    tasks = min(len(folders), FOLDERS)
    dealt = spark.createDataFrame(folders, "folder string, below boolean").repartition(tasks)
    return dealt.mapInArrow(listed, schema)


def _contents(listing: DataFrame, base_dir: str, n_tasks: int) -> DataFrame:
    """The listing with each file's bytes; null where a file has gone since."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(base_dir)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                try:
                    with own.open_input_stream(one.column(1)[0].as_py()) as f:
                        content = f.read()
                except FileNotFoundError:
                    content = None
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([content], pa.large_binary())], schema=one.schema.append(pa.field("content", pa.large_binary())))

    order = ["pattern_idx", "path", "mtime", "length"]
    return listing.select(*order).repartition(n_tasks, "path").mapInArrow(read, "pattern_idx int, path string, mtime timestamp, length long, content binary")


def scan_source_files(spark: SparkSession, base_dir: str, patterns=DEFAULT_PATTERNS, with_content: bool = True) -> DataFrame:
    """A1 + G1: one listing per pattern (relative to ``base_dir``), concatenated, duplicates kept.

    Output: pattern_idx, path (absolute, scheme and authority stripped), mtime, length[, content].
    Wildcards do not match the dot a name starts with (``.git``); names that start with ``_`` are as any other.
    The root is a folder, with or without a scheme; one that does not exist is an error.
    """
    root = re.sub("/+", "/", re.sub(_SCHEME, "", base_dir)).rstrip("/") + "/"
    listing = _listing(spark, base_dir)
    if listing is None:
        return _scan_by_spark(spark, base_dir, root, patterns, with_content)
    found = union_listings(listing, patterns, base_dir=root)
    if not with_content:
        return found
    # the number of files only decides how many tasks read them
    n = found.count()
    return read_source_text(_contents(found, base_dir, max(spark.sparkContext.defaultParallelism, n // FILES_PER_TASK)))


def _scan_by_spark(spark: SparkSession, base_dir: str, root: str, patterns, with_content: bool) -> DataFrame:
    """The scan by ``binaryFile``, for schemes that only Spark knows: names that start with ``_`` are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base_dir)
    path = F.regexp_replace(F.col("path"), _SCHEME, "")
    outside = F.raise_error(F.concat(F.lit(f"listed for {base_dir} but not below it: "), F.col("path")))
    cols = [F.when(path.startswith(root), path).otherwise(outside).alias("path"),
            F.col("modificationTime").alias("mtime"), F.col("length")]
    files = raw.select(*cols, *(["content"] if with_content else []))
    return union_listings(read_source_text(files) if with_content else files, patterns, base_dir=root)


def scope_filter(files: DataFrame, config: dict, base_dir: str = "/") -> DataFrame:
    """A4: keep files allowed by an include/exclude configuration.

    ``config`` = {"include": {"extensions", "directories", "files"},
    "exclude": {"extensions", "directories", "files"}}.  Reading: a file is
    kept when its extension is included (or the list is empty), one of its
    directories is included (or the list is empty), and neither its
    extension, any of its directories nor its file name (glob) is excluded;
    an ``include.files`` glob admits a file regardless of the include lists.
    Globs are translated to regexes once, on the driver.
    """
    inc, exc = config.get("include", {}), config.get("exclude", {})
    base = base_dir.rstrip("/") + "/"
    rel = F.when(F.col("path").startswith(base), F.expr(f"substring(path, {len(base) + 1})")).otherwise(F.col("path"))
    name = F.regexp_extract(rel, r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    dirs = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))

    def any_dir(ds):
        return F.exists(dirs, lambda d: d.isin(*ds)) if ds else F.lit(False)

    def name_glob(globs):
        if not globs:
            return F.lit(False)
        rx = "^(?:" + "|".join(f"(?:{fnmatch.translate(g)})" for g in globs) + ")"
        return name.rlike(rx)

    inc_ext = [e.lower().lstrip(".") for e in inc.get("extensions", [])]
    exc_ext = [e.lower().lstrip(".") for e in exc.get("extensions", [])]
    included = ((ext.isin(*inc_ext) if inc_ext else F.lit(True))
                & (any_dir(inc.get("directories", [])) if inc.get("directories") else F.lit(True)))
    excluded = ((ext.isin(*exc_ext) if exc_ext else F.lit(False))
                | any_dir(exc.get("directories", [])) | name_glob(exc.get("files", [])))
    return files.where((included | name_glob(inc.get("files", []))) & ~excluded)


def write_file_docs(docs: DataFrame, path: str, fmt: str = "json") -> None:
    """Write the nested per-file documents (one record per file)."""
    docs.write.mode("overwrite").format(fmt).save(path)
