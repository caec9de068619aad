"""Versioned storage of the registry: symbols and file tracking under one pointer.

Both tables are cut into buckets by a hash of the file path; a bucket's rows stand together in a Parquet folder that
is never changed.  A commit writes one new folder a table for all buckets it touches, sorted by bucket, then a manifest that
names where the rows of every bucket of both tables are; moving the manifest to its numbered name is the commit.  So

* a reader takes the newest manifest and sees both tables as one commit left them;
* a commit writes what its files' buckets hold, not what the tables hold, and reads the pages that hold them;
* the number of files of a commit is that of its tasks, however many buckets it touches;
* a commit that is cut off leaves folders that no manifest names (``vacuum`` removes them), and nothing else.

Buckets grow by extendible hashing: one whose symbols have outgrown ``max_rows`` is split by the next
bits of the hash when a commit rewrites it.  The manifest also keeps the next free ``ord``.

A store with ``index=True`` keeps, beside the symbols of a bucket, their gram table (:func:`gram_index`) sorted by gram
and how many symbols hold each gram.  A commit derives both anew for the buckets it touches, so searches
(``search_index``) see the symbols, the grams and their counts of one commit, and nothing is indexed on a search.
One writer at a time; a second one fails at the move.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.operators.search import gram_index
from symdex.schemas import FILE_TRACKING, SYMBOLS

MAX_ROWS = 500_000
KEYS = {"symbols": "file", "tracking": "path"}
SCHEMAS = {"symbols": SYMBOLS, "tracking": FILE_TRACKING,
           "grams": "gram string, salt int, ord long, symbol string, type string, file string, exported boolean, visibility string",
           "gram_counts": "gram string, n long"}


@dataclass
class Bucket:
    """Paths whose hash ends in the ``depth`` bits of ``value``: where its rows of each table are (none when empty) and its number of symbols.

    A place is ``folder#id:n``: the rows of the folder whose ``bucket`` is ``id``, one of the ``n`` that it holds; without a ``#``
    the folder is the bucket's own (older stores).  ``indexed``: whether the gram tables are those of the symbols.
    """

    value: int
    depth: int
    symbols: str | None = None
    tracking: str | None = None
    rows: int = 0
    grams: str | None = None
    gram_counts: str | None = None
    indexed: bool = False


@dataclass
class Manifest:
    version: int
    next_ord: int
    buckets: list[Bucket]

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "next_ord": self.next_ord, "buckets": [vars(b) for b in self.buckets]})

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text)
        return Manifest(raw["version"], raw["next_ord"], [Bucket(**b) for b in raw["buckets"]])


def bucket_number(path: Column, buckets: list[Bucket], numbers: list[int] | None = None) -> Column:
    """The place in ``buckets`` of the one that holds a path, or its number in ``numbers``."""
    depth = max(b.depth for b in buckets)
    owner = [0] * (1 << depth)
    for i, b in enumerate(buckets):
        for low in range(b.value, 1 << depth, 1 << b.depth):
            owner[low] = i if numbers is None else numbers[i]
    at = F.pmod(F.xxhash64(path), F.lit(1 << depth)).cast("int")
    return F.element_at(F.expr(f"array({', '.join(map(str, owner))})"), at + 1)


def bucket_ids(buckets: list[Bucket], version: int) -> list[int]:
    """What the rows of each bucket carry as ``bucket`` when a version writes them; no two versions and no two buckets have the same."""
    return [(version << 32) + (1 << b.depth) + b.value for b in buckets]


class RegistryStore:
    def __init__(self, spark: SparkSession, root: str, max_rows: int = MAX_ROWS, index: bool = False):
        self.spark, self.root, self.max_rows, self.index = spark, root.rstrip("/"), max_rows, index

    # --- files of the store, through Hadoop's file systems ---------------------------

    def _path(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def manifest(self) -> Manifest:
        """The newest committed manifest; one empty bucket before the first commit."""
        versions = sorted(n for n in self._names("manifests") if n.startswith("v") and n.endswith(".json"))
        if not versions:
            return Manifest(0, 0, [Bucket(0, 0)])
        text = self.spark.read.text(f"{self.root}/manifests/{versions[-1]}", wholetext=True).first()[0]
        return Manifest.from_json(text)

    def _publish(self, manifest: Manifest) -> None:
        fs = self._fs()
        draft = self._path("manifests", f".draft-{uuid.uuid4().hex}")
        final = self._path("manifests", f"v{manifest.version:010d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(manifest.to_json().encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest.version} was committed by another writer")

    # --- reading ----------------------------------------------------------------------

    def read(self, table: str, manifest: Manifest | None = None, only: list[Bucket] | None = None) -> DataFrame:
        """A table as a manifest has it, all of it or some buckets."""
        manifest = manifest or self.manifest()
        return self._rows(table, [getattr(b, table) for b in (manifest.buckets if only is None else only) if getattr(b, table)])

    def _rows(self, table: str, places: list[str]) -> DataFrame:
        """The rows of a table at some places (see :class:`Bucket`)."""
        schema = SCHEMAS[table]
        if not places:
            return self.spark.createDataFrame([], schema)
        asked: dict[str, list[str]] = {}
        for place in places:
            folder, _, own = place.partition("#")
            asked.setdefault(folder, []).append(own)
        # a folder of which every bucket is asked for is read as it is
        whole = [f for f, own in asked.items() if own == [""] or len(own) == int(own[0].split(":")[1])]
        parts = {f: own for f, own in asked.items() if f not in set(whole)}
        found = []
        if whole:
            found.append(self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in whole]))
        if parts:
            ids = sorted(int(x.split(":")[0]) for own in parts.values() for x in own)
            fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            rows = self.spark.read.schema(f"{fields}, bucket long").parquet(*[f"{self.root}/{f}" for f in parts])
            found.append(rows.where(F.col("bucket").isin(ids)).drop("bucket"))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def load(self) -> tuple[DataFrame, DataFrame]:
        """(symbols, tracking) of one and the same commit."""
        manifest = self.manifest()
        return self.read("symbols", manifest), self.read("tracking", manifest)

    def search_index(self, manifest: Manifest | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(symbols, grams, counts) of one commit, for ``rank_within_request`` and the dispatcher."""
        manifest = manifest or self.manifest()
        bare = sum(b.rows > 0 and not b.indexed for b in manifest.buckets)
        if bare:
            raise ValueError(f"{bare} buckets were written without an index; replace_all of a store with index=True builds it")
        counts = self.read("gram_counts", manifest).groupBy("gram").agg(F.sum("n").alias("n"))
        return self.read("symbols", manifest), self.read("grams", manifest), counts

    def touched(self, paths: DataFrame, manifest: Manifest) -> list[Bucket]:
        """The buckets that hold the paths of ``paths`` (path)."""
        found = paths.select(bucket_number(F.col("path"), manifest.buckets).alias("b")).distinct().collect()  # at most one row a bucket
        return [manifest.buckets[r["b"]] for r in found]

    # --- writing ------------------------------------------------------------------------

    def commit(self, paths: DataFrame, symbols: DataFrame, tracking: DataFrame, manifest: Manifest | None = None) -> Manifest:
        """A new version in which the files of ``paths`` (path) have the rows of ``symbols`` and ``tracking``, and no others.

        ``symbols`` are numbered by the caller from ``manifest.next_ord`` on.  ``paths`` are read more than once and should be a table or checkpoint.
        """
        manifest = manifest or self.manifest()
        touched = self.touched(paths, manifest)
        if not touched:
            return manifest
        gone = paths.select("path").distinct()
        old = {t: self.read(t, manifest, touched).join(gone.withColumnRenamed("path", KEYS[t]), KEYS[t], "left_anti") for t in KEYS}
        return self._write(manifest, touched, {"symbols": old["symbols"].select(*SYMBOLS.fieldNames()).unionByName(symbols.select(*SYMBOLS.fieldNames())),
                                               "tracking": old["tracking"].select(*FILE_TRACKING.fieldNames()).unionByName(tracking.select(*FILE_TRACKING.fieldNames()))})

    def replace_all(self, symbols: DataFrame, tracking: DataFrame) -> Manifest:
        """A new version that holds these tables and nothing else."""
        manifest = self.manifest()
        rows = symbols.count()
        whole = Bucket(0, 0, rows=rows)
        return self._write(Manifest(manifest.version, 0, [whole]), [whole], {"symbols": symbols.select(*SYMBOLS.fieldNames()), "tracking": tracking.select(*FILE_TRACKING.fieldNames())})

    def _write(self, manifest: Manifest, touched: list[Bucket], tables: dict[str, DataFrame]) -> Manifest:
        new = []
        for b in touched:  # outgrown buckets are split as they are rewritten
            more = max(0, (max(b.rows - 1, 0) // self.max_rows).bit_length())
            new += [Bucket(b.value + (i << b.depth), b.depth + more) for i in range(1 << more)]
        rewritten = {id(b) for b in touched}
        buckets = [b for b in manifest.buckets if id(b) not in rewritten] + new
        folder = f"data/v{manifest.version + 1:010d}-{uuid.uuid4().hex}"
        ids = bucket_ids(buckets, manifest.version + 1)
        owners = dict(zip(ids, buckets, strict=True))
        next_ord = manifest.next_ord
        for name, rows in tables.items():
            numbered = rows.withColumn("bucket", bucket_number(F.col(KEYS[name]), buckets, ids))
            # the rows of a bucket stand together, so that a read of some buckets skips the pages of the others
            numbered.repartition("bucket").sortWithinPartitions("bucket").write.parquet(f"{self.root}/{folder}/{name}")
            # which buckets have rows, how many, and the next ord, off the files just written: a row a rewritten bucket
            top = F.max("ord") if name == "symbols" else F.lit(None).cast("long")
            sizes = self._written(folder, name, f"{'ord long, ' * (name == 'symbols')}bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), top.alias("top")).collect()
            self._place(f"{folder}/{name}", name, owners, [r["bucket"] for r in sizes])
            if name == "symbols":
                for r in sizes:
                    owners[r["bucket"]].rows = r["n"]
                    next_ord = max(next_ord, r["top"] + 1)
        if self.index:
            self._write_index(folder, buckets, ids, new)
        done = Manifest(manifest.version + 1, next_ord, buckets)
        self._publish(done)
        return done

    def _written(self, folder: str, name: str, schema: str) -> DataFrame:
        """Columns of a table just written; a folder of no rows at all has no schema to read."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/{name}")

    def _place(self, folder: str, name: str, owners: dict[int, Bucket], present: list[int]) -> None:
        """Notes in the buckets with rows that their table ``name`` is in a folder."""
        for i in present:
            setattr(owners[i], name, f"{folder}#{i}:{len(present)}")

    def _write_index(self, folder: str, buckets: list[Bucket], ids: list[int], new: list[Bucket]) -> None:
        """The gram tables of rewritten buckets, off the symbols just written."""
        if any(b.symbols for b in new):
            owners = dict(zip(ids, buckets, strict=True))
            grams = gram_index(self._rows("symbols", [b.symbols for b in new if b.symbols])).withColumn("bucket", bucket_number(F.col("file"), buckets, ids))
            # a bucket's grams are dealt by salt, and sorted, so that a search skips row groups
            grams.repartition("bucket", "salt").sortWithinPartitions("bucket", "gram").write.parquet(f"{self.root}/{folder}/grams")
            counts = self._written(folder, "grams", "bucket long, gram string").groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
            counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.parquet(f"{self.root}/{folder}/gram_counts")
            for name in ("grams", "gram_counts"):
                present = self._written(folder, name, "bucket long").distinct().collect()  # a row a rewritten bucket
                self._place(f"{folder}/{name}", name, owners, [r["bucket"] for r in present])
        for b in new:
            b.indexed = True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove the folders that none of the newest ``keep`` manifests names, left by older versions and commits that were cut off."""
        versions = sorted(n for n in self._names("manifests") if n.startswith("v"))[-keep:]
        named = set()
        for v in versions:
            m = Manifest.from_json(self.spark.read.text(f"{self.root}/manifests/{v}", wholetext=True).first()[0])
            named |= {f.split("/")[1] for b in m.buckets for f in (b.symbols, b.tracking, b.grams, b.gram_counts) if f}
        fs, gone = self._fs(), [n for n in self._names("data") if n not in named]
        for n in gone:
            fs.delete(self._path("data", n), True)
        return gone


def refresh_store(store: RegistryStore, listing: DataFrame, files: DataFrame, now, full_scan: bool = False) -> DataFrame:
    """G8 + D1 on the store: one commit that drops deleted files and parses stale (or all listed) ones anew; the summary row.

    ``listing``: path, mtime of the files on disk; ``files``: their path and content.  Files that are only stamped
    and files that go are found from the tracking table; their buckets and those of the parsed files are rewritten, no others.
    """
    from symdex.operators import registry as G
    from symdex.operators.file_docs import extract_symbols
    from symdex.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(store.spark)
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    manifest = store.manifest()
    tracking = store.read("tracking", manifest)
    gone = G.deleted_files(tracking, listing).where("exists").select("path", F.lit(None).cast("timestamp").alias("mtime"), F.lit(True).alias("gone"))
    todo = (listing if full_scan else G.stale_files(tracking, listing)).select("path", "mtime", F.lit(False).alias("gone"))
    # a listing may hold a path once for each pattern
    changes = gone.unionByName(todo).checkpoint()
    n_todo = changes.where("not gone").count()
    once = changes.dropDuplicates(["path"])
    source = files.select("path", "content").dropDuplicates(["path"]).join(once.where("not gone").select("path"), "path", "left_semi")
    parsed = source.select("path").checkpoint()
    # a stale file without content keeps what it has
    paths = once.where("gone").select("path").unionByName(parsed)
    fresh = G.dedupe_symbols(extract_symbols(source, offset=manifest.next_ord))
    stamped = once.where("not gone").join(parsed, "path", "left_semi").select("path", at.alias("last_parsed"), F.coalesce("mtime", at).alias("last_modified"), F.lit(True).alias("exists"))
    missing = tracking.join(once.where("gone").select("path"), "path", "left_semi").withColumn("exists", F.lit(False))
    done = store.commit(paths, fresh, stamped.unionByName(missing.select(*FILE_TRACKING.fieldNames())), manifest)
    n_symbols = sum(b.rows for b in done.buckets)
    return store.spark.createDataFrame([(True, n_todo, 0, n_symbols)], "refreshed boolean, files_processed int, files_removed int, symbols int")
