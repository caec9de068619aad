"""The registry store: one pointer for both tables, untouched buckets stay, buckets grow, cut-off commits leave nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from symdex.operators.file_docs import extract_symbols
from symdex.operators.search import gram_counts, gram_index, rank_within_request
from symdex.schemas import FILE_TRACKING, SYMBOLS
from symdex.sources.store import Bucket, RegistryStore, bucket_number, refresh_store
from symdex.streaming.changes import CHANGE_SCHEMA, apply_changes

OLD, NEW = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)


def project(spark, n, body="export function f{i}() {{}}\n"):
    files = spark.createDataFrame([(f"/p/m{i}.ts", body.format(i=i)) for i in range(n)], "path string, content string")
    tracking = files.select("path", F.lit(OLD).alias("last_parsed"), F.lit(OLD).alias("last_modified"), F.lit(True).alias("exists"))
    return files, extract_symbols(files), tracking


def folders(manifest):
    return {f for b in manifest.buckets for f in (b.symbols, b.tracking) if f}


def test_buckets_share_out_all_paths(spark):
    buckets = [Bucket(0, 1), Bucket(1, 2), Bucket(3, 3), Bucket(7, 3)]
    paths = spark.range(2000).select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path"))
    low = F.pmod(F.xxhash64("path"), F.lit(8)).cast("int")
    got = paths.select(low.alias("low"), bucket_number(F.col("path"), buckets).alias("b")).distinct().collect()
    want = {0: 0, 2: 0, 4: 0, 6: 0, 1: 1, 5: 1, 3: 2, 7: 3}
    assert {r.low: r.b for r in got} == want


def test_refresh_touches_its_buckets_only(spark, tmp_path):
    """A stale, a deleted and an unseen file: a commit of the same size for a store four times as large."""
    sizes = []
    for n in (100, 400):
        store = RegistryStore(spark, f"{tmp_path}/s{n}", max_rows=4)
        files, symbols, tracking = project(spark, n)
        store.replace_all(symbols, tracking)
        before = store.manifest()
        assert len(before.buckets) >= n // 8 and sum(b.rows for b in before.buckets) == n
        changed = files.where(F.col("path") != "/p/m7.ts").withColumn("content", F.when(F.col("path") == "/p/m3.ts", F.lit("export function g() {}\nexport function h() {}\n")).otherwise(F.col("content")))
        changed = changed.unionByName(spark.createDataFrame([("/p/unseen.ts", "export function u() {}\n")], "path string, content string"))
        listing = changed.select("path", F.when(F.col("path") == "/p/m3.ts", F.lit(NEW)).otherwise(F.lit(OLD)).alias("mtime"))
        row = refresh_store(store, listing, changed, NEW).first()
        assert (row.files_processed, row.files_removed, row.symbols) == (1, 0, n)  # two for one, and one gone; unseen files are not looked for
        after = store.manifest()
        assert after.version == before.version + 1 and len(folders(before) - folders(after)) <= 4  # two tables, two buckets
        sizes.append(sum(b.rows for b in after.buckets if b.symbols and b.symbols not in folders(before)))
        syms, tracked = store.load()
        assert {r.symbol for r in syms.where("file in ('/p/m3.ts', '/p/m7.ts')").collect()} == {"g", "h"}
        assert syms.agg(F.max("ord")).first()[0] == after.next_ord - 1 and syms.count() == syms.select("ord").distinct().count()
        assert {r.path: (r.last_parsed, r.exists) for r in tracked.where("path in ('/p/m3.ts', '/p/m7.ts', '/p/m8.ts')").collect()} == {
            "/p/m3.ts": (NEW, True), "/p/m7.ts": (OLD, False), "/p/m8.ts": (OLD, True)}
    assert max(sizes) <= 4 * 8 and abs(sizes[0] - sizes[1]) <= 12


def test_outgrown_bucket_is_split(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path), max_rows=10)
    for batch in range(4):
        files = spark.createDataFrame([(f"/b{batch}/m{i}.ts", f"export function f{i}() {{}}\n") for i in range(20)], "path string, content string").checkpoint()
        m = store.manifest()
        tracking = files.select("path", F.lit(OLD).alias("last_parsed"), F.lit(OLD).alias("last_modified"), F.lit(True).alias("exists"))
        store.commit(files.select("path"), extract_symbols(files, offset=m.next_ord), tracking)
    m = store.manifest()
    assert len(m.buckets) > 1 and max(b.rows for b in m.buckets) <= 10 + 20 and sum(b.rows for b in m.buckets) == 80
    syms, tracked = store.load()
    assert syms.count() == 80 and tracked.count() == 80
    order = [r.file.split("/")[1] for r in syms.orderBy("ord").collect()]
    assert order == sorted(order)  # later batches stand above earlier ones


def test_cut_off_commit_is_not_seen(spark, tmp_path, monkeypatch):
    store = RegistryStore(spark, str(tmp_path), max_rows=4)
    files, symbols, tracking = project(spark, 20)
    store.replace_all(symbols, tracking)
    before = store.manifest()

    def stop(manifest):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", stop)
        with pytest.raises(RuntimeError, match="cut off"):
            store.commit(files.select("path"), spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], FILE_TRACKING))
    assert store.manifest() == before
    assert store.load()[0].count() == 20 and store.load()[1].count() == 20
    assert len(store.vacuum()) == 1 and store.load()[0].count() == 20


def test_reader_keeps_the_version_it_took(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path), max_rows=4)
    files, symbols, tracking = project(spark, 12)
    store.replace_all(symbols, tracking)
    taken = store.manifest()
    store.commit(files.select("path"), spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], FILE_TRACKING))
    assert store.read("symbols", taken).count() == store.read("tracking", taken).count() == 12
    assert store.load()[0].count() == store.load()[1].count() == 0


def test_second_writer_of_a_version_fails(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path))
    files, symbols, tracking = project(spark, 3)
    stale = store.manifest()
    store.replace_all(symbols, tracking)
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(files.select("path"), symbols, tracking, stale)
    assert store.load()[0].count() == 3


def test_empty_store(spark, tmp_path):
    store = RegistryStore(spark, f"{tmp_path}/none")
    assert store.load()[0].count() == store.load()[1].count() == 0 and store.vacuum() == []


def test_gram_index_follows_the_commits(spark, tmp_path):
    """The stored index equals one built from the symbols after every kind of commit, and searches by it agree."""
    store = RegistryStore(spark, str(tmp_path), max_rows=4, index=True)
    files, symbols, tracking = project(spark, 24)
    store.replace_all(symbols, tracking)
    before = store.manifest()

    def agrees():
        syms, grams, counts = store.search_index()
        want = gram_index(syms)
        assert sorted(map(tuple, grams.collect())) == sorted(map(tuple, want.collect()))
        assert dict(map(tuple, counts.collect())) == dict(map(tuple, gram_counts(want).collect()))
        asked = spark.createDataFrame([(i, t, None, None, False, True, 5) for i, t in enumerate(["f1", "F", "new", "none", "", "f2"])],
                                      "request_id int, term string, type string, file string, exact_match boolean, include_private boolean, limit int")
        got = rank_within_request(asked, syms, grams=grams, counts=counts).select("request_id", "ord", "rank").collect()
        assert got and sorted(got) == sorted(rank_within_request(asked, syms).select("request_id", "ord", "rank").collect())
        return {r.symbol for r in syms.collect()}

    assert len(agrees()) == 24
    rows = [("/p/m3.ts", NEW, 1, "export function newName() {}\nexport function other() {}\n", False), ("/p/m5.ts", NEW, 2, None, True)]
    apply_changes(spark.createDataFrame(rows, CHANGE_SCHEMA), str(tmp_path), max_rows=4, index=True)
    after = store.manifest()
    assert agrees() == {f"f{i}" for i in range(24) if i not in (3, 5)} | {"newName", "other"}
    kept = {b.grams for b in before.buckets} & {b.grams for b in after.buckets}
    assert len(kept) >= len(before.buckets) - 2  # the other buckets keep their grams
    assert not set(store.vacuum(keep=1)) & {f.split("/")[1] for f in kept if f} and len(agrees()) == 24
    store.commit(files.select("path"), spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], FILE_TRACKING))
    assert [t.count() for t in store.search_index()] == [0, 0, 0]


def test_a_search_refuses_an_index_that_is_not_the_symbols(spark, tmp_path):
    RegistryStore(spark, str(tmp_path), index=True).replace_all(*project(spark, 6)[1:])
    plain = RegistryStore(spark, str(tmp_path))
    _, symbols, tracking = project(spark, 2)
    plain.commit(tracking.select("path"), symbols, tracking)
    with pytest.raises(ValueError, match="without an index"):
        plain.search_index()
