"""What keeps the check views and the store from growing with their tables: who renders, and how many folders a commit makes."""

import datetime as dt

from pyspark.sql import functions as F

from symdex.operators import answers as A
from symdex.operators.file_docs import extract_symbols
from symdex.operators.search import gram_index, grams_asked, rank_within_request
from symdex.plans import catalog
from symdex.plans.catalog import source_files
from symdex.schemas import FILE_TRACKING
from symdex.sources.store import RegistryStore

SF = "/root/testdata/sf0.001"
OLD = dt.datetime(2024, 1, 1)


def test_files_are_rendered_by_the_tasks_they_are_dealt_to(spark):
    plan = source_files(spark, SF, "code_js")._jdf.queryExecution().optimizedPlan()
    assert plan.getClass().getSimpleName() == "Project"  # the contents; the shuffle below carries base rows
    assert "Repartition" in plan.children().head().getClass().getSimpleName()


def test_a_commit_makes_one_folder_a_table_however_many_buckets(spark, tmp_path):
    files = spark.createDataFrame([(f"/p/m{i}.ts", f"export function f{i}() {{}}\n") for i in range(60)], "path string, content string")
    tracking = files.select("path", F.lit(OLD).alias("last_parsed"), F.lit(OLD).alias("last_modified"), F.lit(True).alias("exists"))
    store = RegistryStore(spark, str(tmp_path), max_rows=4, index=True)
    store.replace_all(extract_symbols(files), tracking)
    first = store.manifest()
    assert len(first.buckets) == 16
    assert len(list(tmp_path.glob("data/*/*"))) == 4 and not list(tmp_path.glob("data/*/*/*/"))
    # a commit of one file: the other buckets are read from where they were
    gone = spark.createDataFrame([("/p/m7.ts",)], "path string").checkpoint()
    store.commit(gone, store.load()[0].limit(0), spark.createDataFrame([], FILE_TRACKING))
    symbols, tracked = store.load()
    want = sorted(f"f{i}" for i in range(60) if i != 7)
    assert sorted(r.symbol for r in symbols.collect()) == want and tracked.count() == 59
    named, grams, counts = store.search_index()
    assert sorted(r.symbol for r in grams.where("gram = 'f'").collect()) == want
    assert counts.where("gram = 'f'").first().n == 59


def test_folders_of_one_bucket_each_are_still_read(spark, tmp_path):
    """A store written before buckets shared folders."""
    files = spark.createDataFrame([("/p/a.ts", "export function a() {}\n")], "path string, content string")
    extract_symbols(files).write.parquet(f"{tmp_path}/data/v1-x/symbols/bucket=0")
    store = RegistryStore(spark, str(tmp_path))
    assert [r.symbol for r in store._rows("symbols", ["data/v1-x/symbols/bucket=0"]).collect()] == ["a"]


def test_small_sides_of_answers_are_not_broadcast(spark):
    symbols = extract_symbols(spark.createDataFrame([("/p/a.ts", "export class A {\n  run(): void {}\n}\n")], "path string, content string"))
    found = A.members(symbols.checkpoint(), spark.createDataFrame([("A",)], "owner string"))
    assert [r.records[0].symbol for r in found.collect()] == ["run"]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_only_the_grams_that_a_batch_asks_for_are_kept(spark):
    files = spark.createDataFrame([(f"/p/m{i}.ts", f"export function alpha{i}() {{}}\nexport function omega{i}() {{}}\n") for i in range(8)], "path string, content string")
    symbols = extract_symbols(files).withColumn("ord", F.monotonically_increasing_id()).checkpoint()
    requests = spark.createDataFrame(
        [("a", "Alpha", 0), ("b", "ga3", 5), ("c", "nowhere", 5), ("d", "", 5), ("e", None, 5), ("f", "al", 2)], "request_id string, term string, limit long").selectExpr(
        "request_id", "term", "cast(null as string) as type", "cast(null as string) as file", "false as exact_match", "false as include_private", "limit")
    kept = {r.gram for r in grams_asked(requests.where("term <> ''"), symbols).select("gram").distinct().collect()}
    assert kept == {"alp", "lph", "pha", "ga3", "al"}
    rows = lambda df: sorted((r.request_id, r.symbol, r["rank"] or 0) for r in df.collect())
    found = rows(rank_within_request(requests, symbols))
    assert found == rows(rank_within_request(requests, symbols, grams=gram_index(symbols)))
    assert [r[:2] for r in found if r[0] in "bcde"] == [("b", "omega3")] and len(found) == 8 + 1 + 2


def test_names_are_spelled_out_by_the_tasks_they_are_dealt_to(spark):
    catalog.load_all()
    plan = catalog.QUERIES["rank_within_request"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
