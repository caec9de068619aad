"""Work that must not be done twice, in one task or held as a whole."""

import json

from pyarrow import fs as pafs
from pyspark.sql import functions as F

from symdex.functions.source_text import PY_TOKEN, TS_TOKEN, fold, unfold
from symdex.operators import declarations as DCL
from symdex.operators import requests as RQ
from symdex.operators import retired as Y
from symdex.plans import catalog
from symdex.sources import files as SF

JS = "import a from 'react';\n/** Doc */\nfunction View(p) {\n  useState(0);\n  return <div/>;\n}\nclass Box extends Component {\n  render() {}\n}\n"


def _scans(df, token):
    """How often the optimized plan looks for a token."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(token.replace("\n", "\\n")[:40])


def test_a_text_is_searched_for_tokens_twice_only(spark):
    files = spark.createDataFrame([("/a.jsx", JS)], "path string, content string").repartition(1)
    own = _scans(files.select(fold(F.col("content"), TS_TOKEN).alias("f")), TS_TOKEN)
    assert own == 2
    assert _scans(Y.components(files), TS_TOKEN) == own
    assert _scans(DCL.find_declarations(files, "View"), TS_TOKEN) == own


def test_folding_keeps_every_character(spark):
    rows = [(JS,), ("x = 'a' // b\n  /* c */ d = /[/'\"]/g / 2;",), ("r'a' # b\n\"\"\"c\n\"\"\"",), ("",), (None,)]
    df = spark.createDataFrame(rows, "c string")
    for token in (TS_TOKEN, PY_TOKEN):
        assert [r[0] for r in df.select(unfold(fold(F.col("c"), token))).collect()] == [r[0] for r in rows]


def test_components_keep_kinds_and_places(spark):
    files = spark.createDataFrame([("/a.jsx", JS), ("/b.js", JS.replace("react", "vue"))], "path string, content string")
    got = sorted((r.file, r.pos, r.name, r.kind, r.hooks) for r in Y.components(files).collect())
    assert got == [("/a.jsx", 0, "Box", "class", []), ("/a.jsx", 0, "View", "function", ["useState"])]


def test_files_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(catalog, "FILES_PER_TASK", 10)
    files = spark.createDataFrame([(f"/{i}.js", "") for i in range(200)], "path string, content string").coalesce(1)
    assert catalog.dealt(files).rdd.getNumPartitions() == 20


def test_retired_keys_read_by_many_tasks(spark):
    from symdex.plans import checks_retired

    assert checks_retired._js(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_large_folder_is_listed_in_pieces(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i}.py").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    found = SF._entries_of(pafs.LocalFileSystem(), str(tmp_path))
    assert iter(found) is found  # not a list of the whole folder
    assert sorted((p.rsplit("/", 1)[1], f) for p, f, _, _ in found) == sorted([(f"f{i}.py", True) for i in range(30)] + [("sub", False)])
    listed = SF.scan_source_files(spark, str(tmp_path), patterns=["**/*.py"], with_content=False)
    assert listed.count() == 30 and listed.agg(F.sum("length")).first()[0] == 30


def test_error_lines_with_their_count(spark):
    requests = spark.createDataFrame([("a", '{"tool": broken')], "request_id string, line string")
    symbols = spark.createDataFrame([], "ord long, symbol string, type string, file string, description string, signature string, exported boolean, "
                                        "parent_symbol string, metadata struct<is_component:boolean,visibility:string,route_method:string,route_path:string,handler:string>")
    answers = RQ.dispatch_requests(requests, symbols).where(F.col("error") == "Invalid JSON")
    assert json.loads(RQ.emit_responses(answers, counts=True).first().json)["resultCount"] == 0
    assert "resultCount" not in json.loads(RQ.emit_responses(answers).first().json)
