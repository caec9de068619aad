"""Corner cases of depth, order, escaping and storage."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from symdex.functions.source_text import split_top_level
from symdex.operators import file_docs as FD
from symdex.operators import registry as G
from symdex.operators.requests import dispatch_requests, summarised
from symdex.operators.search import rank_within_request
from symdex.operators.usages import usage_scan, usage_scan_batch
from symdex.schemas import SYMBOLS
from symdex.sources import tables as TB


def _docs(spark, *files):
    rows = FD.flatten_file_docs(FD.file_docs(spark.createDataFrame(list(files), "path string, content string"))).collect()
    return {(r.file, r.symbol): r for r in rows}


def test_split_at_any_depth(spark):
    cases = {
        "a, b": ["a", " b"], "": [""], "a: Dict[str, List[Tuple[int, int]]], b": ["a: Dict[str, List[Tuple[int, int]]]", " b"],
        "m: Map<string, Array<Map<a, b>>>, n": ["m: Map<string, Array<Map<a, b>>>", " n"],
        "f: (x: number, y: () => void) => Promise<[a, b]>, g": ["f: (x: number, y: () => void) => Promise<[a, b]>", " g"],
        "a=((((1, 2), 3), 4), 5), b=-1": ["a=((((1, 2), 3), 4), 5)", " b=-1"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.p for r in df.select("t", split_top_level(F.col("t")).alias("p")).collect()} == cases


def test_deep_brackets(spark):
    py = "def deep(a=(1, (2, (3, (4, (5,))))), b=2):\n    return a\n\ndef typed(a: Dict[str, List[int]], b):\n    return b\n"
    ts = "export function many(m: Map<string, Array<Map<string, number[]>>>, n: (x: () => void) => void): () => void {\n  return x;\n}\n"
    found = _docs(spark, ("/p/a.py", py), ("/p/a.ts", ts))
    assert found["/p/a.py", "deep"].signature.startswith("(a, b)")
    assert found["/p/a.py", "typed"].signature.startswith("(a, b)")
    assert "m, n" in found["/p/a.ts", "many"].signature


def test_docstrings_with_carriage_returns(spark):
    found = _docs(spark, ("/p/a.py", 'def f(a):\r\n    """What it does."""\r\n    return a\r\n'))
    assert found["/p/a.py", "f"].description == "What it does."


def test_two_routes_on_a_line(spark):
    found = _docs(spark, ("/p/r.ts", "router.get('/a', h1); router.post('/b', h2);\n"))
    assert {s for _, s in found} >= {"GET /a", "POST /b"}


def test_columns_of_a_path_listed_twice(spark):
    files = spark.createDataFrame([("/p/a.ts", 1, "add add"), ("/p/a.ts", 2, "add add")], "path string, pattern_idx int, content string")
    names = spark.createDataFrame([("add",)], "name string")
    assert sorted(r.column for r in usage_scan(files, "add").collect()) == [1, 1, 5, 5]
    assert sorted(r.column for r in usage_scan_batch(files, names).collect()) == [1, 1, 5, 5]


def test_names_with_pattern_characters(spark):
    files = spark.createDataFrame([("/p/a.ts", "x a\\E.b y\nGET /a(b)? z\n")], "path string, content string")
    names = spark.createDataFrame([("a\\E.b",), ("GET /a(b)?",), ("a.E.b",)], "name string")
    got = {(r.name, r.line) for r in usage_scan_batch(files, names).collect()}
    assert ("a\\E.b", 1) in got and not any(n == "a.E.b" for n, _ in got)


def _symbols(spark, names):
    rows = [(i, n, "function", "/p/a.ts", None, None, None, None, None) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, SYMBOLS)


def test_search_of_a_term_whose_lower_case_is_longer(spark):
    requests = spark.createDataFrame([("r", "\u0130", None, None, False, True, 5)], "request_id string, term string, type string, file string, exact_match boolean, include_private boolean, limit int")
    assert [r.symbol for r in rank_within_request(requests, _symbols(spark, ["x\u0130y", "z"])).collect()] == ["x\u0130y"]


def test_first_symbol_without_a_limit_is_the_best(spark):
    requests = spark.createDataFrame([("r", '{"tool": "search_project_symbols", "input": {"query": "add", "limit": 0}}')], "request_id string, line string")
    rows = summarised(dispatch_requests(requests, _symbols(spark, ["badd", "xadd9", "add"]))).collect()
    assert [(r.first_symbol, r.result_count) for r in rows] == [("add", 3)]


def test_refresh_extracts_and_moves_to_the_end(spark):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    files = spark.createDataFrame([("/p/a.py", "def first():\n    pass\n\ndef second():\n    pass\n"), ("/p/b.py", "def kept():\n    pass\n")], "path string, content string")
    symbols = FD.extract_symbols(files.where("path = '/p/a.py'").withColumn("content", F.lit("def gone():\n    pass\n"))).unionByName(FD.extract_symbols(files.where("path = '/p/b.py'"), 5))
    tracking = spark.createDataFrame([("/p/a.py", old, old, True), ("/p/b.py", new, new, True)], TB.FILE_TRACKING)
    listing = spark.createDataFrame([("/p/a.py", new), ("/p/b.py", old)], "path string, mtime timestamp")
    out, tracked, summary = G.refresh_registry(symbols, tracking, listing, FD.extract_symbols, new, files=files)
    rows = out.orderBy("ord").collect()
    assert [r.symbol for r in rows] == ["kept", "first", "second"]
    assert len({r.ord for r in rows}) == 3
    assert summary.first().files_processed == 1
    assert tracked.where("path = '/p/a.py'").first().last_parsed == new


def test_order_of_registration_does_not_depend_on_partitions(spark):
    files = spark.createDataFrame([(f"/p/f{i:03}.py", f"def one{i}():\n    pass\n\ndef two{i}():\n    pass\n") for i in range(40)], "path string, content string")
    orders = [[r.symbol for r in FD.extract_symbols(files.repartition(n)).orderBy("ord").collect()] for n in (1, 7)]
    assert orders[0] == orders[1] == [f"{w}{i}" for i in range(40) for w in ("one", "two")]


def test_only_a_missing_registry_is_empty(spark, tmp_path):
    assert [t.count() for t in TB.load_registry(spark, str(tmp_path / "none"))] == [0, 0]
    broken = tmp_path / "t"
    TB.persist_registry(_symbols(spark, ["a"]), spark.createDataFrame([], TB.FILE_TRACKING), str(broken))
    assert [t.count() for t in TB.load_registry(spark, str(broken))] == [1, 0]
    for part in (broken / "data").rglob("*.parquet"):
        part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
        part.write_bytes(b"no parquet")
    with pytest.raises(Exception):
        TB.load_registry(spark, str(broken))[0].collect()


def test_json_registry(spark, tmp_path):
    import json

    state = {
        "symbols": [
            {"symbol": "f", "type": "function", "file": "/p/a.ts", "exported": True, "metadata": {"visibility": "public"}},
            {"symbol": "GET /x", "type": "route", "file": "/p/r.ts", "metadata": {"method": "GET", "path": "/x", "handler": "h"}},
        ],
        "files": [{"path": "/p/a.ts", "lastParsed": 1704067200000.0, "lastModified": 1704067200000.0, "exists": True}],
        "lastFullRefresh": 1704067200000.0,
    }
    (tmp_path / "state.json").write_text(json.dumps(state, indent=1))
    symbols, tracking = TB.load_registry_json(spark, str(tmp_path / "state.json"))
    rows = symbols.orderBy("ord").collect()
    assert [(r.ord, r.symbol, r.exported) for r in rows] == [(0, "f", True), (1, "GET /x", None)]
    assert (rows[0].metadata.visibility, rows[1].metadata.route_path, rows[1].metadata.handler) == ("public", "/x", "h")
    assert tracking.first().last_parsed == dt.datetime(2024, 1, 1)
    (tmp_path / "broken.json").write_text("{ not json")
    symbols, tracking = TB.load_registry_json(spark, str(tmp_path / "broken.json"))
    assert symbols.count() == 0 and tracking.count() == 0


def test_streamed_batches_number_symbols_uniquely(spark, tmp_path):
    from symdex.streaming.changes import CHANGE_SCHEMA, apply_changes, read_state

    def batch(day, **files):
        rows = [(f"/p/{n}.py", dt.datetime(2024, 1, day), 1, c, False) for n, c in files.items()]
        return spark.createDataFrame(rows, CHANGE_SCHEMA)

    state, one = str(tmp_path / "state"), "def {0}1():\n    pass\n\ndef {0}2():\n    pass\n"
    apply_changes(batch(1, a=one.format("a"), b=one.format("b")), state, max_rows=3)
    apply_changes(batch(2, a=one.format("n")), state, max_rows=3)
    apply_changes(batch(2, a=one.format("late")), state, max_rows=3)
    rows = read_state(spark, state)[0].orderBy("ord").collect()
    assert [r.symbol for r in rows] == ["b1", "b2", "n1", "n2"]
    assert len({r.ord for r in rows}) == 4
