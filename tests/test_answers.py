"""Answers in parts, batches without a tool, and the token index against a plain search."""

import json
import random
import re

from pyspark.sql import functions as F

from symdex.operators import answers as A
from symdex.operators import registry as G
from symdex.operators import requests as RQ
from symdex.operators import token_index as TI
from symdex.operators.file_docs import extract_symbols
from symdex.operators.search import matches, with_spec
from symdex.operators.usages import usage_scan_batch, with_listing_order

SRC = "/** Adds */\nexport function add(a, b) {\n  return a + b;\n}\nclass Box {\n  put() {}\n  take() {}\n}\n"


def ask(spark, requests, files):
    df = spark.createDataFrame([(str(i), json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(requests)], "request_id string, line string")
    docs = spark.createDataFrame(files, "path string, content string")
    symbols = extract_symbols(docs.where("content is not null")).checkpoint()
    out = RQ.emit_responses(RQ.dispatch_requests(df, symbols, files=docs, listing=docs.select("path", F.current_timestamp().alias("mtime")))).collect()
    return {int(r.request_id): json.loads(r.json) for r in out if r.part == 0}


def test_all_tools_and_errors(spark):
    files = [("/p/a.js", SRC), ("/p/b.ts", "import { add } from './a';\nadd(1); add(2);\n"), ("/p/c.md", "# no"), ("/p/broken.py", None)]
    asked = [
        {"tool": "search_project_symbols", "input": {"query": "add"}}, {"tool": "get_doc_for_symbol", "input": {"symbol": "Box"}},
        {"tool": "find_usages", "input": {"symbol": "add", "maxResults": 2}}, {"tool": "get_doc_for_file", "input": {"file": "/p/c.md"}},
        {"tool": "get_doc_for_file", "input": {"file": "/p/broken.py"}}, {"tool": "refresh_registry", "input": {"fullScan": True}},
        {"tool": "find_usages", "input": {"symbol": ""}}, {"tool": "nope", "input": {}}, "{", {"tool": "autocomplete_symbol", "input": {"prefix": "t", "limit": -1}},
    ]
    got = ask(spark, asked, files)
    assert got[0] == {"results": [{"symbol": "add", "type": "function", "file": "/p/a.js", "description": "Adds", "signature": "(a, b)", "exported": True}]}
    assert got[1]["found"] and [r["symbol"] for r in got[1]["symbol"]["relatedSymbols"]] == ["put", "take"] and got[1]["symbol"]["metadata"] == {"isComponent": False}
    assert [(u["file"], u["line"], u["column"], u["isDefinition"]) for u in got[2]["usages"]] == [("/p/a.js", 2, 17, True), ("/p/b.ts", 1, 10, False)]
    assert (got[2]["totalFound"], got[2]["limitReached"]) == (3, True)
    assert got[3] == {"error": "Unsupported file type", "details": "No parser available for file type: .md"}
    assert got[4]["error"] == "Parsing error"
    assert got[5] == {"refreshed": True, "filesProcessed": 2, "filesRemoved": 0, "symbols": 4}
    assert got[6] == {"symbol": "", "type": "", "usages": [], "totalFound": 0, "limitReached": False}
    assert got[7] == {"error": "Unknown tool", "details": 'Tool "nope" not supported'} and got[8]["error"] == "Invalid JSON"
    assert [c["symbol"] for c in got[9]["completions"]] == ["put", "take"]


def test_lists_without_a_limit_come_in_ordered_parts(spark, monkeypatch):
    monkeypatch.setattr(A, "PART", 8)
    rows = spark.range(100).select(F.lit("k").alias("key"), (F.col("id") % 3).cast("int").alias("c"), (F.col("id") * 7 % 100).alias("ord"), F.col("id").alias("record"))
    parts = A.in_parts(rows.repartition(5), "key", ["c"]).orderBy("part").collect()
    assert [p.part for p in parts] == list(range(len(parts))) and len(parts) > 4
    assert all(len(p.records) <= 16 for p in parts)
    want = sorted(range(100), key=lambda i: (i % 3, i * 7 % 100))
    assert [x for p in parts for x in p.records] == want


def test_no_shuffle_carries_a_list_for_every_request(spark):
    """40 requests for one list of 300 symbols, and one without a hit: lists are shuffled in a few copies, never request by request."""
    symbols = extract_symbols(spark.createDataFrame([("/p/a.ts", "".join(f"export function f{i}() {{}}\n" for i in range(300)))], "path string, content string")).checkpoint()
    asked = spark.createDataFrame(
        [(f"r{i}", "search_project_symbols", "f", 0) for i in range(40)] + [("r40", "search_project_symbols", "none", 0), ("r41", "search_project_symbols", None, 0), (None, "search_project_symbols", "f", 0)],
        "request_id string, tool string, query string, limit int").selectExpr(
        "*", "cast(null as string) as type", "cast(null as string) as file", "false as exact_match", "false as include_private")
    answers = RQ._search_answers(asked, RQ._lists(RQ._search_terms(asked), symbols, None, None))
    found = {r.request_id: [x.symbol for x in r.results] for r in answers.collect()}
    assert len(found) == 43 and all(found[f"r{i}"] == [f"f{n}" for n in range(300)] for i in range(40))
    assert found["r40"] == found["r41"] == found[None] == []
    # from the last join on, nothing is exchanged
    plan = answers._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1:
        plan = plan.children().head()
    assert plan.getClass().getSimpleName() == "Join" and "_salt" in plan.condition().get().toString()


def test_token_index_against_a_plain_search(spark):
    rng = random.Random(2)
    words = ["load", "x", "a$b", "$", "GET", "/s/1", "/s/12", "GET /s/1", "é", "日本", "a日本b", "foo_bar", "a.b", ".", "+", "n+1", "12", "()"]
    files = [(f"/p/f{i}.{rng.choice(['ts', 'js'])}", "\n".join("".join(rng.choice(words) + rng.choice([" ", "", ", "]) for _ in range(rng.randint(0, 9))) for _ in range(12))) for i in range(25)]
    files += files[:3]
    names = [*words, "GET /s/12", "b", "nowhere", "load x", "$b", "a$"]
    df = with_listing_order(spark.createDataFrame(files, "path string, content string")).repartition(3)
    got = usage_scan_batch(df, spark.createDataFrame([(n,) for n in [*names, "", " "]], "name string")).collect()
    want = []
    for path, text in files:
        lines = text.split("\n")
        for i, line in enumerate(lines):
            for n in names:
                for m in re.finditer(r"\b" + re.escape(n) + r"\b", line, re.ASCII):
                    want.append((n, path, 1 if path.endswith("ts") else 3, i + 1, "\\n".join(lines[max(i - 1, 0):i + 2]), m.start() + 1))
    assert sorted(map(tuple, got)) == sorted(want) and len({w[0] for w in want}) > 10


def test_routes_of_one_verb_meet_only_their_lines(spark):
    """3 000 routes of one verb over 2 000 lines: the verb is no key, so no line meets every route."""
    files = with_listing_order(spark.createDataFrame([("/p/r.ts", "\n".join(f"app.get('GET /x{i}')" for i in range(2000)))], "path string, content string"))
    names = spark.range(3000).select(F.concat(F.lit("GET /x"), F.col("id").cast("string")).alias("name"))
    index = TI.token_lines(files)
    keyed = TI.keyed_names(names, TI.token_counts(index))
    assert keyed.where(F.col("token") == "GET").count() == 0
    assert index.join(keyed, "token").count() == 2000 == usage_scan_batch(files, names).count()


def test_scan_patterns_of_columns_are_those_of_the_listing(spark):
    patterns = ["**/*.ts", "**/*.{ts,tsx}", "src/**", "src/**/x*.js", "*.py", "a?c/*.ts", "**", "**/.git/*", "x(1).ts", "{a,b}/**/*.js"]
    paths = ["a.ts", "x/_a.ts", ".a.ts", "x/.h/a.ts", "a.tsx", "src/a", "src/.a", "src/b/xq.js", "z.py", "q/z.py", "abc/t.ts", ".git/k", "u/.git/k", "x(1).ts", "__tests__/a.ts", "b/r/q.js"]
    df = spark.createDataFrame([(p, q) for p in patterns for q in paths], "p string, q string")
    for r in df.select("p", "q", F.regexp_like("q", G.glob_to_regex_col(F.col("p"))).alias("m")).collect():
        assert r.m == bool(re.match(G.glob_to_regex(r.p), r.q)), (r.p, r.q)
    assert re.match(G.glob_to_regex("**/*.ts"), "__tests__/_a.ts") and not re.match(G.glob_to_regex("**/*.ts"), "x/.h/a.ts")


def test_emit_responses_answers_every_request(spark, tmp_path):
    """One line for every request of the view, not for the broken ones only."""
    from symdex.plans import catalog

    catalog.load_all()
    turns = {4: "results", 5: "completions", 6: "found", 8: "error", 10: "error", 14: "usages", 15: "refreshed", 16: "error"}
    tables = {
        "conversations": ([(3, t, "user") for t in turns], "conv_id long, turn int, role string"),
        "part": ([(1, "old rod", 2, "Brand#1", "SMALL"), (8, "old rod", 2, "Brand#1", "SMALL")], "p_partkey long, p_name string, p_size int, p_brand string, p_type string"),
        "events": ([], "event_id long, user_id long, event_type string, ts timestamp"),
        "documents": ([(1, "web", "en", "see old_rod", 11)], "doc_id long, source string, lang string, text string, n_chars int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = catalog.QUERIES["emit_responses"](spark, str(tmp_path)).collect()
    got = {int(r.request_id.split("-")[1]): json.loads(r.json) for r in rows}
    assert len(rows) == len(turns) and all(next(iter(got[t])) == key or key in got[t] for t, key in turns.items())
    assert [r["type"] for r in got[4]["results"]] == ["function"] and [u["file"] for u in got[14]["usages"]] == ["/corpus/web/1.ts"]
    assert got[10] == {"error": "Unknown tool", "details": 'Tool "nope" not supported', "resultCount": 0} and got[15]["symbols"] == 2


def test_answers_are_made_before_they_are_handed_out(spark):
    """The plan of all tools ranks nothing itself, and a batch spells out only the grams it asks for, which are not broadcast."""
    files = spark.createDataFrame([("/p/a.js", SRC)], "path string, content string")
    symbols = extract_symbols(files).checkpoint()
    asked = spark.createDataFrame([("a", '{"tool":"get_doc_for_symbol","input":{"symbol":"Box"}}'), ("b", '{"tool":"find_usages","input":{"symbol":"add"}}'),
                                   ("b", '{"tool":"find_usages","input":{"symbol":"add"}}'), ("c", '{"tool":"autocomplete_symbol","input":{"prefix":"a"}}')], "request_id string, line string")
    answers = RQ.dispatch_requests(asked, symbols, files=files, listing=files.select("path", F.current_timestamp().alias("mtime")))
    assert "Window" not in answers._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.request_id for r in answers.collect()) == ["a", "b", "b", "b", "b", "c"]  # an id that is given twice meets both answers
    terms = with_spec(asked.selectExpr("'ad' as term", "cast(null as string) as type", "cast(null as string) as file", "false as exact_match", "false as include_private", "5 as limit"))
    found = matches(terms, symbols)
    assert [r.symbol for r in found.collect()] == ["add"] and "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_long_lists_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(A, "RECORDS_APART", 50)
    lists = spark.createDataFrame([("s", 0, list(range(19))), ("t", 0, [1])], "spec string, part int, records array<int>").checkpoint()
    asked = spark.createDataFrame([(f"r{i}", "s") for i in range(40)] + [("q", "t"), ("n", "none"), (None, "s")], "request_id string, spec string")
    out = A.handed_out(asked, lists).withColumn("task", F.spark_partition_id()).collect()
    assert len(out) == 43 and all(len(r.records) == 19 for r in out if r.spec == "s") and [r.records for r in out if r.spec != "s"] in ([[1], None], [None, [1]])
    assert len({r.task for r in out}) > 6 and max(sum(len(r.records or []) for r in out if r.task == t) for t in {r.task for r in out}) < 400
