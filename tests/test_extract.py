"""Extraction on hand-written sources (grammar corner cases of our own)."""

from pyspark.sql import functions as F

from symdex.operators import file_docs as FD

PY = '''# leading comment
"""Module doc."""

import os


def plain(a, b: int = 0, *args, c: str = "x", **kw) -> "str":
    """First line.

        indented
    """
    text = """def not_a_function():
    pass"""
    return text


async def fetch(*, key=None, /):
    return 1


@decorator
class Skipped:
    def hidden(self):
        pass


class Visible(Base):
    def __init__(self, x):
        self.x = x

    def _protected(self):
        def nested(y):
            return y
        return nested

    @property
    def __private(self):
        """Doc of private."""
        return 1


@app.route("/items", methods=["POST", "GET"])
def create(item):
    return item


@router.delete('/items/{id}')
def remove(id):
    """Remove one."""
'''

TS = '''/** Header */
import { x } from "y";

/**
 * Adds numbers.
 * @param a first
 * @returns the sum
 */
export function add(a: number, b: number): number {
  const s = "function fake() {}"; // function fake2() {}
  return a + b;
}

export default function (req, res) {}

function untyped(...rest) {
  return rest;
}

export interface Shape {
  /** Area */
  area(): number;
  readonly name: string;
}

export type Pair<T> = {
  left: T;
  right: T;
};

export class Store extends React.Component {
  /** Items */
  private items: string[] = [];
  static count = 0;

  constructor(private readonly db: Db) {
    super();
  }

  public get size(): number { return 1; }

  protected async load(id: string, opts?: Options): Promise<void> {
    router.post("/load", handler);
  }
}

app.get('/a', (req, res) => res.end());
app.put("/b", function (req, res) {});
app.patch("/c", 42);
'''


def _rows(spark, path, content):
    df = spark.createDataFrame([(path, content)], "path string, content string")
    return [r.asDict() for r in FD.flatten_file_docs(FD.file_docs(df)).orderBy("seq").collect()]


def test_python_corner_cases(spark):
    rows = _rows(spark, "/p/m.py", PY)
    got = [(r["type"], r["symbol"]) for r in rows]
    assert ("function", "plain") in got and ("function", "fetch") in got
    assert ("function", "not_a_function") not in got  # inside a string
    assert ("class", "Skipped") not in got and ("method", "hidden") not in got  # decorated class (Q10)
    methods = [r["symbol"] for r in rows if r["type"] == "method"]
    assert methods == ["__init__", "_protected", "nested", "__private"]  # any depth (Q9)
    plain = next(r for r in rows if r["symbol"] == "plain")
    assert plain["signature"] == '(a, b, args, c, kw): "str"'
    assert plain["description"] == "First line.\n\nindented"
    # a leading comment hides the module docstring, so the fallback is empty
    fetch = next(r for r in rows if r["symbol"] == "fetch")
    assert fetch["description"] == "" and fetch["signature"] == "(key): any"
    vis = {r["symbol"]: r["visibility"] for r in rows if r["type"] == "method"}
    assert vis == {"__init__": "private", "_protected": "protected", "nested": "public", "__private": "private"}
    routes = {r["symbol"]: r["description"] for r in rows if r["type"] == "route"}
    assert routes == {"POST /items": "", "DELETE /items/{id}": "Remove one."}


def test_typescript_corner_cases(spark):
    rows = _rows(spark, "/p/pages/api/index.ts", TS)
    by = {(r["type"], r["symbol"]): r for r in rows}
    add = by[("function", "add")]
    assert add["description"] == "Adds numbers."  # the header belongs to the import above
    assert add["signature"] == "(a, b): number" and add["exported"]
    assert ("function", "fake") not in by and ("function", "fake2") not in by
    assert by[("function", "<anonymous>")]["exported"]
    assert by[("function", "untyped")]["signature"] == "(rest)"
    assert by[("class", "Store")]["is_component"]
    assert ("method", "constructor") not in by and ("method", "size") not in by
    load = by[("method", "load")]
    assert load["visibility"] == "protected" and load["signature"] == "(id, opts): Promise<void>"
    items = by[("property", "items")]
    assert items["visibility"] == "private" and items["signature"] == ": string[]" and items["description"] == "Items"
    assert by[("property", "count")]["signature"] == ""
    assert by[("type", "Pair")]["signature"] == ": { left: T; right: T; }"
    assert by[("method", "area")]["parent_symbol"] == "Shape"
    routes = [r["symbol"] for r in rows if r["type"] == "route"]
    assert routes == ["POST /load", "GET /a", "PUT /b", "PATCH /c"]  # the anonymous default is no "handler"
    handlers = {r["symbol"]: r["handler"] for r in rows if r["type"] == "route"}
    assert handlers["POST /load"] == "handler" and handlers["GET /a"] == "<inline function>"
    assert handlers["PUT /b"] == "<inline function>" and handlers["PATCH /c"] == ""


def test_unsupported_file(spark):
    df = spark.createDataFrame([("/p/readme.MD", "# hi")], "path string, content string")
    r = FD.file_docs(df).first()
    assert r["error"] == "Unsupported file type" and r["details"] == "No parser available for file type: .md"
