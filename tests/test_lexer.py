"""Regex literals, templates and exports that come after their declaration."""

from __future__ import annotations

import pytest

from symdex.operators import declarations as D
from symdex.operators import file_docs as FD
from symdex.operators import retired as Y


def _rows(spark, path, content):
    df = spark.createDataFrame([(path, content)], "path string, content string")
    return [r.asDict() for r in FD.flatten_file_docs(FD.file_docs(df)).orderBy("seq").collect()]


@pytest.mark.parametrize("line", [
    "const re = /\"/;", "x = s.replace(/'/g, y)", "if (!/[/\"`]/.test(s)) f()", "const f = x => /`{/u.exec(x)", "function q(a) { return /\\/\"(/ }",
    "const n = total / 2; const m = (a + b) / c / d;", "const el = <br />;", "t = cond ? /'/ : /\"/", "a =\n  /\"/;", "// it's", "const u = \"http://x/y\";",
])
def test_code_after_a_regex_literal_is_read(spark, line):
    rows = _rows(spark, "/p/a.js", line + '\napp.get("/q", h);\nexport function last() {\n  return 1;\n}\n')
    assert [r["symbol"] for r in rows if r["type"] == "route"] == ["GET /q"]
    assert [r["symbol"] for r in rows if r["type"] == "function" and r["symbol"] != "q"] == ["last"]


@pytest.mark.parametrize(("tail", "routes"), [
    ("export default handler;", ["ANY /x"]), ("export { handler };", ["ANY /x"]), ("export { a, handler as default };", ["ANY /x"]),
    ("export { other as handler };", []), ("export { handler } from './h';", []), ("", []), ("// export default handler;", []),
])
def test_handlers_exported_by_name(spark, tail, routes):
    rows = _rows(spark, "/p/pages/api/x.ts", "async function handler(req, res) {\n  res.end();\n}\n" + tail + "\n")
    assert [r["symbol"] for r in rows if r["type"] == "route"] == routes
    assert [r["exported"] for r in rows if r["type"] == "function"] == [bool(routes)]


def test_default_handler_routes(spark):
    files = [("/pages/api/a.js", "export default async function handler(q) {\n}\n"), ("/pages/api/b.js", "function handler(q) {\n}\nexport default handler;\n"),
             ("/pages/api/c.js", "function handler(q) {\n}\nexport { handler };\n"), ("/pages/api/d.js", "const re = /'/;\nfunction handler(q) {\n}\nexport { handler as default };\n")]
    rows = Y.default_handler_routes(spark.createDataFrame(files, "path string, content string")).collect()
    assert sorted(r.route_path for r in rows) == ["/a", "/b", "/d"]


def test_declarations_within_a_line_and_references_in_templates(spark):
    text = "if (a) { const total = 1; }\nfor (let total of xs) { }\nconst m = `total ${total + f(\"total\")} ${{a: total}.a} \\${total}`;\nx(); function total() { }\nfoo(total);\n"
    files = spark.createDataFrame([("/p/a.ts", text)], "path string, content string")
    found = D.find_declarations(files, "total")
    assert sorted((r.line, r.column, r.kind) for r in found.collect()) == [(1, 16, "variable"), (2, 10, "variable"), (4, 6, "function")]
    refs = D.find_references(files, "total", found).collect()
    line = text.split("\n")[2]
    at = [line.index("${total") + 3, line.index("a: total") + 4]
    assert sorted((r.line, r.column) for r in refs) == [(3, at[0]), (3, at[1]), (4, 15), (5, 5)]  # a function starts before its name
