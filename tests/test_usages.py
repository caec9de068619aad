"""find_usages on a small corpus of our own, shaped like the reference's snapshot case."""

from pyspark.sql import functions as F

from symdex.operators.file_docs import extract_symbols
from symdex.operators.usages import find_usages

JS = "\n".join([
    "/**",
    " * Header of the file",
    " * @module sample",
    " */",
    "",
    "/**",
    " * Adds two numbers",
    " * @param {number} a",
    " * @param {number} b",
    " * @returns {number} the sum",
    " */",
    "function add(a, b) {",
    "  return a + b;",
    "}",
    "module.exports = { add };",
    "",
])
TS = "import { add } from './a';\nconst total = add(1, 2) + add(3, 4);\n// add in a comment still counts as text\n"


def test_definition_and_usages(spark):
    files = spark.createDataFrame([("/p/src/a.js", JS), ("/p/src/b.ts", TS), ("/p/src/c.py", "add = 1\n")],
                                  "path string, content string")
    symbols = extract_symbols(files)
    add = symbols.where(F.col("symbol") == "add").first()
    assert add["signature"] == "(a, b): number" and add["exported"]
    assert add["description"] == "Header of the file"  # the first doc block of the run (Q12)
    rows, totals = find_usages(files, symbols, "add", "function")
    got = [(r["file"], r["line"], r["column"], r["is_definition"]) for r in rows.orderBy("usage_rank").collect()]
    # definition first (line 12, column 10), the definition file is skipped afterwards (Q7), .py is not listed (Q27)
    assert got[0] == ("/p/src/a.js", 12, 10, True)
    assert got[1:] == [("/p/src/b.ts", 1, 10, False), ("/p/src/b.ts", 2, 15, False),
                       ("/p/src/b.ts", 2, 27, False), ("/p/src/b.ts", 3, 4, False)]
    snip = rows.orderBy("usage_rank").first()["snippet"]
    assert snip == " */\\nfunction add(a, b) {\\n  return a + b;"  # joined by a backslash and n (Q8)
    t = totals.first()
    assert (t["total_found"], t["limit_reached"], t["true_total"]) == (5, False, 5)


def test_limit_and_unknown(spark):
    # one definition row (line 1 matches, the scan goes on and finds nothing else: Q5), three usages elsewhere
    files = spark.createDataFrame([("/p/a.ts", "function f() {}\n"), ("/p/b.ts", "f(); f(); f();\n")],
                                  "path string, content string")
    symbols = extract_symbols(files)
    rows, totals = find_usages(files, symbols, "f", max_results=2)
    assert rows.count() == 2  # the definition row and one usage
    t = totals.first()
    assert (t["total_found"], t["limit_reached"], t["true_total"]) == (3, True, 4)  # capped one above the limit (Q6)
    rows, totals = find_usages(files, symbols, "nothing_here", "method")
    assert rows.count() == 0 and totals.first()["type"] == "method"
