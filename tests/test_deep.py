"""Headers whose brackets nest deeper than any pattern can count."""

import pytest

from symdex.operators import file_docs as FD


def deep(n, opening="(", closing=")"):
    return opening * n + "1" + closing * n


PY = f"""def deep(a={deep(40)}, b=2) -> int:
    return 1

class K(Base({deep(20)})):
    def m(self, x={deep(30)}, y=1):
        return {deep(20)}
    def n(self, z):
        pass

@app.get('/x', dep={deep(25)})
def h(q):
    pass
"""
TS = f"""export function deep<T extends {'A<' * 20}B{'>' * 20}>(a = {deep(40)}, b: number): {'{ a: ' * 12}number{' }' * 12} {{
  return 1;
}}
export class K {{
  m(x = {deep(30)}, y: string): void {{
    f({deep(20)});
  }}
  n(z: number): void {{}}
}}
export interface I {{
  go(cb: {'(' * 20}x{')' * 20}, k: string): boolean;
}}
export type U = {'A<' * 30}string{'>' * 30};
"""


@pytest.mark.parametrize("path, content, want", [
    ("/a.py", PY, [("deep", "(a, b): int"), ("h", "(q): any"), ("K", None), ("m", "(x, y): any"), ("n", "(z): any"), ("GET /x", None)]),
    ("/a.ts", TS, [("deep", "(a, b): " + "{ a: " * 12 + "number" + " }" * 12), ("K", None), ("m", "(x, y): void"), ("n", "(z): void"), ("I", None), ("go", "(cb, k): boolean"),
                   ("U", ": " + "A<" * 30 + "string" + ">" * 30)]),
    ("/a.js", f"function plain(a = {deep(100)}, c) {{\n  return a;\n}}\n", [("plain", "(a, c)")]),
    ("/b.js", f"function big(a={deep(30)}, c) {{\n" + "".join(f"  f({deep(12)}, {i});\n" for i in range(3000)) + "}\n", [("big", "(a, c)")]),
])
def test_deep_headers(spark, path, content, want):
    rows = FD.flatten_file_docs(FD.file_docs(spark.createDataFrame([(path, content)], "path string, content string"))).orderBy("seq").collect()
    assert [(r.symbol, r.signature) for r in rows] == want
