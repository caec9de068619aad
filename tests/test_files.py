"""Scans of a folder by the ways its root can be written."""

import pytest

from symdex.sources import files as SF


def test_scan_of_a_root_with_a_scheme(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("let a")
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}", f"file://{tmp_path}/"):
        rows = SF.scan_source_files(spark, root, ["**/*.ts"]).collect()
        assert [(r.path, r.content) for r in rows] == [(f"{tmp_path}/src/a.ts", "let a")], root


def test_scan_of_a_root_that_matches_nothing_fails(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("let a")
    with pytest.raises(Exception, match="not below it"):
        SF.scan_source_files(spark, f"{tmp_path}/s*", ["**/*.ts"], with_content=False).collect()


def test_hidden_names_of_a_corpus(spark, tmp_path):
    for name in ("pkg/__init__.py", "pkg/m.py", "__tests__/a.ts", "_app.tsx", "index.tsx", ".git/x.ts", "pkg/.h.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = SF.scan_source_files(spark, str(tmp_path), ["**/*.py", "**/*.ts", "**/*.tsx"]).collect()
    assert {(r.path[len(str(tmp_path)) + 1 :], r.content) for r in rows} == {(n, n) for n in ("pkg/__init__.py", "pkg/m.py", "__tests__/a.ts", "_app.tsx", "index.tsx")}
    assert all(r.length == len(r.content) and r.mtime is not None for r in rows)


def test_folders_dealt_out_at_every_depth(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SF, "FOLDERS", 4)
    want = {f"d{i}/e{j}/f{k}.ts" for i in range(3) for j in range(3) for k in range(2)} | {"top.ts", "d0/mid.ts"}
    for name in want:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = SF.scan_source_files(spark, str(tmp_path), ["**/*.ts"], with_content=False).collect()
    assert sorted(r.path[len(str(tmp_path)) + 1 :] for r in rows) == sorted(want)
