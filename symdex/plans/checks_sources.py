"""Source / sink / plug-in keys.

A1/A2/A9 write the rendered code views to files under the session's
checkpoint folder and read them back with the ``binaryFile`` source.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from symdex.operators import file_docs as FD
from symdex.plans.catalog import dealt, register, source_files
from symdex.session import ensure_checkpoint_dir
from symdex.sources import files as SF
from symdex.sources.fixtures import load_view, with_views


def _materialize(spark, sf) -> str:
    """Write the rendered views as real files into the shared folder, through the file system that the scan reads."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    views = [load_view(spark, sf, v).select("path", "content") for v in ("code_ts", "code_js", "code_py", "code_hidden")]
    rows = views[0]
    for v in views[1:]:
        rows = rows.unionByName(v)

    def write_part(batches):
        system, top = SF.file_system(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = os.path.dirname(top + path)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(top + path) as f:
                    f.write(content.encode())
            yield batch.slice(0, 0)

    dealt(rows).mapInArrow(write_part, rows.schema).count()
    return root


def _inside(root: str) -> F.Column:
    return F.expr(f"substring(path, {len(SF.file_system(root)[1]) + 1})")


_HIDDEN_SQL = ("select path, case when ends_with(path, '.ts') then 1 else 2 end, cast(strlen(content) as bigint) from code_hidden "
               "where not contains(path, '/.') and not ends_with(path, '.py')")
_LISTING_SQL = with_views(
    "select path, 1 as pattern_idx, cast(strlen(content) as bigint) as length from code_ts "
    "union all select path, case when ends_with(path, '.jsx') then 4 else 3 end, cast(strlen(content) as bigint) "
    f"from code_js union all {_HIDDEN_SQL}", "code_ts", "code_js", "code_hidden")


@register("scan_source_files", _LISTING_SQL)
def scan_source_files(spark, sf):
    root = _materialize(spark, sf)
    listed = SF.scan_source_files(spark, root, with_content=False)
    return listed.select(_inside(root).alias("path"), "pattern_idx", "length")


@register("scan_python_files", with_views(
    "select path, content from code_py union all select path, content from code_hidden where ends_with(path, '.py')", "code_py", "code_hidden"))
def scan_python_files(spark, sf):
    """The package files ``__init__.py`` with the others, by a root with a scheme."""
    root = _materialize(spark, sf)
    uri = root if ":" in root else f"file://{root}"
    return SF.scan_source_files(spark, uri, patterns=["**/*.py"]).select(_inside(root).alias("path"), "content")


@register("read_source_text", with_views(
    "select path, content from code_ts union all select path, content from code_hidden where ends_with(path, '.ts') and not contains(path, '/.')",
    "code_ts", "code_hidden"))
def read_source_text(spark, sf):
    root = _materialize(spark, sf)
    listed = SF.scan_source_files(spark, root, patterns=["**/*.ts"])
    return listed.select(_inside(root).alias("path"), "content")


@register("write_file_docs", with_views(
    "select path, 1 as n_functions, 1 as n_classes, 1 as n_interfaces, 1 as n_type_aliases, 1 as n_routes "
    "from code_ts", "code_ts"))
def write_file_docs(spark, sf):
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/docs-{uuid.uuid4().hex}"
    SF.write_file_docs(FD.file_docs(source_files(spark, sf, "code_ts")), out)
    back = spark.read.json(out)
    return back.select("path", *[F.size(F.col(f"doc.{f}")).alias(f"n_{f}") for f in
                                 ("functions", "classes", "interfaces", "type_aliases", "routes")])


SCOPE = {
    "include": {"extensions": ["ts", "js", "py"], "directories": [], "files": []},
    "exclude": {"extensions": [], "directories": ["src3"], "files": ["1*"]},
}


@register("scan_scope_filter", with_views(
    "select path from doc_files where lower(regexp_extract(path, '\\.([^./]+)$', 1)) in ('ts', 'js', 'py') "
    "and not starts_with(path, '/corpus/src3/') and not regexp_matches(path, '/1[^/]*$')", "doc_files"))
def scan_scope_filter(spark, sf):
    files = load_view(spark, sf, "doc_files").select("path")
    return SF.scope_filter(files, SCOPE, base_dir="/corpus")


def heading_extractor(content):
    """Toy plug-in: every non-empty line of at most 40 characters is a heading -> one function symbol."""
    heads = F.filter(F.split(content, "\n", -1), lambda l: (F.length(F.trim(l)) >= 1) & (F.length(F.trim(l)) <= 40))
    fn = F.transform(heads, lambda l: F.struct(
        F.trim(l).alias("name"), F.array().cast("array<string>").alias("params"),
        F.lit(None).cast("string").alias("return_type"), F.lit(None).cast("string").alias("description"),
        F.lit(True).alias("exported")))
    return F.struct(fn.alias("functions"), F.lit(None).alias("classes"), F.lit(None).alias("interfaces"),
                    F.lit(None).alias("type_aliases"), F.lit(None).alias("routes"))


@register("register_extractor", with_views(
    "select path as file, cast(row_number() over (partition by path order by i) - 1 as integer) as seq, "
    "trim(t) as symbol, 'function' as type from (select path, unnest(generate_series(1, len(arr))) as i, "
    "unnest(arr) as t from (select path, string_split(content, chr(10)) as arr from doc_files "
    "where ends_with(path, '.txt')) f) l where length(trim(t)) between 1 and 40", "doc_files"))
def register_extractor(spark, sf):
    docs = load_view(spark, sf, "doc_files").select("path", "content").where(F.col("path").endswith(".txt"))
    syms = FD.flatten_file_docs(FD.file_docs(docs, plugins=[(("txt",), "headings", heading_extractor)]))
    return syms.select("file", "seq", "symbol", "type")
