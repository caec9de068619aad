"""Declaration and reference search (Y1-Y3, retired surface).

Every line of every file is read in place: comments and literals are blanked
first (same length, same line breaks), then declaration patterns are tried at
the start of each line and identifier occurrences are found with the usage
machinery.  Grammar subset: a member starts its line (after indentation), any
other declaration its statement, the first of its name on the line; a property
declaration is recognised when it carries a modifier or an initializer; a declaration's extent for the snippet is found
by bracket balance over its first lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symdex.functions.regex import escape
from symdex.functions.source_text import TS_TOKEN, mask

ID = r"[\p{L}\p{N}_$]"
SNIPPET_LINES = 5
#: Where a statement can start on its line: first, or behind the end of one or a brace.
START = r"^((?:[^\n]*?[;{}])?[ \t]*)"


def _patterns(name: str) -> list[tuple[str, str]]:
    """(kind, pattern) pairs; group 1 is the text before the declaration start on its line."""
    n = escape(name) + f"(?!{ID})"
    mods = r"(?:(?:public|private|protected|static|async|readonly|abstract|override|declare)[ \t]+)*"
    return [
        ("function", START + r"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*" + n),
        ("class", START + r"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?class[ \t]+" + n),
        ("interface", START + r"(?:export[ \t]+)?(?:declare[ \t]+)?interface[ \t]+" + n),
        ("type", START + r"(?:export[ \t]+)?(?:declare[ \t]+)?type[ \t]+" + n + r"[ \t]*(?:<[^>]*>)?[ \t]*="),
        ("variable", r"^((?:[^\n]*?[;{}(])?[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?(?:const|let|var)[ \t]+)" + n),
        ("method", r"^([ \t]*)" + mods + r"(?:\*[ \t]*)?" + n + r"[ \t]*\??[ \t]*(?:<[^>]*>)?[ \t]*\([^;]*\)[ \t]*(?::[^{;]*)?\{"),
        ("property", r"^([ \t]*)(?:(?:(?:public|private|protected|static|readonly|declare|override|abstract)[ \t]+)+#?" + n
         + r"[ \t]*[?!]?[ \t]*(?::[^=;]*)?(?:=[^;]*)?;?|#?" + n + r"[ \t]*[?!]?[ \t]*(?::[^=;]*)?=[^;>]*;)[ \t]*$"),
    ]


FUNC_INIT = r"^[ \t]*(?::[^=]*)?=[ \t]*(?:async[ \t]*)?(?:function(?![\p{L}\p{N}_$])|\([^()]*\)[^=]*=>|[\p{L}_$][\p{L}\p{N}_$]*[ \t]*=>)"


def _masked_lines(files: DataFrame) -> DataFrame:
    # a test of the masked lines would be pushed below the masking and mask again
    return files.where(F.col("content").isNotNull()).select(
        "path", F.split(F.col("content"), "\n", -1).alias("olines"),
        F.split(mask(F.col("content"), TS_TOKEN), "\n", -1).alias("mlines"))


def find_declarations(files: DataFrame, name: str) -> DataFrame:
    """Every declaration of ``name`` at any depth: (file, line, column, kind, snippet)."""
    pats = _patterns(name)
    df = _masked_lines(files)

    def classify(m):
        kind, col = None, None
        for k, p in pats:
            hit = m.rlike(p)
            pre = F.length(F.regexp_extract(m, p, 1))
            if k == "variable":
                after = F.substring(m, pre + 1 + len(name), 1 << 30)
                kind_v = F.when(after.rlike(FUNC_INIT), F.lit("function")).otherwise(F.lit("variable"))
                kind = F.when(hit, kind_v) if kind is None else kind.when(hit, kind_v)
            else:
                kind = F.when(hit, F.lit(k)) if kind is None else kind.when(hit, F.lit(k))
            col = F.when(hit, pre + 1) if col is None else col.when(hit, pre + 1)
        return F.struct(kind.alias("kind"), col.alias("column"))

    hits = F.filter(F.transform(F.col("mlines"), lambda m, i: F.struct((i + 1).alias("line"), classify(m).alias("c"))),
                    lambda h: h["c"]["kind"].isNotNull())
    rows = df.select("path", "olines", "mlines", F.explode_outer(hits).alias("h")).where(F.col("h").isNotNull())
    line, column = F.col("h.line"), F.col("h.c.column")
    # extent: bracket balance over the first SNIPPET_LINES + 1 lines from the start column
    window = F.slice(F.col("mlines"), line, SNIPPET_LINES + 1)
    first_m = F.substring(F.try_element_at(F.col("mlines"), line), column, 1 << 30)
    parts = F.concat(F.array(first_m), F.slice(window, 2, SNIPPET_LINES))
    bal = F.transform(parts, lambda t: F.length(F.regexp_replace(t, r"[^{(\[]", "")) - F.length(F.regexp_replace(t, r"[^})\]]", "")))
    opened = F.transform(parts, lambda t: t.rlike(r"[{(\[]"))
    running = F.transform(bal, lambda b, i: F.aggregate(F.slice(bal, 1, i + 1), F.lit(0), lambda a, x: a + x))
    ever = F.transform(opened, lambda o, i: F.exists(F.slice(opened, 1, i + 1), lambda x: x))
    ends = F.filter(F.transform(running, lambda r, i: F.when((r <= 0) & (F.try_element_at(ever, i + 1) | (i > 0) |
                                                                        F.try_element_at(parts, F.lit(1)).rlike(r";[ \t]*$")),
                                                               i + 1)), lambda x: x.isNotNull())
    end = F.try_element_at(ends, F.lit(1))  # 1-based index of the last line of the node, null when beyond
    first_o = F.substring(F.try_element_at(F.col("olines"), line), column, 1 << 30)
    olines = F.concat(F.array(first_o), F.slice(F.col("olines"), line + 1, SNIPPET_LINES))
    snippet = F.when(end.isNotNull() & (end <= SNIPPET_LINES),
                     F.regexp_replace(F.array_join(F.slice(olines, 1, end), "\n"), r"[ \t]+$", "")) \
        .otherwise(F.concat(F.array_join(F.slice(olines, 1, SNIPPET_LINES), "\n"), F.lit("\n...")))
    return rows.select(F.col("path").alias("file"), line.alias("line"), column.alias("column"),
                       F.col("h.c.kind").alias("kind"), snippet.alias("snippet"))


def find_references(files: DataFrame, name: str, declarations: DataFrame) -> DataFrame:
    """Y2: identifier occurrences of ``name`` outside comments / literals that are not a declaration start."""
    pat = f"(?<!{ID})" + escape(name) + f"(?!{ID})"
    df = _masked_lines(files)
    hits = F.filter(F.transform(F.col("mlines"), lambda m, i: F.struct((i + 1).alias("line"), m.alias("m"))),
                    lambda h: h["m"].rlike(pat))
    rows = df.select("path", "olines", F.explode_outer(hits).alias("h")).where(F.col("h").isNotNull())
    gaps = F.split(F.col("h.m"), pat, -1)
    occ = rows.select("path", F.col("h.line").alias("line"),
                      F.trim(F.try_element_at(F.col("olines"), F.col("h.line"))).alias("snippet"),
                      F.posexplode(F.slice(gaps, 1, F.size(gaps) - 1)).alias("k", "gap"))
    w = Window.partitionBy("path", "line").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    occ = occ.withColumn("column", (F.sum(F.length("gap")).over(w) + F.col("k") * len(name) + 1).cast("int"))
    starts = declarations.select(F.col("file").alias("path"), "line", "column")
    refs = occ.join(starts, ["path", "line", "column"], "left_anti")
    return refs.select(F.col("path").alias("file"), "line", "column", F.lit("reference").alias("kind"), "snippet")


def search_for_symbol(files: DataFrame, name: str, include_references: bool = True):
    """(declarations, references or None); references only when some declaration exists."""
    decls = find_declarations(files, name)
    if not include_references:
        return decls, None
    refs = find_references(files, name, decls)
    any_decl = decls.select(F.lit(1).alias("_one")).limit(1)
    refs = refs.withColumn("_one", F.lit(1)).join(F.broadcast(any_decl), "_one", "left_semi").drop("_one")
    return decls, refs
