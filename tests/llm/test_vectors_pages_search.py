"""Vector codes, page texts and ranked search against plain versions, and their odd rows."""

import hashlib
import html
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symdex.llm import html_text, lexical_search, vector_codes
from tests.llm.conftest import SCHEMA, prose

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


# --- vector codes ---------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    """{vec_id: (code, error, label_error)} and the digest, every part compared with every entry."""
    kept = sorted((i, [math.floor(4096 * np.float32(x).astype(float)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(own, book):
        return min((sum((a - b) ** 2 for a, b in zip(own, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, m in members.items():
                books[p][k] = [sum(x) // len(m) for x in zip(*m)]
    out, labels = {}, Counter()
    for (i, _, label), c in zip(kept, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label)
        labels[label] += out[i][1]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (code, error, labels[label]) for i, (code, error, label) in out.items()}, digest


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    centers = [[rng.uniform(-0.4, 0.4) for _ in range(16)] for _ in range(9)]
    rows = [(7 * i + 1, [c + rng.gauss(0, 0.05) for c in rng.choice(centers)], rng.choice([0, 1, 1, 1, None])) for i in range(150)]
    rows += [(2000 + i, rows[0][1], 1) for i in range(60)]  # one vector many times
    rows += [(3000, None, 1), (3001, [None] + rows[0][1][1:], 1), (3002, [math.nan] * 16, 1), (3003, [math.inf] * 16, 1), (3004, [], 1)]
    return rows


def test_vector_codes(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS).repartition(5).withColumns({c: F.lit("clash") for c in ("code", "error", "vector", "salt", "n", "entry")})
    got = vector_codes.codes(df, parts=4, entries=8, rounds=3).collect()
    want, digest = plain_codes(vectors, 4, 8, 3)
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and len(got) == len(want)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_vector_codes_of_odd_tables(spark):
    assert vector_codes.codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.codes(spark.createDataFrame([(1, None, 1), (2, [1.0] * 9, 1)], VECTORS)).collect() == []
    rows = [(None, [9.0] * 8, None), (5, [1.0] * 8, None), (5, [1.0] * 8, None), (6, [1.0] * 16, 1), (7, [3e38] * 8, 2), (8, [-3e38] * 8, 2)]
    got = sorted(((r.vec_id is None, r.vec_id, r.code, r.error) for r in vector_codes.codes(spark.createDataFrame(rows, VECTORS), rounds=1).collect()), key=str)
    assert got == [(False, 5, "00" * 8, 0), (False, 5, "00" * 8, 0), (False, 7, "02" * 8, 0), (False, 8, "03" * 8, 0), (True, None, "04" * 8, 0)]


@pytest.mark.parametrize("n, entries, width, size, seed", [(800, 16, 8, 600, 1), (500, 70, 3, 4, 2), (300, 5, 2, 1, 3), (100, 1, 3, 9, 4), (400, 150, 2, 2**26, 5)])
def test_tree_finds_the_nearest_entry(n, entries, width, size, seed):
    rng = np.random.default_rng(seed)
    points, queries = rng.integers(-size, size + 1, (entries, width)), rng.integers(-size, size + 1, (n, width))
    best, square, taken = vector_codes.Gnat(points).nearest(queries)
    all_squares = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    assert (best == all_squares.argmin(axis=1)).all() and (square == all_squares.min(axis=1)).all()
    assert taken < n * entries or entries <= vector_codes.DEGREE or size < 10


# --- page texts -----------------------------------------------------------------

BESIDE = [
    "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News, and more.</a></ul></nav>", '<div class="ad">Buy this now, it is cheap. Really, buy it.</div>', "<header><a href=/>A site, its name.</header>",
    "<aside><h2>More</h2><p>Another story, told in some words, is here.</p></aside>", '<div id="cookie-notice"><p>We use cookies, as all do. Accept?</p></div>', '<form action="/x"><label>Mail, please</label><input name=a><button>Go</button></form>',
    '<section class="comments"><h3>Comments</h3><p>First! This is a long comment, it has marks. And sentences.</p></section>', "<footer>&copy; me &middot; all rights, reserved.</footer>",
    "<script>if (a < b) document.write('<p>no, never.</p>')</script>", "<style>p > a { margin: 0 }</style>", "<!-- <p>hidden, too.</p> -->", "<noscript><p>Turn it on, please.</p></noscript>", '<div style="display: none"><p>Unseen words, many of them.</p></div>',
    '<ul class="menu"><li><a href=1>one</a><li><a href=2>two</a></ul>', '<div role="navigation"><p>Way, and way.</p></div>', '<div class="site-footer"><p>The end, of it.</p></div>',
]


def rendered(rng, paragraphs, style):
    """A page of these paragraphs with parts beside them."""
    def marked(t):
        words = [html.escape(w, quote=False) if rng.random() < 0.9 else f"<b>{html.escape(w, quote=False)}</b>" for w in t.split(" ")]
        return rng.choice([" ", "\n  "]).join(words)

    body = [f"<h1>{marked(paragraphs[0])}</h1>", *(f"<p>{marked(p)}{rng.choice(['</p>', ''])}" for p in paragraphs[1:])]
    some = [rng.sample(BESIDE, rng.randint(0, 5)) for _ in range(3)]
    article = {"article": "<article>{}</article>", "main": "<main><div class=wrap>{}</div></main>", "div": "<div id=content><div class=post-content>{}</div></div>", "bare": "<div>{}</div>"}[style]
    inner = "".join(body[:2]) + "".join(some[0] if style == "article" else []) + "".join(body[2:])
    return f"<!DOCTYPE html><html><head><title>T, and t</title></head><body class=x>{''.join(some[1])}{article.format(inner)}{''.join(some[2])}{rng.choice(['</body></html>', ''])}"


def test_pages_come_back(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(240):
        paragraphs = [" ".join(prose(rng, n).split()) for n in [rng.randint(3, 9), *(rng.choice([2, 20, 60]) for _ in range(rng.randint(2, 7))), 50]]
        paragraphs[1] += " R&D < 5 > é"
        rows.append((i, f"http://h/{i}", rendered(rng, paragraphs, ("article", "main", "div", "bare")[i % 4])))
        want[i] = "\n".join(paragraphs)
    df = spark.createDataFrame(rows, PAGES).repartition(4).withColumns({c: F.lit("clash") for c in ("text", "n_chars", "path")})
    got = {r.page_id: r for r in html_text.page_texts(df).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and r.url == f"http://h/{i}" for i, r in got.items())


def test_pages_of_the_table(spark):
    """The test table has one frame around its articles."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.page_id: r.text for r in html_text.page_texts(pages).collect()}
    for r in pages.collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])
        want = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert texts[r.page_id] == "\n".join(b for b in want if b)


def test_paths_decide():
    """Without marks by tag or class, the paths' ratios tell the content, and stop doing so when they are made equal."""
    story = "".join(f"<p>A sentence of this story, the {i}th of them, goes on. And ends, at last.</p>" for i in range(4))
    page = f"<body><div><span>Home</span><div>News</div><div>Sport</div></div><div><div>{story}</div></div><div><i>Imprint</i></div>"
    assert html_text.main_text(page).count("\n") == 3 and html_text.main_text(page).startswith("A sentence")
    scores, html_text.path_scores = html_text.path_scores, lambda blocks: {node.path: 1.0 for node, _, _ in blocks}
    try:
        assert "Imprint" in html_text.main_text(page + "<div><i>" + "Imprint " * 100)
    finally:
        html_text.path_scores = scores


def test_odd_pages(spark):
    pages = {
        None: "", "": "", "  ": "", "<": "<", "plain words": "plain words", "<p": "", "<!-- open": "", "<script>never ends": "", "a &lt;b&gt; &nbsp; c&#233;&amp": "a <b> cé&", "<p>a<br>b<p>c</i></div>": "a b\nc",
        "<ul><li><a href=1>one</a><li><a href=2>two</a></ul>": "", "<body><h1>Head</h1><p>Only one paragraph, here.</p>": "Head\nOnly one paragraph, here.",
        '<div class="box sidebar-left"><div class=ad>No.</div><main><article><header><h1>T</h1></header><p>One, two.</article></main></div>': "T\nOne, two.",
        "<table><tr><td><a href=1>m</a><td><h2>T</h2><p>abc, def.</p><p>ghi</table>": "T\nabc, def.\nghi", "<article class=comment><p>Long words, of a reader.</article><article><p>x": "x",
    }
    rows = [(None if i == 3 else i % 5, None if i % 2 else "u", page) for i, page in enumerate(pages)]
    got = html_text.page_texts(spark.createDataFrame(rows, PAGES).coalesce(1)).collect()
    assert [(r.page_id, r.url, r.text) for r in got] == [(i, u, pages[p]) for i, u, p in rows]
    assert html_text.page_texts(spark.createDataFrame([], PAGES)).collect() == []


def test_long_page_is_whole():
    words = " ".join(f"w{i}," for i in range(200_000))
    assert html_text.main_text(f"<nav>x</nav><article><h1>T</h1><p>{words}</p></article>") == f"T\n{words}"
    assert html_text.main_text("<div>" * 20_000 + "x, y") == "x, y"


# --- ranked search --------------------------------------------------------------


def plain_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def counted(text):
        return Counter(term.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")))

    tf = [(i, counted(t)) for i, t, *_ in docs]
    df = Counter(w for _, c in tf for w in c)
    n_docs, n_terms = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in tf:
            m = 25 + 75 * sum(c.values()) * n_docs // max(n_terms, 1)
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w, q in counted(text).items() if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def items_of(messy):
    rng = random.Random(4)
    words = " ".join(t for _, t, *_ in messy if t).split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 8, 40])))) for i in range(40)]
    return [*items, (100, None), (101, ""), (102, "...!?"), (103, "nowhere-to-be-found zzzzzzzz"), (104, "THE the ThE of"), (None, "the é中😀"), items[0], (0, "another text of this id"), (105, "ab" * 500), (106, messy[3][1])]


def test_search(spark, messy, messy_docs):
    items = items_of(messy)
    docs = messy_docs.unionByName(spark.createDataFrame([(None, messy[5][1], None, None, 0), (1, messy[0][1], None, None, 0)], SCHEMA), allowMissingColumns=True)
    rows = [*messy, (None, messy[5][1]), (1, messy[0][1])]
    queries = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit("clash") for c in ("item", "term", "weight", "block", "rank", "score")})
    got = lexical_search.search(docs, queries, k=7).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(rows, items, 7)


def test_search_in_small_shards(spark, messy, messy_docs, monkeypatch):
    for name, value in (("SHARD_DOCS", 10), ("GROUP_DOCS", 30), ("QUERIES", 6)):
        monkeypatch.setattr(lexical_search, name, value)
    items = items_of(messy)
    got = lexical_search.search(messy_docs, spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(messy, items, 10)


def test_search_of_odd_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "some words")], ITEMS)
    nothing = spark.createDataFrame([(1, None, None, None, None), (2, " - ", None, None, 1)], SCHEMA)
    one = spark.createDataFrame([(1, "Some", None, None, 1)], SCHEMA)
    assert lexical_search.search(no_docs, items).collect() == lexical_search.search(nothing, items).collect() == []
    assert lexical_search.search(one, spark.createDataFrame([], ITEMS)).collect() == []
    assert [tuple(r) for r in lexical_search.search(one, items).collect()] == plain_search([(1, "Some")], [(1, "some words")], 10)


def packed_shard(rng, n_docs, n_terms):
    """A shard of random documents, its lists, and every score of a query of all terms."""
    lengths = rng.integers(5, 400, n_docs)
    lists, times = {}, {}
    for t in range(n_terms):
        docs = np.flatnonzero(rng.random(n_docs) < rng.choice([0.01, 0.1, 0.6]))
        if len(docs):
            times[t] = docs, rng.geometric(0.4, len(docs))
            lists[t] = [(0, lexical_search.posting_list(*times[t], lengths[docs]))]
    shard = lexical_search.Shard(np.arange(n_docs), lengths, lists, n_docs, int(lengths.sum()))
    return shard, times


def test_blocks_are_skipped_and_none_too_many():
    rng = np.random.default_rng(6)
    shard, times = packed_shard(rng, 6000, 12)
    skipped = 0
    for _ in range(30):
        weights = {t: int(rng.integers(1, 9000)) for t in rng.choice(list(times), 6, replace=False).tolist()}
        scores = np.zeros(6000, np.int64)
        for t, w in weights.items():
            docs, n = times[t]
            scores[docs] += w * shard._impact(n, shard._m[docs])
        docs, own, unpacked = lexical_search.best_of_shard(shard, weights, 10)
        best = np.lexsort((np.arange(6000), -scores))[:10]
        assert docs[np.lexsort((docs, -own))[:10]].tolist() == best.tolist() and (scores[docs] == own).all()
        skipped += sum(len(shard.lists[t].last) for t in weights) - unpacked
    assert skipped > 0


def test_posting_lists_come_back():
    rng = np.random.default_rng(7)
    shard, times = packed_shard(rng, 3000, 6)
    for t, (docs, n) in times.items():
        at, impacts = shard.lists[t].whole()
        want = shard._impact(n, shard._m[docs])
        assert (at == docs).all() and (impacts == want).all()
        first = np.arange(0, len(docs), lexical_search.BLOCK)
        assert (shard.lists[t].block_best == np.maximum.reduceat(want, first)).all()


def test_terms_of_long_texts():
    text = ("Word1 ÄÖ-x " * 60_000).encode() + b"a" * (3 << 20) + b" end"
    hashes, counts = lexical_search.term_hashes([b"", text, b"word1"])
    assert counts.tolist() == [0, 180_002, 1] and hashes[0] == hashes[-1] and len(set(hashes.tolist())) == 5
