import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]])
#: Columns of the operators' own results and working tables, as extra columns of an input.
CLASHING = ["size", "target", "source_size", "copies", "key", "grade", "node", "root", "gram", "stretch", "spans", "n", "kept", "n_words", "words", "bins", "range", "doc", "line", "leaf", "a", "b", "_doc", "_drops", "ids", "start", "label"]


def prose(rng: random.Random, n: int) -> str:
    common = ["the", "of", "and", "in", "a", "to", "is"]
    out = []
    for _ in range(n):
        out.append(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.08:
            out[-1] += ".\n" if rng.random() < 0.5 else "."
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def messy():
    """Rows (doc_id, text, lang, source, n_chars) with distinct ids: copies, near copies, shared passages, empty, blank, very long and odd texts."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(12, 160)) for _ in range(60)]
    passage = prose(rng, 60)
    for i in range(8):
        texts.append(prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30))
    for t in texts[:6]:
        texts.append(t)
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    for i in range(14):
        texts.append(prose(rng, 40) + f"\nPage {i} of the common footer line here\n" + prose(rng, 20))
    texts += [None, "", " ", "\n\n", "word", "two words", "three short words", "three short words", "exactly four words here", "\x0b\x0c tab\tand\r\nbreak", "é中😀 " * 30, "a" * 700, "ab" * 500, "\x1c\x85\xa0 odd spaces　here", "#$% *** |<>& " * 12, "SHOUT!! " * 15, "same line\n" * 12]
    texts.append(prose(rng, 6000))
    sources = ["web", "books", None, "Zoo", "ärger"]
    return [(i * 3 + 1, t, rng.choice(["en", "fr", None]), rng.choice(sources), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def messy_docs(spark, messy):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
