"""The stages of corpus_pipeline, run as a whole, against plain versions."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from symdex.llm import source_mix
from tests.llm import brute
from tests.llm.conftest import SCHEMA, prose


def near_copies(rows, words, percent):
    """Ids (of distinct ones) that name their group of linked texts."""
    sets = {i: brute.shingles(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def corpus():
    """Distinct texts, copies with 2.1 percent of their words changed, a footer, and documents that the base check rejects."""
    rng = random.Random(11)
    texts = []
    for i in range(12):
        w = [f"{x}{k}" for k, x in enumerate(prose(rng, 420).split())]
        edited = list(w)
        for k in range(20, 400, 45):  # 9 of 420 words, scattered: 5-word shingles alike by 0.80 to 0.82
            edited[k] = f"edit{i}"
        texts += [" ".join(w), " ".join(edited)]
    texts += [prose(rng, 80) + f"\nPage {i} of the common footer line here" for i in range(12)]
    texts += [None, "", "too short", "one and the same five words here " * 9, prose(rng, 70)]
    return [(3 * i + 1, t, "en", ("web", "books", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]


def test_pipeline_against_plain_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = corpus()
    pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(SCHEMA.names, zip(*rows), [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()])}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, 4], pa.int64()), "quality": pa.array([1, 0], pa.int32()), "toxic": pa.array([0, 0], pa.int32())}), tmp_path / "labels.parquet")

    kept = [r for r in rows if not brute.quality_base(r[1])[-1]]  # two labels certify nothing
    lines = brute.line_dedup([r[:2] for r in kept], 10)
    assert sum(n for _, n, _ in lines.values()) == 12
    texts = {i: t for i, (_, _, t) in lines.items()}
    stay = near_copies(list(texts.items()), 5, 80)
    assert len(near_copies(list(texts.items()), 4, 85)) > len(stay) == len(texts) - 12
    left = [(i, texts[i], *rest) for i, _, *rest in kept if i in stay]
    mixed = Counter(r.doc_id for r in source_mix.mixed_documents(spark.createDataFrame(left, SCHEMA)).collect())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == mixed and len(mixed) > 0
    for r in got:
        want = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.decoded == texts[r.doc_id]
