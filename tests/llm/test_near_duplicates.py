import random

import numpy as np
import pytest

from fieldspark.llm import links
from fieldspark.llm import op02_bbit_minhash as op

from .helpers import DOC, corpus, near, sentence, shingles, table


@pytest.mark.parametrize("size", [4, 5])
def test_equals_brute_force(spark, size):
    rows = corpus()
    want = near(rows, size)
    got = op.near_duplicates(table(spark, rows), size=size).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None) == sorted((i, len(shingles(t, size))) for i, t in rows if i is not None)
    for r in got:
        i = r["doc_id"]
        assert r["component_id"] == (None if i is None else want[i]) and r["kept"] == (i is None or want[i] == i)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Near copies of near copies, in buckets of several blocks: most links are not with the smallest id."""
    monkeypatch.setattr(links, "BLOCK", 8)
    rng = random.Random(2)
    base = sentence(rng, 150).split()
    texts = []
    for k in range(60):
        start = base if k < 20 or rng.random() < 0.3 else texts[rng.randrange(len(texts))].split()
        changed = list(start)
        for _ in range(rng.randrange(7)):
            changed[rng.randrange(len(changed))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(changed))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = near(rows, 4)
    got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(table(spark, rows), size=4).collect()}
    assert got == want and len(set(want.values())) > 1


def test_keep_one(spark):
    rows = corpus()
    want = near(rows, 5)
    docs = table(spark, rows)
    got = op.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == sorted(str((i, t)) for i, t in rows if i is None or want[i] == i)


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], DOC)).collect() == []
    assert op.keep_one(spark.createDataFrame([], DOC)).collect() == []


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        both = rng.integers(0, 1 << 63, 2000, np.uint64)
        n = int(2000 * (1 - share) / (2 * share))
        one, two = (np.concatenate([both, rng.integers(0, 1 << 63, n, np.uint64)]) for _ in range(2))
        packed = op.pack(np.stack([op.minima(one), op.minima(two)]))
        true = 2000 / (2000 + 2 * n)
        assert abs(op.estimate(packed[0], packed[1]) - true) < 0.11
