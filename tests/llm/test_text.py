import random
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldspark.llm import store, text
from fieldspark.llm.op04_sparse_suffixes import minimisers

from .helpers import words

ANY = st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aB \n\t.é日", max_size=60)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(ANY, st.integers(1, 50))
def test_words_are_those_of_the_pattern(texts, limit):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    got = []
    for part in text.slices(pa.array(texts, pa.string()), limit):
        w = text.words(part)
        got += [[part.text(w.start[k], w.end[k]) for k in range(a, b)] for a, b in zip(w.first, w.first[1:])]
    assert got == [words(t, lower=False) for t in texts]


def test_equal_words_and_windows_hash_alike():
    parts = list(text.slices(pa.array(["One two ONE two three", "one two one TWO", None, ""])))
    w = text.words(parts[0])
    assert w.hash[0] == w.hash[2] == w.hash[5] and len(set(w.hash.tolist())) == 3
    assert len(text.shingles(w.hash[:5], 2)) == 3 and len(text.shingles(w.hash[5:6], 4)) == 1 and not len(text.shingles(w.hash[:0], 4))
    assert text.grams(w.hash, 4)[0] == text.grams(w.hash[5:], 4)[0]


def test_long_documents_are_cut_at_separators(monkeypatch):
    monkeypatch.setattr(text, "SLICE", 16)
    long = "ab cd " * 50 + "x" * 100 + " y"
    w = text.words(next(text.slices(pa.array([long]))))
    assert len(w.hash) == 102 and len(np.unique(w.hash)) == 4


def test_a_task_holds_few_rows_and_small_slices(spark):
    rng = random.Random(2)
    column = pa.array([" ".join(f"w{rng.randrange(999)}" for _ in range(400)) for _ in range(600)])
    text.powers(1 << 16)
    tracemalloc.start()
    for part in text.slices(column):
        minimisers(text.words(part), 50, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20

    def rows(batches):
        for batch in batches:
            yield pa.record_batch({"n": [batch.num_rows]})

    store.prepare(spark)
    sizes = [r["n"] for r in spark.range(0, 1200, 1, 1).mapInArrow(rows, "n long").collect()]
    assert sum(sizes) == 1200 and max(sizes) <= 500
