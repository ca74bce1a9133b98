"""Vector codes against plain Python."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldspark.llm import op11_equal_average as op11

VECTORS = "vec_id long, embedding array<float>, label int, v string, code string, `part` int"


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 80), st.integers(0, 9), st.sampled_from([3, 60, 5000, 2**40, 2**53]))
def test_search_is_exact(seed, k, size, top):
    rng = np.random.default_rng(seed)
    entries, v = rng.integers(-top, top + 1, (k, size)), rng.integers(-top, top + 1, (40, size))
    entries[-1] = entries[0]  # a tie
    v[: min(k, 20)] = entries[: min(k, 20)]
    index, d = op11.Codebook(entries).nearest(v)
    for row, i, far in zip(v.tolist(), index.tolist(), d.tolist()):
        assert (far, i) == min((sum((a - b) ** 2 for a, b in zip(row, e)), n) for n, e in enumerate(entries.tolist()))


def test_only_a_part_of_the_entries_is_looked_at(monkeypatch):
    rng = np.random.default_rng(1)
    entries = rng.integers(-1000, 1000, (256, 1)) * np.ones((1, 8), int) + rng.integers(-3, 4, (256, 8))
    seen = []
    keys = op11._Search._keys
    monkeypatch.setattr(op11._Search, "_keys", lambda self, rows, lo, hi: seen.append(len(rows) * (hi - lo)) or keys(self, rows, lo, hi))
    v = entries[rng.integers(0, 256, 20_000)]
    op11.Codebook(entries).nearest(v)
    assert sum(seen) < 0.5 * len(v) * 256


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in e], lab) for i, e, lab, *_ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    size = -(-length // parts)
    cut = lambda v: [(v + [0] * (size * parts - length))[p * size : (p + 1) * size] for p in range(parts)]
    fit = [cut(v) for _, v, _ in kept if len(v) == length]
    books = [[f[p] for f in fit[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for f in fit:
                members[near(p, f[p])[1]].append(f[p])
            for n, own in members.items():
                books[p][n] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for i, v, lab in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))] if len(v) == length else None
        code, error = ("".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)) if found else (None, None)
        total[lab] += error or 0
        out.append((i, code, error, lab))
    return sorted(repr((i, c, e, total[lab], sha)) for i, c, e, lab in out)


def codes(spark, rows, schema=VECTORS):
    got = op11.compress(spark.createDataFrame(rows, schema)).collect()
    return sorted(repr((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in got)


def test_codes_with_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(op11, "HOT", 5)  # labels with over a fifth of the rows are broadcast, the others joined
    rng = random.Random(3)
    vec = lambda n=8: [float(np.float32(rng.gauss(0, 1))) for _ in range(n)]
    rows = [(i, vec(), rng.choice([0, 0, 0, 1, 2, 3, None])) for i in range(300)]
    rows += [rows[7]] * 40 + [(None, vec(), 1), (None, vec(), None), (-5, vec(), None), (-5, vec(), 2)]
    rows += [(900, None, 0), (901, [], 1), (902, vec(7), 1), (903, [None, *vec(7)], 0), (904, [float("nan"), *vec(7)], 0), (905, [float("-inf"), *vec(7)], 0)]
    rng.shuffle(rows)
    rows = [(*r, "x", "y", 1) for r in rows]
    assert codes(spark, rows) == brute(rows)


def test_few_vectors_odd_lengths_and_huge_components(spark):
    rows = [(3, [1.0, 2.0, -0.5, 0.25, 1e30], None, "", "", 1), (1, [0.0] * 5, 4, "", "", 1), (2, [0.0] * 5, 4, "", "", 1)]
    got = {r["vec_id"]: r for r in op11.compress(spark.createDataFrame(rows, VECTORS)).collect()}
    assert [got[i]["code"] for i in (1, 2, 3)] == ["00000000", "00000000", "02020200"] and [r["error"] for r in got.values()] == [0] * 3
    small = [(i, [i / 7, -i / 3], 1, "", "", 1) for i in range(9)]
    assert codes(spark, small) == brute(small)


def test_no_vectors(spark):
    assert codes(spark, []) == [] and codes(spark, [(1, None, 1, "", "", 1), (2, [float("nan")], 1, "", "", 1)]) == []
    assert codes(spark, [(1, [], 1, "", "", 1)]) == brute([(1, [], 1)])
