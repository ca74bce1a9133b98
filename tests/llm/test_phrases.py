"""Count transducers and phrases against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldspark.llm import op13_phrases as op13
from fieldspark.llm import text
from fieldspark.llm.transducer import Transducer, distinct, packed, places

from .helpers import DOC, UPPER, corpus, sentence

GRAMS = st.dictionaries(st.tuples(st.sampled_from([b"", b"de", b"en"]), *[st.sampled_from([b"a", b"ab", b"b", b"\xc3\xa9", b"zz"])] * 3), st.integers(0, 2**40), min_size=1, max_size=60)


def automaton(counted):
    groups, words = sorted({g[0] for g in counted}), sorted({w for g in counted for w in g[1:]})
    rows = sorted(counted)
    return Transducer.build(groups, words, np.array([[groups.index(g[0]), *map(words.index, g[1:])] for g in rows]), np.array([counted[g] for g in rows]))


def paths(t):
    grams, weights = t.expand()
    return {(t.groups[g[0]], *(t.words[k] for k in g[1:])): n for g, n in zip(grams.tolist(), weights.tolist())}


@settings(max_examples=150, deadline=None)
@given(GRAMS, GRAMS)
def test_transducers(one, two):
    t, q = automaton(one), automaton(two)
    assert paths(t) == one and list(paths(t)) == sorted(one)
    again = Transducer.load(t.dump())
    assert paths(again) == one and again.dump() == t.dump()
    assert q.compose(t).tolist() == [one.get(g, -1) for g in sorted(two)]
    cuts = sorted({(g[0], g[1], g[2]) for g in two} | {(g[0], g[1], None) for g in two}, key=lambda c: (c[0], c[1], c[2] is not None, c[2] or b""))
    grams, _ = t.expand()
    whole = [g for g in paths(t)]
    for cut, at in zip(cuts, places(t.groups, t.words, grams, cuts).tolist()):
        assert at == sum(g[:3] < tuple(s for s in cut if s is not None) for g in whole)
    first, _, _ = distinct(grams[:, :2], np.zeros(len(grams), np.int64))
    heads = sorted({g[:2] for g in whole})
    for cut, at in zip(cuts, places(t.groups, t.words, first, cuts).tolist()):
        assert at == sum(h < tuple(s for s in cut if s is not None) for h in heads)


def test_equal_states_are_one():
    tails = {(b"en", p, s, b"end"): n for n, (p, s) in enumerate((bytes([p]), bytes([s])) for p in range(97, 117) for s in range(97, 107))}
    t = automaton({g: 7 for g in tails})
    assert [len(layer.first) - 1 for layer in t.layers] == [1, 1, 1, 1] and len(t.layers[2].label) == 10
    assert paths(automaton(tails)) == tails  # other counts, still one state before the last word
    assert len(automaton(tails).layers[3].label) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**40), st.integers(0, 2**40)), min_size=1, max_size=40))
def test_distinct(rows):
    grams = np.array(rows)
    some, n, where = distinct(grams, np.ones(len(rows), np.int64))
    assert some.tolist() == [list(r) for r in sorted(set(rows))] and dict(zip(map(tuple, some.tolist()), n.tolist())) == Counter(rows)
    assert (some[where] == grams).all() and len(packed(grams)) <= 2


def brute(rows, least, best=2000, longest=4, cover=80):
    counts, total = Counter(), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang in total:
        often = {g: a for (of, g), a in counts.items() if of == lang and a >= least}
        covered = {}
        for g, a in often.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    covered[g[i : i + m]] = max(covered.get(g[i : i + m], 0), a)
        found = []
        for g, a in often.items():
            if len(g) > 1 and 100 * covered.get(g, 0) < cover * a:
                score, k = min((2000000 * a // (often[g[:k]] + often[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), often[g[:k]], often[g[k:]]))
        out += [(lang, n, p.decode(), -a, one, two, total[lang], -s) for n, (s, a, p, one, two) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize("best, share, hold, block", [(2000, 1 << 22, 1 << 20, 1 << 12), (7, 150, 60, 5), (3, 20, 5, 1)])
def test_phrases(spark, best, share, hold, block):
    rng = random.Random(6)
    rows = [(t, "en") for _, t in corpus()]
    rows += [(sentence(rng, 60, 12), rng.choice(["en", "de", None, "und", ""])) for _ in range(30)]
    rows += [("Hot pair, hot pair hot pair! " * 40, "de")] * 2 + [("ice cream van.\nice\tcream van; ICE cream a|b", "fr")] * 5 + [(None, "xx"), ("", None), (".,;", "zz"), ("a\x0bb", "fr"), ("café crème x " * 6, "fr")]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, t, lang, "s", 1, "x", "y", "z") for i, (t, lang) in enumerate(rows)], DOC)
    got = op13.phrases(table.repartition(3), least=3, best=best, share=share, hold=hold, block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, best)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", min_size=1, max_size=120), st.integers(1, 10))
def test_long_texts_are_parted_between_pieces(t, size):
    data = np.frombuffer(t.encode(), np.uint8)
    spans = list(op13._cuts(data, size))
    assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == len(data)
    assert all(t[b - 1] in ".\n" for _, b in spans[:-1])


def test_a_long_text(spark):
    rng = random.Random(8)
    long = ". ".join(sentence(rng, 400, 30) for _ in range(1200))
    assert len(long) > 2 * text.SLICE
    got = op13.phrases(spark.createDataFrame([(1, long, "en", "s", 1, "x", "y", "z")], DOC), least=40, share=5000).collect()
    assert sorted(map(tuple, got)) == brute([(long, "en")], 40)


def test_products_beyond_64_bits(spark):
    a, one, two = 6_000_000_000_000, 9_000_000_000_001, 2 * 10**13 + 7
    t = automaton({(b"en", b"a", b"b"): a})
    phrases = spark.createDataFrame([(0, 2, 0, 2, 0, 0, bytearray(t.dump()))], "target int, level int, kind int, size int, home int, block int, blob binary")
    answers = spark.createDataFrame([(0, 2, 0, 1, 1, 0, [one, two])], "home int, size int, block int, kind int, level int, target int, numbers array<long>")
    assert [tuple(r) for r in op13.score(phrases, answers, 1).collect()] == [("en", "a b", a, one, two, 2_000_000 * a // (one + two))]


def test_nothing_frequent(spark):
    assert op13.phrases(spark.createDataFrame([], DOC)).collect() == []
    assert op13.phrases(spark.createDataFrame([(1, "one two three", "en", "s", 1, "x", "y", "z"), (2, None, None, "s", 1, "x", "y", "z")], DOC)).collect() == []
