"""Paragraphs, suffixes and benchmark overlaps."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import op01_paragraphs, op04_sparse_suffixes
from fieldspark.llm import op10_spaced_seeds as op10
from fieldspark.llm.neighbours import first_places, shared
from fieldspark.llm.store import keep

from .helpers import DOC, corpus, sentence, table, words


def repeated_stretches(rows, length=50):
    """(doc_id, text) to maximal passages, the first place by id (null first) staying; rows of one id and text are one."""
    seen, out = {}, {}
    distinct = sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in distinct:
        w, spans = words(t), []
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if key in seen:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
            else:
                seen[key] = (i, k)
        if spans:
            out[i, t] = [tuple(s) for s in spans]
    return out


def single_ids(rows):
    """Without ids that have two texts, whose order is that of a hash."""
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    return [(i, t) for i, t in rows if len(texts[i]) == 1]


def test_suffixes_equal_brute_force(spark):
    rng = random.Random(8)
    hot = sentence(rng, 60)
    rows = single_ids(corpus(extra=[f"{sentence(rng, k % 9)} {hot} {sentence(rng, k % 5)}" for k in range(40)] + ["y " * 400]))
    want = repeated_stretches(rows)
    got = op04_sparse_suffixes.repeats(table(spark, rows)).collect()
    texts = {i: t for i, t in rows}
    assert {(r["doc_id"], texts[r["doc_id"]]): [tuple(s) for s in r["spans"]] for r in got} == want and len(want) > 40


def test_cut_removes_the_passages_only(spark):
    rows = single_ids(corpus())
    want = repeated_stretches(rows)
    docs = table(spark, rows)
    got = op04_sparse_suffixes.cut_repeats(docs).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    for r in got:
        old = texts[r["doc_id"]]
        spans = want.get((r["doc_id"], old), [])
        w = words(old)
        left = [x for k, x in enumerate(w) if not any(a <= k < b for a, b in spans)]
        assert words(r["text"]) == left and (spans or r["text"] == old) and (not spans or r["n_chars"] == len(r["text"]))


def test_paragraphs_find_passages_and_leave_others(spark):
    rng = random.Random(4)
    clean = [(k, sentence(rng, 120, 10**6)) for k in range(30)]
    passage = sentence(rng, 60, 10**6)
    edited = passage.split()
    edited[30] = "edited"
    planted = [(100 + k, f"{sentence(rng, 30 + 3 * k, 10**6)}{' ' if k % 2 else chr(10)}{passage} {sentence(rng, k, 10**6)}") for k in range(10)]
    planted += [(200, f"{sentence(rng, 25, 10**6)}\n{' '.join(edited)}"), (201, f"{passage}\nshort line"), (202, f"x\n{passage}")]
    rows = clean + planted + [planted[0], (None, ""), (7000, None), (7001, "short line"), (7002, "short line")]
    got = op01_paragraphs.repeated_paragraphs(table(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in planted}
    texts = {i: t for i, t in rows}
    for r in got:
        assert len(words(texts[r["doc_id"]][r["start"] : r["end"]])) == r["last_word"] - r["first_word"] + 1
    for component in {r["component"] for r in got}:
        own = [r for r in got if r["component"] == component]
        assert sum(not r["removed"] for r in own) == 1 and min(r["doc_id"] for r in own) == next(r["doc_id"] for r in own if not r["removed"])


def test_near_paragraphs_are_verified(spark):
    rng = random.Random(6)
    line = sentence(rng, 40, 10**6).split()
    near, far = [*line[:-1], "other"], [w if k % 3 else "other" for k, w in enumerate(line)]
    rows = [(k, " ".join(x)) for k, x in enumerate((line, near, far))]
    got = op01_paragraphs.repeated_paragraphs(table(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == {0, 1}


def test_passages_inside_lines_come_out_whole(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for k in range(60):
        passage = sentence(rng, 51 + k % 5, 10**6)
        for copy in range(2):
            before = sentence(rng, 3 + rng.randrange(30), 10**6)
            rows.append((2 * k + copy, f"{before} {passage} {sentence(rng, 3 + rng.randrange(30), 10**6)}"))
            want[2 * k + copy] = (len(words(before)), len(words(before)) + len(words(passage)) - 1, bool(copy), 2 * k, passage)
    got = op01_paragraphs.repeated_paragraphs(table(spark, rows)).collect()
    found = {(r["doc_id"], r["first_word"], r["last_word"], r["removed"], r["first_doc_id"], dict(rows)[r["doc_id"]][r["start"] : r["end"]]) for r in got}
    assert all((i, *x) in found for i, x in want.items())


def test_lines_with_a_changed_word_are_near(spark):
    rng = random.Random(14)
    rows = []
    for k in range(40):
        line = sentence(rng, 60, 10**6).split()
        edited = list(line)
        edited[20 + k % 20] = "edited"
        rows += [(2 * k, f"{sentence(rng, 20, 10**6)}\n{' '.join(line)}"), (2 * k + 1, f"{sentence(rng, 20, 10**6)}\n{' '.join(edited)}")]
    got = op01_paragraphs.repeated_paragraphs(table(spark, rows)).collect()
    whole = {(r["doc_id"], r["removed"], r["first_doc_id"]) for r in got if (r["first_word"], r["last_word"]) == (20, 79)}
    assert whole == {(k, bool(k % 2), k // 2 * 2) for k in range(80)}


def test_bands_miss_few_pairs():
    at = 0.8
    assert (1 - at**op01_paragraphs.ROWS) ** op01_paragraphs.BANDS < 1e-5


def test_short_sets_that_are_near_share_a_band():
    rng = random.Random(21)
    flat, upto, pairs = [], [0], []
    while len(pairs) < 400:
        n = rng.randrange(4, 29)
        common = rng.sample(range(1 << 62), n)
        more = [[x for x in rng.sample(range(1 << 62), rng.randrange(1 + n // 8))] for _ in range(2)]
        if 100 * n < 80 * (n + len(more[0]) + len(more[1])) or min(n + len(m) for m in more) > op01_paragraphs.SHORT:
            continue
        pairs.append(len(upto) - 1)
        for m in more:
            flat += sorted(common + m)
            upto.append(len(flat))
    own, keys = op01_paragraphs.band_keys(np.array(flat, np.uint64), np.array(upto))
    sets = {}
    for o, k in zip(own.tolist(), keys.tolist()):
        sets.setdefault(o, set()).add(k)
    size = np.diff(upto)
    exact = [k for k in pairs if max(size[k], size[k + 1]) <= op01_paragraphs.SHORT]
    assert len(exact) > 200 and all(sets[k] & sets[k + 1] for k in exact)
    assert sum(not sets[k] & sets[k + 1] for k in pairs) <= 1  # the others have minima in common
    assert max(len(sets[k]) for k in range(len(size)) if size[k] < 10) <= 3


def test_classes_carry_places_only(spark):
    rng = random.Random(22)
    line = sentence(rng, 12, 10**6)
    rows = op01_paragraphs._documents(table(spark, [(1, line), (2, line), (3, sentence(rng, 12, 10**6))]), "doc_id", "text")
    known = op01_paragraphs.classes(rows)
    assert known.columns == ["id", "place", "last"]
    assert {r["place"]["doc_id"]: r["last"] and r["last"]["doc_id"] for r in known.collect() if r["place"]["first_word"] == 0} == {1: 2, 3: None}
    keys = shared(op01_paragraphs.banded(rows.unionByName(rows)), "key", "id", distinct=True)
    assert keys.groupBy("key", "id").count().where("count > 1").count() == 0


def test_repeated_paragraphs_that_stand_alone_stay(spark):
    rng = random.Random(13)
    short = sentence(rng, 9, 10**6)
    rows = [(k, f"{sentence(rng, 40, 10**6)}\n{short}\n{sentence(rng, 40, 10**6)}") for k in range(8)]
    got = op01_paragraphs.repeated_paragraphs(table(spark, rows)).collect()
    assert {r["doc_id"] for r in got if (r["first_word"], r["last_word"]) == (40, 48)} == set(range(8)) and sum(not r["removed"] for r in got) >= 1


def overlap(doc, item):
    """The most equal words in a span, or None."""
    span = min(16, len(item))
    if len(item) < 8:
        return None
    known, need = set(doc), span - span * 3 // 16
    if all(sum(w in known for w in item[q : q + span]) < need for q in range(len(item) - span + 1)):
        return None  # too few of its words are in the document at all
    best = -1
    for q, p in itertools.product(range(len(item) - span + 1), range(len(doc) - span + 1)):
        best = max(best, sum(a == b for a, b in zip(doc[p : p + span], item[q : q + span])))
    return best if best >= span - span * 3 // 16 else None


def test_masks_are_lossless():
    for size in range(op10.SHORTEST, op10.SPAN + 1):
        for bad in itertools.combinations(range(size), size * op10.SUBSTITUTIONS // op10.SPAN):
            assert any(all(a + k not in bad for k in mask) for mask in op10.MASKS for a in range(size - mask[-1]))


@pytest.mark.parametrize("block", [op10.BLOCK, 60])
def test_overlaps_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op10, "BLOCK", block)
    rng = random.Random(3)
    items = [(k, sentence(rng, n, 50)) for k, n in enumerate([3, 8, 9, 12, 15, 16, 20, 40])] + [(20, None), (21, ""), (22, "the " * 20)]
    docs = []
    for k in range(60):
        item = rng.choice(items[1:8])[1].split()
        for _ in range(rng.randrange(6)):
            item[rng.randrange(len(item))] = "other"
        docs.append((k, f"{sentence(rng, rng.randrange(12), 50)} {' '.join(item).upper()} {sentence(rng, rng.randrange(9), 50)}"))
    docs += [(90, None), (91, ""), (92, "the " * 15), (93, "the " * 500), docs[0], (None, docs[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in docs:
        for k, s in items:
            if (n := overlap(words(t), words(s))) is not None:
                want[i, k] = max(n, want.get((i, k), 0))
    got = op10.contaminated(table(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["matches"] for r in got} == want and len(got) == len(want) > 20
    clean = op10.drop_contaminated(table(spark, docs), bench)
    assert clean.columns == table(spark, docs).columns
    bad = {i for i, _ in want}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    some = table(spark, [(1, "a b c d e f g h i")])
    assert op01_paragraphs.repeated_paragraphs(none).collect() == [] and op04_sparse_suffixes.repeats(none).collect() == []
    assert op04_sparse_suffixes.cut_repeats(none).collect() == [] and op10.contaminated(none, bench).collect() == []
    assert op10.contaminated(some, bench).collect() == [] and op10.drop_contaminated(some, bench).count() == 1


def test_first_places_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    rows = {(int(k), None if d == 9 else int(d), int(d) * 7, int(s)) for k, d, s in zip(rng.choice([1, 2, 3, *range(10, 400)], 3000, p=[0.3, 0.2, 0.1, *[0.4 / 390] * 390]), rng.integers(0, 10, 3000), rng.integers(0, 500, 3000), strict=True)}
    place = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    want = sorted(str((*r, *min(g, key=place)[2:])) for g in by_key.values() if len(g) > 1 for r in g)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for partitions in (1, 40):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = first_places(spark.createDataFrame(sorted(rows, key=str), "stretch long, doc_id long, row long, start int"), "stretch", "doc_id", "row", "start")
            assert sorted(str(tuple(r)) for r in got.collect()) == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert first_places(spark.createDataFrame([], "stretch long, doc_id long, row long, start int"), "stretch", "doc_id", "row", "start").collect() == []


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    files = lambda: sum(f.getName().endswith(".data") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    kept = keep(spark.range(100_000).withColumn("k", F.col("id") % 1000).repartition(4, "k").groupBy("k").count(), "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and kept.count() == 1000


def test_passages_are_written_as_runs(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(["a", *words])), (2, " ".join(["b", *words, "c"])), (3, " ".join(["d", *words[:200], "e", *words[300:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(op01_paragraphs, "keep", lambda df, name: (written.append((name, keep(df, name))), written[-1][1])[1])
        got = op01_paragraphs.passages(op01_paragraphs._documents(docs, "doc_id", "text")).collect()
    assert sorted((r["doc_id"], r["first_word"], r["last_word"], r["removed"], r["first_doc_id"]) for r in got) == [(1, 1, 400, False, 1), (2, 1, 400, True, 1), (3, 1, 200, True, 1), (3, 202, 301, True, 1)]
    assert dict(written)["passages"].count() == 4


def test_rows_of_numbers_go_to_python_without_a_bound_on_bytes_and_lone_classes_are_not_grouped(spark, monkeypatch):
    from fieldspark.llm import store
    from fieldspark.session import BATCH_BYTES

    sizes, plans = {}, {}

    def kept(df, name, whole=store.keep):
        sizes[name], plans[name] = int(spark.conf.get(BATCH_BYTES).rstrip("b")), df._jdf.queryExecution().optimizedPlan().toString()
        return whole(df, name)

    monkeypatch.setattr(store, "keep", kept)
    monkeypatch.setattr(op01_paragraphs, "keep", kept)
    passage = " ".join(f"word{k}" for k in range(70))
    rows = spark.createDataFrame([(k, f"{passage} {k}") for k in range(4)] + [(9, " ".join(f"lone{k}" for k in range(40)))], "doc_id long, text string")
    found = op01_paragraphs.repeated_paragraphs(rows).collect()
    assert {r["doc_id"] for r in found} == {0, 1, 2, 3} and any(r["last_word"] - r["first_word"] == 69 for r in found)
    assert {sizes[n] for n in ("members", "places", "passages", "candidates")} == {2**31 - 1} and sizes["classes"] < 2**31 - 1
    grouped = plans["repeated"]
    assert "isnotnull(component" in grouped and "isnotnull(last" in grouped
