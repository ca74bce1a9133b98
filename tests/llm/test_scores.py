"""Quality rules, classifier, language model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldspark.llm import op03_divergence as op3
from fieldspark.llm import op05_fourier_quality as op5
from fieldspark.llm import op07_suffix_tree as op7

from .helpers import DOC, corpus, table, words

SF = "/root/testdata/sf0.01"


def base_rules(t):
    w = words(t, lower=False)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines, dup, seen = (t or "").split("\n"), 0, set()
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_base_rules_equal_brute_force(spark):
    rows = corpus(extra=["a b c\na b c\n\n \na b c \nx", "one # two|three\n", "line\r\nline\r\nline", "a b c " * 40, "é ü\n" * 60])
    got = op3.quality(table(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: str(tuple(r))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(key((r["doc_id"], *(r[f] for f in fields))) for r in got) == sorted(key((i, *base_rules(t))) for i, t in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_verdicts_agree_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = op3.quality(docs).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
    kept = op3.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


@pytest.mark.parametrize("sent", [op3.SENT, 0])
def test_rare_languages_have_their_own_reference(spark, monkeypatch, sent):
    monkeypatch.setattr(op3, "SENT", sent)
    rng = np.random.default_rng(5)
    text = lambda names, n: " ".join(names[k] for k in np.minimum(rng.geometric(0.05, n), len(names)) - 1)
    common, rare = [f"w{k}" for k in range(60)], ["".join(chr(0x3B1 + (7 * k + j * j) % 24) for j in range(2 + k % 5)) for k in range(60)]
    rows = [(k, text(common, 2000), "en", "x") for k in range(300)] + [(1000 + k, text(rare, 300), "el", "x") for k in range(4)] + [(2000, text(rare, 300), None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, ref string")
    got = {r["doc_id"]: r for r in op3.quality(docs).collect()}
    judged = [k for k, r in got.items() if not r["base_failed"]]
    assert len(got) == len(rows) and {1000, 1001, 1002, 1003, 2000} <= set(judged) and all(got[k]["kept"] for k in judged)
    assert sorted(r["doc_id"] for r in op3.keep_good(docs).collect()) == sorted(judged)


def test_distance_is_jensen_shannon():
    p, q = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0], [0.2, 0.3, 0.5]]), np.array([0.0, 0.0, 1.0])
    assert np.allclose(op3.distance(p, q)[:2], 1.0) and op3.distance(p, p[2])[2] == 0


def test_classifier_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = op5.classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["quality"], r["predicted"]) for r in rows if r["held_out"]]
    assert np.mean([q == p for q, p in held]) > 0.9


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").limit(400) for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({(r["doc_id"]): r["score"] for r in op5.classify(docs, x).collect()} for x in (labels, other))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_classifier_without_labels(spark):
    rows = corpus()
    got = op5.classify(table(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.5}


def test_isotonic_pools():
    x, y = op5.isotonic(np.arange(5.0), np.array([0, 3, 1, 4, 4]), np.array([4, 4, 4, 4, 4]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [0.0, 1.5, 3.5]


@pytest.mark.parametrize("hot", [op7.HOT, 0.02])
def test_language_model_counts_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(op7, "HOT", hot)
    rows = corpus()
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not out(i) for w in (*words(t), None))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        w = (*words(t), None)
        want.append((i, out(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    got = op7.scores(table(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got) == sorted(map(str, want))
    assert all(r["score"] < 0 for r in got)


def test_score_does_not_depend_on_what_is_broadcast(spark, monkeypatch):
    rows = [(i, t) for i, t in corpus() if i is not None]
    one = {(r["doc_id"], r["n_tokens"]): r["score"] for r in op7.scores(table(spark, rows)).collect()}
    monkeypatch.setattr(op7, "HOT", 0.02)
    two = {(r["doc_id"], r["n_tokens"]): r["score"] for r in op7.scores(table(spark, rows)).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-4 * abs(one[k]) for k in one)


def test_tree_states_are_distributions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id as id", "text").limit(300)
    tree = op7.grow(op7.context_counts(op7.word_counts(docs)))
    assert abs((10.0**tree.root).sum() - 1) < 1e-9 and len(tree.nodes) > 50
    for node in tree.nodes[:: max(1, len(tree.nodes) // 20)].tolist():
        depth = node >> 56
        context = [(node >> 8 * k) & 255 for k in range(depth - 1, -1, -1)]
        total = 0.0
        for symbol in range(256):
            logp, rest = 0.0, context
            while rest:
                key = len(rest) << 56 | int.from_bytes(bytes([*rest, symbol]), "big")
                at = np.searchsorted(tree.keys, np.uint64(key))
                if at < len(tree.keys) and tree.keys[at] == key:
                    logp += tree.logp[at]
                    break
                state = len(rest) << 56 | int.from_bytes(bytes(rest), "big")
                k = np.searchsorted(tree.nodes, np.uint64(state))
                if k < len(tree.nodes) and tree.nodes[k] == state:
                    logp += tree.back[k]
                rest = rest[1:]
            else:
                logp += tree.root[symbol]
            total += 10**logp
        assert 0.9 < total < 1.1  # a seen symbol's smoothing already holds its share of the suffix


def test_held_out_text_beats_shuffled_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400).select("doc_id", "text").toPandas()
    rng = np.random.default_rng(0)
    held = [(i, t) for i, t in zip(docs.doc_id, docs.text) if t and zlib.crc32(str(i).encode()) % 5 == 1][:20]
    mixed = [(10**6 + i, " ".join("".join(rng.permutation(list(w))) for w in t.split(" "))) for i, t in held]
    mixed = [(i, t) for i, t in mixed if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist())) + mixed
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in op7.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i - 10**6] > got[i] for i, _ in mixed)


def brute_force_score(rows, depth=2, seen=2):
    """Per row: log10 of the product over tokens of p(token | longest kept suffix) / p(token), from plain n-gram counts."""
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    run = lambda t: (None, *words(t), None)
    single = Counter(w for i, t in rows if not out(i) for w in run(t)[1:])
    n = sum(single.values())
    grams = [Counter(run(t)[k : k + d + 1] for i, t in rows if not out(i) for k in range(len(run(t)) - d)) for d in range(depth + 1)]
    grams[0] = Counter({(w,): c for w, c in single.items()})
    follow = [{} for _ in grams]
    for d in range(depth + 1):
        for g, c in grams[d].items():
            follow[d].setdefault(g[:-1], {})[g[-1]] = c
    follow[1:] = [{h: f for h, f in x.items() if sum(f.values()) >= seen} for x in follow[1:]]
    kept = [set() for _ in grams]
    for d in range(depth, 0, -1):
        for h, f in follow[d].items():
            up, total = follow[d - 1][h[1:]], sum(f.values())
            gain = sum(c * math.log(c * sum(up.values()) / (total * up[w])) for w, c in f.items())
            if 2 * gain > len(f) + 4 * math.sqrt(len(f)):
                kept[d].add(h)
        if d < depth:
            kept[d] |= {h[1:] for h in kept[d + 1]}
    some = [Counter(min(c, 3) for h, f in follow[d].items() for c in f.values()) for d in range(depth + 1)]
    for d in range(1, depth + 1):  # the discount is learned from all transitions of contexts that were looked at
        deep = [c for g, c in grams[d].items() if d == 1 or grams[d - 1][g[:-1]] >= seen]
        some[d] = Counter(min(c, 3) for c in deep)
    discount = [min(0.95, max(0.1, s[1] / (s[1] + 2 * s[2]))) if s[1] else 0.5 for s in some]
    return run, single, n, follow, kept, discount


@pytest.mark.parametrize("hot", [op7.HOT, 0.02])
def test_word_contexts_equal_brute_force(spark, monkeypatch, hot):
    rows = [(i, t) for i, t in corpus() if i is not None]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    run, single, n, follow, kept, discount = brute_force_score(rows)
    monkeypatch.setattr(op7, "WORD_DEPTH", 0)
    monkeypatch.setattr(op7, "grow_words", lambda docs, words: (words.selectExpr("key", "n", "0.0D as value"), []))
    monkeypatch.setattr(op7, "_sequences", lambda w, most, whole=op7._sequences: whole(w, 2))
    # held-out documents of one word give each word's own probability, spelling included
    spare = (i for i in range(10**6, 10**7) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = {next(spare): w for w in ["", *sorted({w for _, t in rows for w in words(t)})]}
    single_logp = {alone[r["doc_id"]]: r["score"] for r in op7.scores(table(spark, [*rows, *alone.items()])).collect() if r["doc_id"] in alone}
    logp = {w or None: x - (single_logp[""] if w else 0) for w, x in single_logp.items()}
    monkeypatch.undo()
    monkeypatch.setattr(op7, "HOT", hot)
    got = {r["doc_id"]: r["score"] for r in op7.scores(table(spark, rows)).collect()}

    def p(w, h, base):
        if not h:
            return base
        if h not in kept[len(h)]:
            return p(w, h[1:], base)
        f = follow[len(h)][h]
        total = sum(f.values())
        return max(f.get(w, 0) - discount[len(h)], 0) / total + discount[len(h)] * len(f) / total * p(w, h[1:], base)

    for i, t in rows:
        tokens = run(t)
        want = sum(math.log10(p(tokens[k], tokens[max(0, k - 2) : k], 10 ** logp[tokens[k]])) for k in range(1, len(tokens)))
        assert abs(got[i] - want) < 1e-5 * (1 + abs(want)), (i, got[i], want)
    assert kept[1] and kept[2]


def test_word_order_counts(spark):
    rng = np.random.default_rng(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).select("doc_id", "text").toPandas()
    learned = [(i, t) for i, t in zip(docs.doc_id, docs.text) if t and zlib.crc32(str(i).encode()) % 5 != 1]
    out = [i for i in range(10**6, 10**6 + 400) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows, pairs = [(int(i), t) for i, t in learned], []
    for k, (_, t) in enumerate(learned[: len(out) // 2]):
        one, two = out[2 * k], out[2 * k + 1]
        rows += [(one, t), (two, " ".join(rng.permutation(words(t))))]
        pairs.append((one, two))
    got = {r["doc_id"]: r["score"] for r in op7.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 20 and all(got[a] > got[b] + 1 for a, b in pairs if len(words(dict(rows)[a])) > 5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert op3.quality(none).collect() == [] and op3.keep_good(none).collect() == [] and op7.scores(none).collect() == []
    assert op5.classify(none, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect() == []


def test_counts_of_sequences_are_deleted_once_they_are_used(spark, monkeypatch):
    import os

    from fieldspark.session import shared_dir

    monkeypatch.setattr(op7, "GATHERED", 50)  # a task sends its sequences in many parts
    folder = shared_dir(spark).removeprefix("file://")
    left = lambda: {x for x in os.listdir(folder) if x.startswith(("transitions-", "level-"))}
    rows, before = [(i, t) for i, t in corpus() if i is not None], left()
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in op7.scores(table(spark, rows)).collect()}
    assert left() == before
    monkeypatch.undo()
    want = {(r["doc_id"], r["n_tokens"]): r["score"] for r in op7.scores(table(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * abs(want[k]) for k in want)


def test_only_a_part_of_the_tree_is_on_disk_at_once(spark, monkeypatch):
    rows, sizes, alive, most = [(i, t) for i, t in corpus() if i is not None], [], {}, []

    def keep(df, name, whole=op7.keep):
        written = whole(df, name)
        if name in ("transitions", "level"):
            sizes.append(written.count())
            alive[tuple(written.inputFiles())] = sizes[-1]
            most.append(sum(alive.values()))
        return written

    def forget(written, whole=op7.forget):
        alive.pop(tuple(written.inputFiles()), None)
        whole(written)

    monkeypatch.setattr(op7, "keep", keep)
    monkeypatch.setattr(op7, "forget", forget)
    assert op7.scores(table(spark, rows)).count() == len(rows) and not alive
    assert 0 < max(most) < 0.6 * sum(sizes)


def test_a_context_is_in_the_part_of_its_suffix():
    import pyarrow as pa

    from fieldspark.llm import text

    (some,) = text.slices(pa.array(["a b c a b d", "", "x", "b c b c a"]))
    w = text.words(some)
    whole = op7._sequences(w, 3)
    parts = [list(op7._of_part(whole, k)) for k in range(op7.ROUNDS)]
    for size in (0, 1):
        rows = [tuple(map(int, r)) for p in parts for r in zip(*p[size], strict=True)]
        assert sorted(rows) == sorted(tuple(map(int, r)) for r in zip(*whole[size], strict=True)) and len(rows) > 5
    for pairs, triples in parts:  # a triple's suffix is a pair whose context is the last token of the triple's context
        joined = set(op7._joined_key(pairs[1], pairs[2]).tolist())
        assert set(triples[2].tolist()) <= joined
