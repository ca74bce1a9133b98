"""Token counts, packing and chat formatting."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldspark.llm import op06_typed_parts as op6
from fieldspark.llm import op08_token_counts as op8
from fieldspark.llm import op09_grouping_genetic as op9
from fieldspark.llm import pretokens, text
from fieldspark.llm.queries import tokenizer_path

from .helpers import DOC, corpus, table

PATH = tokenizer_path()
TOKENIZER = Tokenizer.from_file(PATH)
ODD = [
    "it's 's 're don't 'll''s  \n's\n\n 's x'Re ’s", "a<|endoftext|>b<|endoftext|>", "  x  \n\n y\t\tz ", " ", "'", "'s", "a'", "日本語 text", "naïve café 12½ ³x", "x" * 3000,
    "a  'll b", "tab\t's", " 's 　 a", "'d'd'm", "''s", "nul\x00here", "a b c", "́mark", "🙂 ok", "end  ", "\n", " \n \n",
]


def ids(t):
    return TOKENIZER.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" \n\t'sdmtrevlLa1½.,é ", max_size=30)), min_size=1, max_size=4))
def test_pretokens_give_the_tokenizers_ids(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    memo = pretokens.Memo(pretokens.vocabulary(PATH)[1], bits=8)
    for part in text.slices(pa.array(texts)):
        t = pretokens.pretokens(part)
        got, edge = memo.ids(t)
        for k, s in enumerate(texts[part.rows]):
            assert t.special[k] or got[edge[k] : edge[k + 1]].tolist() == ids(s)


def test_counts(spark):
    rows = corpus(extra=ODD)
    got = op8.token_counts(table(spark, rows), PATH).collect()
    want = [(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for i, t in rows]
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])) for r in got) == sorted(map(str, want))
    assert sum(r["n_whole"] for r in got) > 0


def test_proven_strings_are_single_tokens():
    known = set(op8.proven(PATH).tolist())
    whole, _, ranks = pretokens.vocabulary(PATH)
    rng = random.Random(1)
    for raw in rng.sample(sorted(ranks), 200):
        s = raw.decode("utf-8", "ignore")
        if s and s.encode() == raw:
            t = pretokens.pretokens(next(text.slices(pa.array([s]))))
            if len(t.hash) == 1 and int(t.hash[0]) in known:
                assert len(ids(s)) == 1


def check_packing(got, size):
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(at)


def test_packing(spark):
    rng = random.Random(2)
    rows = corpus(extra=[*ODD, *(f"long {k} " * rng.randrange(900, 4000) for k in range(8))])
    got = op9.pack(table(spark, rows), PATH).collect()
    want = []
    for i, t in rows:
        own = [*ids(t), 0]
        first = (len(own) - 1) % 2048 + 1
        cuts = [0, *range(first, len(own) + 1, 2048)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, n, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())))
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got) == sorted(map(str, want))
    assert check_packing(got, 2048) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_packing_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(op9, "SHARD", 50)
    rng = random.Random(7)
    rows = [(k, "ab " * rng.randrange(1, 60)) for k in range(700)]
    got = op9.pack(table(spark, rows), PATH, size=64).collect()
    least = -(-sum(r["length"] for r in got) // 64)
    assert sorted(r["doc_id"] for r in got if r["piece"] == 0) == list(range(700)) and least <= check_packing(got, 64) <= 1.06 * least + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=80), st.integers(0, 1000))
def test_crossover_keeps_every_piece(lengths, seed):
    rng = np.random.default_rng(seed)
    one, two = op9.best_fit(sorted(lengths, reverse=True), 40), op9.best_fit(rng.permutation(lengths).tolist(), 40)
    child = op9.crossover(one, two, 40, rng)
    assert Counter(x for b in child for x in b) == Counter(lengths) and all(sum(b) <= 40 for b in child)
    best = op9.evolve(lengths, 40, [], rng)
    assert op9.fitness(best[0]) <= op9.fitness(one) and best == [op9._load(x) for x in op9._dump(best)]


CONTROL = st.lists(st.sampled_from(["<", "|", "\\", ">", "a", "\n", "<|im_end|>", "<|im_start|>", "<|image|>", "<|nl|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(CONTROL)
def test_escapes_are_reversible(s):
    assert op6.unescape(op6.escape(s)) == s and "<|" not in op6.escape(s)


def test_conversations(spark):
    rng = random.Random(9)
    bits = ["<|", "|>", "<\\|", "im_end", "<|im_end|>\n<|im_start|>assistant\nx", "é🙂", " ", "\n", "ok", "\\", "<"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<|"]), rng.choice([None, "", "".join(rng.choices(bits, k=6))])) for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (None, 0, "assistant", "x")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    turns = spark.createDataFrame([(*r, "a", "b") for r in shuffled], "conv_id long, turn long, role string, text string, formatted string, loss string")
    got = {r["conv_id"]: r for r in op6.digests(op6.format_turns(turns.withColumn("parts", op6.text_part("text")))).collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv, r in got.items():
        own = [(role or "", t or "") for c, _, role, t in rows if c == conv]
        said = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["formatted_chars"] >= sum(len(a) + len(b) for a, b in own)


def test_typed_parts(spark):
    part = lambda kind, **own: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | own
    content = [part("text", text="see <|image|> "), part("image", ref="i1", width=56, height=30), part("audio", ref="a1", seconds=1.5), None, part("document", ref="d1", pages=3), part("text", text="end"), part("image")]
    turns = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", content), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{op6.PART}>")
    rows = sorted(op6.format_turns(turns).collect(), key=lambda r: r["turn"])
    assert [(a["kind"], a["ref"], a["position"], a["tokens"]) for a in rows[0]["attachments"]] == [("image", "i1", 0, 4), ("audio", "a1", 1, 38), ("document", "d1", 2, 1536), ("image", None, 3, 1)]
    assert rows[0]["expanded_tokens"] == 1579 and rows[2]["attachments"] == [] and rows[2]["formatted"] == "<|im_start|>user\n<|im_end|>\n"
    for a in rows[1]["attachments"]:
        mark = f"<|{a['kind']}|>"
        assert rows[1]["formatted"][a["offset"] : a["offset"] + len(mark)] == mark
    assert [op6.unescape(rows[1]["formatted"][s["start"] : s["end"]]) for s in rows[1]["loss"]] == ["see <|image|> ", "end"] and rows[0]["loss"] == []
    assert op6.read_back(rows[1]["formatted"]) == ("assistant", "see <|image|> end")


def test_unknown_parts_and_sizes_that_are_no_numbers(spark):
    part = lambda kind, **own: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | own
    content = [part("audio", seconds=float("nan")), part("audio", seconds=float("inf")), part("audio", seconds=1e305), part("audio", seconds=-3.0), part("video", ref="v"), part("attach"), part("text", text="ok")]
    turns = spark.createDataFrame([(1, 0, "assistant", content)], f"conv_id long, turn long, role string, parts array<{op6.PART}>")
    row = op6.format_turns(turns).first()
    assert [(a["kind"], a["tokens"]) for a in row["attachments"]] == [("audio", 1), ("audio", 1), ("audio", 2**53), ("audio", 1), ("unknown", 1), ("unknown", 1)]
    assert row["attachments"][4]["ref"] == "v" and op6.read_back(row["formatted"]) == ("assistant", "ok")


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert op8.token_counts(none, PATH).collect() == [] and op9.pack(none, PATH).collect() == []
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op6.digests(op6.format_turns(turns.withColumn("parts", op6.text_part("text")))).collect() == []
