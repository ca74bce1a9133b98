"""Two-tier byte-level BPE against the library, and back."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldspark.llm import op12_two_tier_bpe as op12
from fieldspark.llm import text
from fieldspark.llm.queries import tokenizer_path

from .helpers import DOC, corpus, table
from .test_tokens_and_chat import ODD

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")
RANKS = op12.ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = op12.Vocabulary(RANKS)
MORE = [*ODD, "日本語のテキスト。 漢字 ", "한국어 텍스트 123", "emoji 🙂🙃  x", "\x1c\x1d a\x85b", "̀́ x", "𝒳𝒴 ١٢٣ ⅷ", "'re'RE 'll've", "' s", "'", "''''s", "a" * 700 + "'s", "\r\n\r\n x", " 　 y"]


def library(t):
    return LIBRARY.encode_ordinary(t or "")


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 5, 1000):
        keys = op12.mix(np.arange(1, n + 1, dtype=np.uint64))
        assert sorted(op12.PerfectHash(keys)(keys).tolist()) == list(range(n))
    assert len(WORDS.key) == len(RANKS) and WORDS.entries() == RANKS


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\t'sdmtrevlLa1½.,é日🙂　\x1c", max_size=40)), min_size=1, max_size=5))
def test_encode_equals_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    encoder = op12.Encoder(WORDS, op12.classes())
    for part in text.slices(pa.array(texts), 60):
        ids, first = encoder.encode(part)
        for k, t in enumerate(texts[part.rows]):
            assert ids[first[k] : first[k + 1]].tolist() == library(t)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_heap_merge_equals_the_library(piece):
    if piece not in RANKS:
        assert op12.merge(piece, RANKS) == LIBRARY._core_bpe.encode_single_piece(piece)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=" ab'\n　é", max_size=200), st.integers(1, 20))
def test_cuts_are_edges_of_pretokens(t, size):
    raw = np.frombuffer(t.encode(), np.uint8)
    ends = op12.cuts(raw, size)
    assert ends[-1] == len(raw) and ends == sorted(ends)
    pieces = [raw[a:b].tobytes().decode() for a, b in zip([0, *ends[:-1]], ends)]
    assert sum((library(p) for p in pieces), []) == library(t)


@pytest.mark.parametrize("size", [text.SLICE, 400])
def test_digests(spark, monkeypatch, size):
    rng = random.Random(4)
    rows = corpus(extra=[*MORE, "long " * 400_000, "x" * 60_000, " ".join(f"q{rng.randrange(10**9)}" for _ in range(3000))])
    if size < text.SLICE:
        monkeypatch.setattr(text, "SLICE", size)  # in this process only
        encoder = op12.Encoder(WORDS, op12.classes())
        for _, t in rows:
            raw = np.frombuffer((t or "").encode(), np.uint8)
            ends = op12.cuts(raw, size)
            parts = [encoder.encode(text.Slice(slice(0, 1), raw[a:b], np.array([0, b - a])))[0] for a, b in zip([0, *ends[:-1]], ends)]
            assert np.concatenate(parts).tolist() == library(t)
        return
    got = op12.digests(op12.decode(op12.encode(table(spark, rows), PATH), PATH)).collect()
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = [(i, len(library(t)), sha(np.array(library(t), "<u4").tobytes()), sha((t or "").encode())) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_no_rows(spark):
    assert op12.digests(op12.decode(op12.encode(spark.createDataFrame([], DOC), PATH), PATH)).collect() == []
