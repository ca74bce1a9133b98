"""Benchmark decontamination by spaced-seed hashing.

A document overlaps an item where ``SPAN`` successive words of both, or the whole of a shorter item, differ in at most three
words of sixteen, word against word (A-Z lower-cased). Seeds find the places: each mask hashes five words and ignores those in
between, so a substitution there does no harm. The two masks are lossless: whichever three of sixteen words (or the share of
a shorter item) differ, one mask fits in between; ``tests/llm`` tries every case. Around each common seed the words are then
compared, and only overlaps that hold are returned.

The benchmark goes to the tasks in blocks of at most ``BLOCK`` words, a pass over the documents for each, so its size is
always bounded where it is sent, and documents never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import text
from fieldspark.llm.store import keep

MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
SPAN, SUBSTITUTIONS, SHORTEST = 16, 3, 8
BLOCK = 1 << 19  # words of benchmark items sent at once
PIECE = 4096  # longer items are cut into pieces that overlap by a span
AT_ONCE = 1 << 17  # places compared at once
_BITS = 22


@dataclass
class Block:
    """Benchmark pieces as word hashes, and the sorted seeds of each mask with their places."""

    items: list
    words: np.ndarray
    first: np.ndarray
    seeds: list[np.ndarray]
    places: list[np.ndarray]
    filters: list[np.ndarray]


def seed_hashes(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the words that ``mask`` looks at, at every place where it fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, at in enumerate(mask):
        total += h[at : at + n] * np.uint64(2 * k * k * 0x9E3779B9 + 0x632BE59BD9B4E019)
    return text.mix(total)


def _within(first: np.ndarray, total: int, size: int) -> np.ndarray:
    """Places where ``size`` words lie in one document."""
    stop = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(total) + size <= stop)


def prepare(pieces: list[tuple[object, np.ndarray]]) -> Block:
    first = np.cumsum([0, *(len(h) for _, h in pieces)])
    h = np.concatenate([h for _, h in pieces]) if pieces else np.zeros(0, np.uint64)
    seeds, places, filters = [], [], []
    for mask in MASKS:
        at = _within(first, len(h), mask[-1] + 1)
        s = seed_hashes(h, mask)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(s, kind="stable")
        seeds.append(s[order])
        places.append(at[order])
        bits = np.zeros(1 << _BITS, bool)
        bits[s >> np.uint64(64 - _BITS)] = True
        filters.append(bits)
    return Block([i for i, _ in pieces], h, first, seeds, places, filters)


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Broadcast]:
    """The benchmark as broadcast blocks of bounded size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch.column(1)):
                w = text.words(part)
                rows = []
                for k, item in enumerate(batch.column(0)[part.rows].to_pylist()):
                    own = w.hash[w.first[k] : w.first[k + 1]]
                    if len(own) >= SHORTEST:
                        rows += [(item, text.signed(own[a : a + PIECE])) for a in range(0, max(1, len(own) - SPAN + 1), PIECE - SPAN + 1)]
                yield pa.record_batch({"item_id": pa.array([r[0] for r in rows], pa.int64()), "words": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "n": pa.array([len(r[1]) for r in rows], pa.int64())})

    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "item_id long, words array<long>, n long")
    rows = keep(rows.dropDuplicates(["item_id", "words"]).withColumn("deal", F.xxhash64("item_id", "words")), "benchmark")
    total = rows.agg(F.sum("n")).first()[0] or 0
    count = -(-2 * total // BLOCK) if total > BLOCK else 1
    while count > 1 and rows.groupBy(F.pmod("deal", F.lit(count))).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > BLOCK:
        count *= 2
    for k in range(count):
        found = rows.where(F.pmod("deal", F.lit(count)) == k).select("item_id", "words").orderBy("item_id", "words").collect()
        yield spark.sparkContext.broadcast(prepare([(r["item_id"], np.array(r["words"], np.int64).view(np.uint64)) for r in found]))


def overlaps(part: text.Slice, block: Block) -> dict[tuple[int, int], tuple[int, int]]:
    """(document, piece) to the most equal words of a span, and that span's first word in the document."""
    w = text.words(part)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for mask, seeds, places, bits in zip(MASKS, block.seeds, block.places, block.filters, strict=True):
        if not len(seeds):
            continue
        s = seed_hashes(w.hash, mask)
        at = np.flatnonzero(bits[s >> np.uint64(64 - _BITS)])
        lo = np.searchsorted(seeds, s[at], "left")
        n = np.searchsorted(seeds, s[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        inside = np.searchsorted(w.first, at, "right") == np.searchsorted(w.first, at + mask[-1], "right")
        at, lo, n = at[inside], lo[inside], n[inside]
        upto = np.concatenate([[0], np.cumsum(n)])
        for begin in range(0, int(upto[-1]), AT_ONCE):
            hit = np.arange(begin, min(begin + AT_ONCE, int(upto[-1])))
            k = np.searchsorted(upto, hit, "right") - 1
            _compare(w, block, at[k], places[lo[k] + hit - upto[k]], best)
    return best


def _compare(w: text.Words, block: Block, at: np.ndarray, place: np.ndarray, best: dict) -> None:
    """Compare the words around common seeds; a span may lie anywhere over the seed."""
    doc = np.searchsorted(w.first, at, "right") - 1
    piece = np.searchsorted(block.first, place, "right") - 1
    span = np.minimum(SPAN, block.first[piece + 1] - block.first[piece])
    steps = np.arange(-SPAN + 1, 2 * SPAN)
    x, y = at[:, None] + steps, place[:, None] + steps
    valid = (x >= w.first[doc][:, None]) & (x < w.first[doc + 1][:, None]) & (y >= block.first[piece][:, None]) & (y < block.first[piece + 1][:, None])
    equal = valid & (w.hash[np.clip(x, 0, len(w.hash) - 1)] == block.words[np.clip(y, 0, len(block.words) - 1)])
    sums, there = (np.concatenate([np.zeros((len(at), 1), np.int64), np.cumsum(m, axis=1)], axis=1) for m in (equal, valid))
    for size in np.unique(span).tolist():
        rows = np.flatnonzero(span == size)
        got = np.where(there[rows, size:] - there[rows, :-size] == size, sums[rows, size:] - sums[rows, :-size], -1)
        most = got.argmax(axis=1)
        equal_words = got[np.arange(len(rows)), most]
        for r, m, e in zip(rows[good := equal_words >= size - size * SUBSTITUTIONS // SPAN], most[good], equal_words[good], strict=True):
            key, start = (int(doc[r]), int(piece[r])), int(at[r] + steps[m] - w.first[doc[r]])
            old = best.get(key)
            if old is None or (-e, start) < (-old[0], old[1]):
                best[key] = (int(e), start)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, matches, first_word``: a row for every document and item that overlap.

    ``matches``: the most equal words of an overlapping span; ``first_word``: the earliest such span's place in the document.
    Items of fewer than ``SHORTEST`` words, null and empty texts overlap nothing. Rows that repeat an id count as one; a null id
    is an id of its own. Other columns are ignored; no documents or items give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for shared in blocks(benchmark, item_col, item_text):

        def search(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                ids = batch.column(0)
                for part in text.slices(batch.column(1)):
                    best = overlaps(part, block)
                    if best:
                        own = ids[part.rows].to_pylist()
                        out = [(own[d], block.items[p], e, s) for (d, p), (e, s) in sorted(best.items())]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "item_id", "matches", "first_word"])

        some = rows.mapInArrow(search, "doc_id long, item_id long, matches long, first_word long")
        found = some if found is None else found.unionByName(some)
    best = F.max(F.struct("matches", (-F.col("first_word")).alias("place"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.matches", (-F.col("best.place")).alias("first_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no item, in one pass for each block of the benchmark.

    Null and empty texts overlap nothing and stay, as do all rows where the benchmark is empty; equal rows are judged alike; other
    columns may have any names.
    """
    at = docs.columns.index(text_col)
    for shared in blocks(benchmark, item_col, item_text):

        def search(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for part in text.slices(batch.column(at)):
                    clean[[part.rows.start + d for d, _ in overlaps(part, shared.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(search, docs.schema)
    return docs
