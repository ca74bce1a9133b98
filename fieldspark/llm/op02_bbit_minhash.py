"""Near-duplicate documents by b-bit MinHash.

Each document's shingle set gets 256 minima under fixed permutations. Full minima in bands of six give the candidates;
of every minimum the lowest four bits are packed into a 128-byte signature. A candidate's similarity is estimated from the
number of equal signature values, corrected for values that agree by chance, and clear misses are dropped. Links are then
confirmed on the full sets of the whole texts.

A pair of similarity 0.8 shares no band with probability (1 - 0.8**6)**42 = 3e-6, and its estimate falls below the
pruning limit (0.13 under the threshold, five standard deviations) even less often.

Documents with equal shingle sets collapse to their smallest id before any bucket is formed, so groups of copies of any
size are one item; groups of near copies are linked as in ``links``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import bloom, links, text
from fieldspark.llm.neighbours import shared
from fieldspark.llm.store import keep, neutral

BANDS, ROWS, BITS, MINIMA = 42, 6, 4, 256
MARGIN = 0.13
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, (MINIMA, 1), np.uint32, endpoint=False)
_MULTIPLY = _RNG.integers(0, 1 << 32, (MINIMA, 1), np.uint32, endpoint=False) | np.uint32(1)
_BAND = text.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)
_EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The 256 minima of a shingle set of any size, in bounded memory."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        y = x[None, at : at + 1024] ^ _XOR
        y *= _MULTIPLY
        np.minimum(low, y.min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """One hash for each band of every row of minima."""
    return text.mix((low[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64))


def pack(low: np.ndarray) -> np.ndarray:
    """The low four bits of every minimum, two in a byte."""
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return bits[:, ::2] << 4 | bits[:, 1::2]


def estimate(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Jaccard estimates from packed signatures, without the agreement that chance gives."""
    equal = _EQUAL[sig ^ others].sum(axis=-1, dtype=np.int64) / MINIMA
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, n, set, bands, sig`` of every row; empty texts have no set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for part in text.slices(batch.column(1)):
                w = text.words(part)
                sets = [text.shingles(w.hash[a:b], size) for a, b in zip(w.first, w.first[1:], strict=False)]
                low = np.stack([minima(s) for s in sets])
                keys, packed = text.signed(bands(low)), pack(low)
                whole = np.array([text.mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0] if len(s) else 0 for s in sets], np.uint64)
                none = np.array([not len(s) for s in sets])
                yield pa.record_batch(
                    {
                        "id": ids[part.rows],
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "set": pa.array(text.signed(whole), mask=none),
                        "bands": pa.array([None if e else k for k, e in zip(keys, none, strict=True)], pa.list_(pa.int64())),
                        "sig": pa.array([None if e else p.tobytes() for p, e in zip(packed, none, strict=True)], pa.binary()),
                    }
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sign, "id long, n long, set long, bands array<long>, sig binary")


def _texts(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return bloom.semi(rows, "id", ids)


def full_sets(docs: DataFrame, id_col: str, text_col: str, size: int, ids: DataFrame) -> DataFrame:
    """``id, shingles`` (the sorted distinct hashes) of the whole texts of the given ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch.column(1)):
                w = text.words(part)
                sets = [text.shingles(w.hash[a:b], size) for a, b in zip(w.first, w.first[1:], strict=False)]
                some = pa.array([bool(len(s)) for s in sets], pa.bool_())
                yield pa.record_batch({"id": batch.column(0)[part.rows], "shingles": pa.array([s.tobytes() for s in sets], pa.binary())}).filter(some)

    return _texts(docs, id_col, text_col, ids).mapInArrow(read, "id long, shingles binary")


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` (a written table) whose full shingle sets have 100 * intersection >= percent * union."""
    needed = keep(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().select(F.col("a").alias("id")), "ids")
    texts = keep(_texts(docs, id_col, text_col, needed), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            a, b = text.column(batch, "a").to_pylist(), text.column(batch, "b").to_pylist()
            left, right = text.column(batch, "text_a"), text.column(batch, "text_b")
            good = []
            for part in text.slices(right):
                w = text.words(part)
                for k, i in enumerate(range(part.rows.start, part.rows.stop)):
                    if last is None or left[i].as_py() != last:
                        last = left[i].as_py()
                        one = text.words(next(text.slices(pa.array([last]))))
                        last_set = text.shingles(one.hash, size)
                    own = text.shingles(w.hash[w.first[k] : w.first[k + 1]], size)
                    if not len(own) or not len(last_set):
                        continue
                    at = np.minimum(np.searchsorted(last_set, own), len(last_set) - 1)
                    both = int((last_set[at] == own).sum())
                    if 100 * both >= percent * (len(own) + len(last_set) - both):
                        good.append(i)
            yield pa.record_batch({"a": pa.array([a[i] for i in good], pa.int64()), "b": pa.array([b[i] for i in good], pa.int64())})

    one, two = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, links.PAIRS).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: a row for every row of ``docs``.

    The component is the smallest id reachable over links of ``threshold`` or more on ``size``-word shingles.
    Null and empty texts have no shingles and no links. Rows that repeat an id are one document: their texts' links all
    count. A row without an id keeps to itself: null component, kept. Other columns are ignored; no rows give no rows.
    """
    percent = round(threshold * 100)
    rows = keep(signatures(docs, id_col, text_col, size), "signatures")
    known = rows.where("n > 0 and id is not null")
    classes = known.groupBy("set").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = keep(classes, "classes")
    members = keep(links.bucket_members(shared(classes.select(F.explode("bands").alias("key"), "id"), "key", "id")), "members")
    sigs = classes.select("id", "bands", "sig")
    limit = threshold - MARGIN

    def likely(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
        return estimate(sig, others) >= limit

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(text.column(batch, c).to_pylist()), np.uint8).reshape(-1, MINIMA * BITS // 8) for c in ("sig_a", "sig_b"))
            good = pa.array(estimate(one, two) >= limit)
            yield batch.select(["a", "b"]).filter(good)

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = (sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
        near = pairs.join(two, "b").join(one, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(prune, links.PAIRS)
        return confirm(keep(near.distinct(), "near"), docs, id_col, text_col, size, percent)

    of_set = classes.select("set", F.col("id").alias("node"))
    repeated = known.groupBy("id").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo < hi").select("id")
    same_id = known.join(repeated, "id").join(of_set, "set").select(F.col("node").alias("a"), F.col("id").alias("b"))
    linked = links.all_links(members, sigs, likely, verify, lambda ids: full_sets(docs, id_col, text_col, size, ids), percent, same_id)
    of_set = of_set.join(linked, "node", "left").select("set", F.coalesce("component", "node").alias("component_id"))
    out = rows.join(of_set, "set", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the near duplicates: of each group the smallest id stays.

    Rows that repeat an id are one document and stay or go together. Rows without an id stay, exact copies included.
    Null and empty texts are linked with nothing; other columns may have any names.
    """
    names = docs.columns
    docs, (id_col, text_col) = neutral(docs, id_col, text_col)
    gone = near_duplicates(docs, id_col, text_col, size, threshold).where("not kept").select("doc_id").distinct()
    keyed = docs.withColumn("_key", F.col(id_col).cast("long"))
    return bloom.anti(keyed, "_key", keep(gone, "gone")).drop("_key").toDF(*names)
