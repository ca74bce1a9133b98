"""Repeated passages by winnowing and window fingerprints, in place of a sparse suffix array.

Positions of documents are retained only at minimisers: of every ``LENGTH`` words the position whose ``PREFIX`` words
hash lowest. Equal stretches of that length retain the same position, so no repeat is missed, and one position in sixteen is.

1. The retained positions are sorted by the hash of their prefix over the whole corpus; one whose prefix no neighbour shares cannot be
   part of a repeat and goes.
2. All stretches of ``LENGTH`` words whose minimiser the others are get a 64-bit hash, and these are sorted
   by hash, then place, and compared with their neighbour: all but the first place of a stretch are repeats.
3. A document's repeats are joined into maximal passages.

Both sorts are range partitioned on content and place, so a passage that a third of all documents holds is spread out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import bloom, text
from fieldspark.llm.neighbours import later, settle, shared
from fieldspark.llm.store import keep, keep_numbers, neutral

LENGTH, PREFIX = 50, 20
_LOW = np.uint64((1 << 24) - 1)


def minimisers(w: text.Words, length: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all stretches of ``length`` words inside documents, the minimiser of each, and the prefix hash at every word."""
    g = text.grams(w.hash, prefix)
    n = len(w.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    low = (g & ~_LOW) | (np.arange(len(g), dtype=np.uint64) & _LOW)  # the leftmost of equal prefixes
    span, size = length - prefix + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    doc = w.doc
    start = np.flatnonzero(doc[:n] == doc[length - 1 :])
    at = (low[start] & _LOW).astype(np.int64)
    at += start >> 24 << 24  # positions are known modulo 2**24
    at[at < start] += 1 << 24
    return start, at, g


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that repeat both id and text are one document: ``row`` is a hash of the two."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where(F.col("text").isNotNull()).withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text"))


def candidate_stretches(rows: DataFrame, length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """``stretch, doc_id, row, start`` (written) of ``doc_id, text, row``: every stretch of ``length`` words that another place may hold too, none missed."""
    rows = rows.where(F.length("text") >= 2 * length - 1)

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            for part in text.slices(batch.column(1)):
                w = text.words(part)
                _, at, g = minimisers(w, length, prefix)
                at = np.unique(at)
                yield pa.record_batch({"prefix": text.signed(g[at]), "row": row[part.rows][w.doc[at]], "position": (at - w.first[w.doc[at]]).astype(np.int32)})

    suffixes = keep(rows.select("row", "text").mapInArrow(retain, "prefix long, row long, position int"), "suffixes")
    candidates = keep_numbers(shared(suffixes, "prefix", "row", "position").groupBy("row").agg(F.collect_list("position").alias("positions")), "candidates")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc = batch.column(0).to_numpy(), batch.column(1)
            positions = batch.column(3)
            for part in text.slices(batch.column(2)):
                w = text.words(part)
                start, at, _ = minimisers(w, length, prefix)
                some = positions[part.rows]
                wanted = some.flatten().to_numpy() + np.repeat(w.first[:-1], some.value_lengths().to_numpy())
                start = start[np.isin(at, wanted)]
                own = w.doc[start]
                yield pa.record_batch(
                    {
                        "stretch": text.signed(text.grams(w.hash, length)[start]) if len(start) else np.zeros(0, np.int64),
                        "doc_id": doc[part.rows].take(pa.array(own)),
                        "row": row[part.rows][own],
                        "start": (start - w.first[own]).astype(np.int32),
                    }
                )

    some = bloom.maybe(rows, "row", bloom.build(candidates.select("row"))).where("_maybe")
    whole = some.join(candidates, "row").dropDuplicates(["row"]).select("row", "doc_id", "text", "positions")
    return keep(whole.mapInArrow(extend, "stretch long, doc_id long, row long, start int"), "stretches")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """``doc_id, row, spans``: for each document with repeats its maximal passages ``start, end`` in words.

    A stretch of ``length`` words (A-Z lower-cased) is a repeat if it also stands at an earlier place, by doc_id (null first), then
    a hash of id and text, then position; a passage is a maximal union of overlapping or touching repeats. Null, empty and shorter texts have none.
    Rows that repeat id and text count once; rows that repeat only the id are different documents. No rows give no rows.
    """
    stretches = candidate_stretches(_rows(docs, id_col, text_col), length, prefix)
    marked = keep(later(stretches, "stretch", "doc_id", "row", "start"), "marked")
    found = settle(marked, "stretch").groupBy("row", "doc_id").agg(F.array_sort(F.collect_set("start")).alias("starts"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for starts in batch.column(2):
                s = starts.values.to_numpy()
                cut = np.flatnonzero(np.diff(s) > length)
                first, last = s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]] + length
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(first, last, strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch({"doc_id": batch.column(1), "row": batch.column(0), "spans": pa.array(spans, kind)})

    return found.mapInArrow(unite, "doc_id long, row long, spans array<struct<start:int,end:int>>")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated passages: their words and the white space after each are cut out of the texts.

    Texts without repeats, null texts and the other columns stay as they are; ``chars_col`` gets the new length of a cut text.
    A text that is one repeat becomes empty; its row stays. Rows that repeat id and text are one place and are cut alike. Other
    columns may have any names.
    """
    names = docs.columns
    docs, (id_col, text_col, chars_col) = neutral(docs, id_col, text_col, chars_col)
    spans = keep(repeats(docs, id_col, text_col, length).select(F.col("row").alias("_row"), F.col("spans").alias("_spans")), "spans")
    keyed = docs.withColumn("_row", F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.col(text_col).cast("string")))
    flagged = bloom.maybe(keyed, "_row", bloom.build(spans.select("_row")))
    joined = flagged.where("_maybe").join(spans, "_row", "left")
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(columns))
            texts = batch.column(columns.index(text_col)).to_pylist()
            chars = batch.column(columns.index(chars_col)).to_pylist() if chars_col in columns else None
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                data = np.frombuffer(texts[i].encode("utf-8", "replace"), np.uint8)
                part = text.Slice(slice(0, 1), data, np.array([0, len(data)]))
                start = np.append(text.words(part).start, len(data))
                stay, at = [], 0
                for s in spans[i].as_py():
                    stay.append(data[at : start[s["start"]]])
                    at = int(start[s["end"]])
                stay.append(data[at:])
                texts[i] = np.concatenate(stay).tobytes().decode("utf-8", "replace")
                if chars is not None:
                    chars[i] = len(texts[i])
            new = {columns.index(text_col): texts} | ({columns.index(chars_col): chars} if chars is not None else {})
            arrays = [pa.array(new[k], batch.column(k).type) if k in new else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    same = [f"`{c}`" for c in columns]
    return flagged.where("not _maybe").select(same).unionByName(joined.select(*same, "_spans").mapInArrow(cut, docs.schema)).toDF(*names)
