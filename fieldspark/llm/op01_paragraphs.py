"""Repeated paragraphs by MinHash banding.

Texts are cut into paragraphs: at line feeds, and longer lines at words whose hash is the lowest within ``REACH`` words on both
sides, so a passage is cut alike wherever it stands; such pieces of fewer than ``SHORTEST`` words are not looked at. Whole lines of
``SIZE`` words or more are paragraphs too, beside their pieces, and are compared with other lines only.

Equal shingle sets (five words) are one class, formed before anything is compared, so a paragraph in a third of all documents
is one item. Each class is banded once a task, by two minima a band: those of more than ``SHORT`` shingles have 24 minima in twelve bands, and a pair of similarity
0.8 is missed with probability 0.000005; shorter ones take as bands the pairs of their lowest shingles, as many as none needs to be missed (see ``band_keys``). Classes that collide
are verified by exact Jaccard similarity (0.8 or more), and components of verified pairs say which paragraphs repeat another: all but the first place of a component are removed.

A passage inside a longer line need not hold a whole paragraph. So every stretch of 50 words that stands at two places is found as
well (``op04``'s stretches at minimisers, which miss none), and its touching stretches are joined: such passages come out whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import bloom, links, text
from fieldspark.llm.graph import components
from fieldspark.llm.neighbours import first_places, shared
from fieldspark.llm.op04_sparse_suffixes import LENGTH, candidate_stretches
from fieldspark.llm.store import BATCH, NUMBERS, keep, keep_numbers, narrow
from fieldspark.session import batches_by_rows

REACH, SHORTEST, SIZE, THRESHOLD = 6, 7, 5, 80
BANDS, ROWS = 12, 2
SHORT = 24  # shingles of a set whose bands are pairs of its lowest ones; at most 15
ALONE = 3  # a set of so few has similarity 0.8 with no other
SENT = 20  # bits of a task's table of the classes it has banded
SIGNED = 16  # minima of which four bits are kept
LIKELY = 3 / 8  # of those; a pair of similarity 0.8 has fewer with probability 0.00002
_LINE = np.uint64(0xD1B54A32D192ED03)
_RNG = np.random.default_rng(1907)
_XOR, _MULTIPLY = (_RNG.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) for _ in range(2))
_MULTIPLY |= np.uint64(1)


def cut(part: text.Slice, w: text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every piece and of every line of a slice, and the words' own count as last entry of both; documents begin new ones."""
    n = len(w.hash)
    start = np.zeros(n + 1, bool)
    start[w.first[:-1][np.diff(w.first) > 0]] = True
    start[n] = True
    breaks = np.flatnonzero(part.data == 0x0A)
    start[np.searchsorted(w.start, breaks)] = True
    span = 2 * REACH + 1
    line, lines = np.cumsum(start[:n]), np.flatnonzero(start)
    if n >= span:  # a window over a line's edge has no lowest word, so whole lines are cut alike everywhere
        low, size = w.hash, 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        centre = np.arange(REACH, REACH + len(low))
        start[centre[(w.hash[centre] == low) & (line[centre - REACH] == line[centre + REACH])]] = True
    return np.flatnonzero(start), lines, w.doc


@dataclass
class Paragraphs:
    """Pieces, then lines, that are long enough: document, first word and end of each, and whether it is a line; the words, and the shingle hash at every word."""

    words: text.Words
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    line: np.ndarray
    g: np.ndarray


def paragraphs(part: text.Slice) -> Paragraphs:
    w = text.words(part)
    pieces, lines, doc = cut(part, w)
    first, last = np.concatenate([pieces[:-1], lines[:-1]]), np.concatenate([pieces[1:], lines[1:]])
    line = np.arange(len(first)) >= len(pieces) - 1
    good = last - first >= np.where(line, SIZE, SHORTEST)
    first, last, line = first[good], last[good], line[good]
    return Paragraphs(w, doc[first] if len(first) else first, first, last, line, text.grams(w.hash, SIZE))


def _sets(p: Paragraphs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all paragraphs, one after another and sorted; where each begins (one more entry); hash of each set. Lines have other shingles than pieces."""
    n = p.last - p.first - SIZE + 1
    owner = np.repeat(np.arange(len(n)), n)
    flat = p.g[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + p.first[owner]] ^ np.where(p.line, _LINE, np.uint64(0))[owner]
    order = np.argsort(flat)
    if len(n) < 1 << 16:  # a stable sort of short numbers takes linear time
        order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(owner[order], kind="stable")]
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    flat, owner = flat[new], owner[new]
    upto = np.searchsorted(owner, np.arange(len(n) + 1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(flat, dtype=np.uint64)])
    size = np.diff(upto)
    return flat, upto, text.mix(np.diff(total[upto]) + size.astype(np.uint64)) if len(n) else np.zeros(0, np.uint64)


def _minima(flat: np.ndarray, upto: np.ndarray) -> np.ndarray:
    if len(upto) < 2:
        return np.zeros((0, BANDS * ROWS), np.uint64)
    return np.column_stack([np.minimum.reduceat((flat ^ x) * m >> np.uint64(16), upto[:-1]) for x, m in zip(_XOR, _MULTIPLY, strict=True)])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that repeat both id and text are one document: ``row`` is a hash of the two."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where(F.length("text") >= 2 * SIZE - 1).withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text"))


def classes(docs: DataFrame) -> DataFrame:
    """``id, place, last``: a row per distinct shingle set; its first place, and its last one if there are several, by doc_id (null first), row and word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(1).to_numpy()
            for part in text.slices(batch.column(2)):
                p = paragraphs(part)
                _, _, ids = _sets(p)
                yield pa.record_batch(
                    {
                        "id": text.signed(ids),
                        "doc_id": batch.column(0)[part.rows].take(pa.array(p.doc)),
                        "row": row[part.rows][p.doc],
                        "first_word": (p.first - p.words.first[p.doc]).astype(np.int32),
                    }
                )

    rows = docs.select("doc_id", "row", "text").mapInArrow(sign, "id long, doc_id long, row long, first_word int")
    place = F.struct("doc_id", "row", "first_word")
    found = rows.groupBy("id").agg(F.min(place).alias("place"), F.max(place).alias("last"))
    return found.withColumn("last", F.when(~F.col("last").eqNullSafe(F.col("place")), F.col("last")))


def band_keys(flat: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands of sets (``_sets``): for each the number of its set, and its key.

    Sets that share THRESHOLD percent of their union share as much of each alone. So of ``n`` shingles all but ``n - need`` are common, and the two lowest common ones
    are among the set's lowest ``n - need + 2``: the pairs of these meet in every such partner. Sets of more than SHORT shingles have bands of minima, and so
    have sets that are large enough to be like one of them.
    """
    n = np.diff(upto)
    low = n - -(-THRESHOLD * n // 100) + 2
    own, keys = [], []
    for j in range(1, int(low[n <= SHORT].max(initial=0))):
        some = np.flatnonzero((n > ALONE) & (n <= SHORT) & (low > j))
        for i in range(j):
            own.append(some)
            keys.append(text.mix(flat[upto[some] + i] * np.uint64(0x9FB21C651E98DF25) + flat[upto[some] + j]))
    some = np.flatnonzero(100 * n >= THRESHOLD * (SHORT + 1))
    if len(some):
        size = n[some]
        ends = np.concatenate([[0], np.cumsum(size)])
        minima = _minima(flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - upto[some], size)], ends)
        factors = text.mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        bands = text.mix((minima.reshape(-1, BANDS, ROWS) * factors).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        own.append(np.repeat(some, BANDS))
        keys.append(bands.ravel())
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(own), np.concatenate(keys) >> np.uint64(16)


def banded(docs: DataFrame) -> DataFrame:
    """``key, id``: the bands of every class. A task sends a class once, or again if others have taken its place in a table of fixed size."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(1 << SENT, np.uint64)
        for batch in batches:
            for part in text.slices(batch.column(0)):
                flat, upto, ids = _sets(paragraphs(part))
                own, keys = band_keys(flat, upto)
                slot = ids >> np.uint64(64 - SENT)
                first = np.zeros(len(ids), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                first &= sent[slot] != ids
                sent[slot] = ids
                fresh = first[own]
                yield pa.record_batch({"key": text.signed(keys[fresh]), "id": text.signed(ids[own[fresh]])})

    return docs.select("text").mapInArrow(band, "key long, id long")


def _of_classes(docs: DataFrame, wanted: DataFrame, name: str, make: Callable[[np.ndarray, np.ndarray], list[bytes]]) -> DataFrame:
    """``id`` and what ``make`` gives of the sets of the ``wanted`` classes (``id, row``), from the documents that hold their first place."""
    wanted = keep(wanted.groupBy("row").agg(F.collect_set("id").alias("ids")), "wanted")
    some = bloom.maybe(docs.select("row", "text"), "row", bloom.build(wanted.select("row"))).where("_maybe")
    rows = some.join(wanted, "row").select("text", "ids")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch.column(0)):
                flat, upto, ids = _sets(paragraphs(part))
                ids = text.signed(ids)
                take = np.isin(ids, batch.column(1)[part.rows].flatten().to_numpy())
                yield pa.record_batch({"id": ids, name: pa.array(make(flat, upto), pa.binary())}).filter(pa.array(take))

    return rows.mapInArrow(read, f"id long, {name} binary").groupBy("id").agg(F.first(name).alias(name))


def shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, shingles`` of the ``wanted`` classes (``id, row``)."""
    return _of_classes(docs, wanted, "shingles", lambda flat, upto: [flat[a:b].tobytes() for a, b in zip(upto, upto[1:], strict=False)])


def signatures_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, sig`` of the ``wanted`` classes (``id, row``): four bits of each of SIGNED minima."""

    def packed(flat: np.ndarray, upto: np.ndarray) -> list[bytes]:
        nibbles = _minima(flat, upto)[:, :SIGNED] & np.uint64(15)
        return [x.tobytes() for x in (nibbles[:, ::2] | nibbles[:, 1::2] << np.uint64(4)).astype(np.uint8)]

    return _of_classes(docs, wanted, "sig", packed)


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, first_word, last_word, start, end, component, first_doc_id, removed``: a row for every paragraph that another place repeats, itself included,
    and for every repeated passage of ``LENGTH`` words or more.

    ``start, end`` count code points. ``component``: its class's smallest id over verified links; ``first_doc_id``: where its first place
    is; ``removed``: false at that place only. Passages have components of their own: those that share stretches, directly or over others;
    ``removed`` is false for the passages made of the first places of stretches. Null and empty texts have no paragraphs. Rows that repeat id and text count once; rows that repeat only
    the id are different documents; a null id comes first. Other columns are ignored; no rows give no rows.
    """
    narrow(docs.sparkSession)
    rows = _documents(docs, id_col, text_col)
    known = keep(classes(rows), "classes")
    # texts go in too, so a batch has no more rows than theirs may have
    members = keep_numbers(links.bucket_members(shared(banded(rows), "key", "id", distinct=True, hashed=True)), "members", BATCH)

    def likely(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
        apart = sig ^ others
        return ((apart & 15 == 0).sum(axis=1) + (apart >> 4 == 0).sum(axis=1)) >= LIKELY * SIGNED

    def full(ids: DataFrame) -> DataFrame:
        return shingles_of(rows, known.select("id", "place.row").join(ids, "id"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = keep(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = keep(full(ids), "sets")
        one, two = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(text.column(batch, "s_a").to_pylist(), text.column(batch, "s_b").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return pairs.join(two, "b").join(one, "a").select("a", "b", "s_a", "s_b").mapInArrow(check, links.PAIRS)

    unsettled = members.where("n > 2").select("id").distinct()
    # sets have no common order of bands, so no band counts as an earlier one
    packed = keep(signatures_of(rows, known.select("id", "place.row").join(unsettled, "id")).select("id", F.array("id").alias("bands"), "sig"), "signatures")
    linked = links.all_links(members, packed, likely, verify, full, THRESHOLD)
    # a class of one place that no other is like repeats nothing
    joined = known.join(linked.withColumnRenamed("node", "id"), "id", "left").where("component IS NOT NULL OR last IS NOT NULL").withColumn("component", F.coalesce("component", "id"))
    groups = joined.groupBy("component").agg(F.min("place").alias("first"), F.max(F.coalesce("last", "place")).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    found = keep(joined.join(groups, "component").select("id", "component", "first"), "repeated")

    wanted = bloom.build(found.select("id"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(1).to_numpy()
            for part in text.slices(batch.column(2)):
                p = paragraphs(part)
                _, _, ids = _sets(p)
                some = bloom.hits(wanted.value, text.signed(ids))
                w, doc, first, last, ids = p.words, p.doc[some], p.first[some], p.last[some], ids[some]
                chars = text.char_counts(part)
                base = chars[part.offsets[doc]]
                yield pa.record_batch(
                    {
                        "id": text.signed(ids),
                        "doc_id": batch.column(0)[part.rows].take(pa.array(doc)),
                        "row": row[part.rows][doc],
                        "first_word": (first - w.first[doc]).astype(np.int32),
                        "last_word": (last - 1 - w.first[doc]).astype(np.int32),
                        "start": chars[w.start[first]] - base,
                        "end": chars[w.end[last - 1]] - base,
                    }
                )

    places = rows.select("doc_id", "row", "text").mapInArrow(locate, "id long, doc_id long, row long, first_word int, last_word int, start long, end long")
    out = places.join(found, "id").distinct()
    removed = ~F.struct("doc_id", "row", "first_word").eqNullSafe(F.col("first"))
    out = out.select("doc_id", "row", "first_word", "last_word", "start", "end", "component", F.col("first.doc_id").alias("first_doc_id"), removed.alias("removed"))
    return out.unionByName(passages(rows))


def passages(rows: DataFrame) -> DataFrame:
    """The repeated passages of ``doc_id, text, row``, in the columns of ``repeated_paragraphs``."""
    kinds = "row long, doc_id long, removed boolean, first_word int, last_word int, first_row long, first_start int"

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Touching stretches of a document; one row for all of them in a passage whose first places follow each other alike."""
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            row = text.column(batch, "row").to_numpy()
            cut = np.flatnonzero(row[1:] != row[:-1])
            end = int(cut[-1]) + 1 if len(cut) else 0
            if rest and len(row) and text.column(rest[-1], "row")[-1].as_py() != row[0] and not end:
                yield united(rest)
                rest = []
            if end:
                yield united([*rest, batch.slice(0, end)])
                rest = []
            rest.append(batch.slice(end))
        if sum(b.num_rows for b in rest):
            yield united(rest)

    def united(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        some = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        row, start, removed, first_row, first_start = (text.column(some, c).to_numpy(zero_copy_only=False) for c in ("row", "start", "removed", "first_row", "first_start"))
        apart, other = np.ones(len(row), bool), np.ones(len(row), bool)
        apart[1:] = (row[1:] != row[:-1]) | (removed[1:] != removed[:-1]) | (np.diff(start) > LENGTH)
        other[1:] = apart[1:] | (first_row[1:] != first_row[:-1]) | (np.diff(start) != np.diff(first_start))
        at, run = np.flatnonzero(apart), np.cumsum(apart) - 1
        end = np.r_[at[1:], len(row)] - 1
        own = np.flatnonzero(other)
        columns = [pa.array(row[own]), text.column(some, "doc_id").take(pa.array(own)), pa.array(removed[own]), pa.array(start[at][run[own]]), pa.array(start[end][run[own]] + np.int32(LENGTH - 1))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(first_row[own]), pa.array(first_start[own])], ["row", "doc_id", "removed", "first_word", "last_word", "first_row", "first_start"])

    places = first_places(candidate_stretches(rows), "stretch", "doc_id", "row", "start").drop("stretch")
    places = places.withColumn("removed", (F.col("row") != F.col("first_row")) | (F.col("start") != F.col("first_start")))
    places = places.repartition("row").sortWithinPartitions("row", "removed", "start").mapInArrow(unite, kinds)
    with batches_by_rows(rows.sparkSession, NUMBERS):
        places = keep(places.withColumn("node", F.xxhash64("row", "removed", "first_word")), "passages")
    firsts = places.where("not removed").select(F.col("row").alias("first_row"), "first_word", "last_word", F.col("node").alias("b"))
    within = F.col("first_start").between(F.col("first_word"), F.col("last_word") - LENGTH + 1)
    linked = components(places.where("removed").select("first_row", "first_start", F.col("node").alias("a")).join(firsts, "first_row").where(within).select("a", "b").distinct())
    found = keep(places.drop("first_row", "first_start").distinct().join(linked, "node"), "components")
    groups = found.where("not removed").groupBy("component").agg(F.min(F.struct("doc_id", "row", "first_word")).alias("first"))
    spans = found.join(groups, "component").select("row", F.struct("first_word", "last_word", "component", F.col("first.doc_id").alias("first_doc_id"), "removed").alias("span"))
    spans = keep(spans.groupBy("row").agg(F.collect_list("span").alias("spans")), "spans")
    texts = bloom.maybe(rows.select("row", "doc_id", "text"), "row", bloom.build(spans.select("row"))).where("_maybe")
    texts = texts.join(spans, "row").dropDuplicates(["row"]).select("doc_id", "row", "text", "spans")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch.column(2)):
                w, chars, some = text.words(part), text.char_counts(part), batch.column(3)[part.rows]
                doc = np.repeat(np.arange(len(some)), some.value_lengths().to_numpy())
                first_word, last_word, component, first_doc_id, removed = some.flatten().flatten()
                base = chars[part.offsets[doc]]
                columns = {"doc_id": batch.column(0)[part.rows].take(pa.array(doc)), "row": batch.column(1)[part.rows].take(pa.array(doc)), "first_word": first_word, "last_word": last_word}
                columns |= {"start": chars[w.start[w.first[doc] + first_word.to_numpy()]] - base, "end": chars[w.end[w.first[doc] + last_word.to_numpy()]] - base}
                yield pa.record_batch(columns | {"component": component, "first_doc_id": first_doc_id, "removed": removed})

    return texts.mapInArrow(locate, "doc_id long, row long, first_word int, last_word int, start long, end long, component long, first_doc_id long, removed boolean")
