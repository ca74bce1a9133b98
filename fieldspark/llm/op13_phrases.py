"""Phrase collocations from count transducers (weighted acyclic automata, see ``transducer``).

Phrases are counted by length, one word more at a time. A task counts the phrases of its texts whose two parts without the
last and without the first word are frequent (a Bloom filter lets others through at times, the counts decide), sorts them
and builds count transducers, one or more for every prefix range. A shuffle brings those of a range together; their union
sums the weights, and the phrases that are frequent are written as transducers again. A part of a frequent phrase is
frequent, so nothing is missed, and rare phrases never leave the count of their own length.

Then every block of frequent phrases sends the distinct parts of its phrases, as a transducer whose weights are the largest
count of a phrase around the part, to the ranges of the parts. There it is composed with the counts of that range. The
counts go back to the block in order, and the largest counts around go to the blocks of the parts themselves.

Prefix ranges are cut by word counts: a range holds about ``share`` occurrences of first words, and a word with more than
that is cut further by the second word. So a task holds one range of phrases, however frequent a word or a language is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm import bloom, store, text
from fieldspark.llm.pieces import equal
from fieldspark.llm.text import Slice, mix, span_hashes
from fieldspark.llm.transducer import Cut, Symbols, Transducer, distinct, places

LONGEST, LEAST, BEST, COVER = 4, 30, 2000, 80
SHARE = 1 << 22  # occurrences of first words in a prefix range
HOLD = 1 << 20  # phrases (or words) that a task counts before it passes them on
BLOCK = 1 << 12  # phrases of one transducer, so that a batch of rows stays small
SCORE = 2_000_000
UNKNOWN = b"und"
_BREAK = np.zeros(256, bool)  # signs that part pieces
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()  # and words
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TRANSDUCERS = "target int, level int, kind int, home int, size int, block int, blob binary"


def _cuts(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Pieces of a long text of about ``size`` bytes, parted where phrases end anyway."""
    at = 0
    while at < len(data):
        to = at + size
        while to < len(data):
            found = np.flatnonzero(_BREAK[data[to : to + size]])
            if len(found):
                to += int(found[0]) + 1
                break
            to += size
        to = min(to, len(data))
        yield at, to
        at = to


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[Slice, list[bytes]]]:
    """Slices of the texts in the second column, lower case, and each document's language from the first."""
    for part in text.slices(batch.column(1)):
        groups = [UNKNOWN if g is None else g.encode() for g in batch.column(0)[part.rows].to_pylist()]
        data = _LOWER[part.data]
        if len(data) > 2 * text.SLICE:  # a single text
            for a, b in _cuts(data, text.SLICE):
                yield Slice(part.rows, data[a:b], np.array([0, b - a])), groups
        else:
            yield Slice(part.rows, data, part.offsets), groups


class Running:
    """The words of a slice in order: where they are, their hashes, and the piece and document of each."""

    def __init__(self, part: Slice):
        data = part.data
        gap, edge = _GAP[data], np.zeros(len(data) + 1, bool)
        edge[part.offsets] = True
        inner = ~gap
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= gap[:-1]
        after[:-1] |= gap[1:]
        self.data, self.start, self.end = data, np.flatnonzero(inner & before), np.flatnonzero(inner & after) + 1
        self.hash = span_hashes(data.astype(np.uint64) + np.uint64(1), self.start, self.end)
        self.doc = np.searchsorted(part.offsets, self.start, "right") - 1
        self.piece = np.cumsum(_BREAK[data] | edge[:-1])[self.start]

    def spell(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]

    def classes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place for each distinct word among the places ``at``, and which of these each has; compared byte by byte."""
        _, one, which = np.unique(self.hash[at], return_index=True, return_inverse=True)
        size, head = self.end[at] - self.start[at], one[which]
        same = size == size[head]
        k = np.flatnonzero(same)
        same[k] = equal(self.data, self.start[at[k]], self.data, self.start[at[head[k]]], size[k])
        odd = np.flatnonzero(~same)  # of two words with one hash: a class of its own for each
        which[odd] = len(one) + np.arange(len(odd))
        return np.concatenate([at[one], at[odd]]), which


def gram_keys(groups: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of phrases, by the hashes of their language and words."""
    total = mix(groups + _Q)
    for h in words:
        total = mix(total * _P + h)
    return total.view(np.int64)


def _hashes(strings: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(s) for s in strings])
    pool = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64) + np.uint64(1)
    return span_hashes(pool, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64))


def count_words(docs: DataFrame, hold: int = HOLD) -> DataFrame:
    """``lang, word, f``: all words of all texts; words are binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, bytes], int] = {}

        def rows() -> pa.RecordBatch:
            made = pa.record_batch({"lang": pa.array([k[0].decode() for k in counts]), "word": pa.array([k[1] for k in counts], pa.binary()), "f": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return made

        for batch in batches:
            for part, groups in _slices(batch):
                w = Running(part)
                if not len(w.start):
                    continue
                ones, which = w.classes(np.arange(len(w.start)))
                names = {g: k for k, g in enumerate(dict.fromkeys(groups))}
                of = np.array([names[g] for g in groups])[w.doc]
                pairs, n = np.unique(which.astype(np.int64) * len(names) + of, return_counts=True)
                spelled, listed = w.spell(ones), list(names)
                for pair, c in zip(pairs.tolist(), n.tolist()):
                    key = (listed[pair % len(names)], spelled[pair // len(names)])
                    counts[key] = counts.get(key, 0) + c
                if len(counts) >= hold:
                    yield rows()
        if counts:
            yield rows()

    return docs.mapInArrow(run, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def prefix_cuts(frequent: DataFrame, share: int) -> list[Cut]:
    """Where prefix ranges begin, by the counts of ``frequent`` words (a written table).

    One cut for about ``share`` occurrences reaches the driver, as the bounds of any range partitioning do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            f = batch.column(2).to_numpy()
            upto = total + np.cumsum(f)
            cross = np.flatnonzero(upto // share != np.concatenate([[total], upto[:-1]]) // share)
            total = int(upto[-1]) if len(upto) else total
            if len(cross):
                yield batch.take(pa.array(cross))

    ordered = frequent.select("lang", "word", "f").repartitionByRange("lang", "word").sortWithinPartitions("lang", "word")
    found = sorted((r["lang"].encode(), bytes(r["word"]), r["f"]) for r in ordered.mapInArrow(run, "lang string, word binary, f long").collect())
    by_group: dict[bytes, list[bytes]] = {}
    for group, word, _ in found:
        by_group.setdefault(group, []).append(word)
    cuts: list[Cut] = []
    for group, word, f in found:
        cuts.append((group, word, None))
        inner = by_group[group]
        parts = min(int(f // share), len(inner))
        cuts += [(group, word, inner[k * len(inner) // parts]) for k in range(1, parts)]
    return sorted(set(cuts), key=lambda c: (c[0], c[1], c[2] is not None, c[2] or b""))


class Held:
    """Phrases of one task or range and their counts, by numbers of symbols; put together whenever ``hold`` rows are held."""

    def __init__(self, hold: int):
        self.groups, self.words, self.hold = Symbols(), Symbols(), hold
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((grams, counts))
        self.rows += len(grams)
        if self.rows > self.hold:
            self.compact()
            self.hold = max(self.hold, 2 * self.rows)

    def compact(self) -> None:
        if len(self.parts) > 1:
            grams, counts, _ = distinct(np.concatenate([g for g, _ in self.parts]), np.concatenate([c for _, c in self.parts]))
            self.parts, self.rows = [(grams, counts)], len(grams)

    def sorted(self, least: int = 0) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
        """Symbols and phrases in byte order with counts of at least ``least``."""
        groups, group_rank = self.groups.sorted()
        words, word_rank = self.words.sorted()
        if not self.parts:
            return groups, words, np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        self.compact()
        grams, counts = self.parts[0]
        often = counts >= least
        grams = grams[often]
        ranked = np.column_stack([group_rank[grams[:, 0]], *(word_rank[grams[:, k]] for k in range(1, grams.shape[1]))]) if len(grams) else grams
        return groups, words, *distinct(ranked, counts[often])[:2]


def _blocks(groups: list[bytes], words: list[bytes], grams: np.ndarray, weights: np.ndarray, cuts: list[Cut], block: int) -> Iterator[tuple[int, Transducer]]:
    """Transducers of sorted phrases, each within one prefix range, and the range's number."""
    edges = [0, *places(groups, words, grams, cuts).tolist(), len(grams)]
    for target, (a, b) in enumerate(zip(edges, edges[1:])):
        for at in range(a, b, block):
            to = min(b, at + block)
            yield target, Transducer.build(groups, words, grams[at:to], weights[at:to])


def count_phrases(docs: DataFrame, size: int, parts: DataFrame, cuts: list[Cut], hold: int = HOLD, block: int = BLOCK) -> DataFrame:
    """``target, blob``: count transducers of the phrases of ``size`` words by task and prefix range, where the keys of both
    phrases of one word less are in ``parts`` (a column of longs)."""
    filter_, sent = bloom.build(parts), docs.sparkSession.sparkContext.broadcast(cuts)
    limit = 1 << 20  # symbols of a task, so that three numbers fit in 64 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(2 * hold)

        def flush() -> Iterator[pa.RecordBatch]:
            groups, words, grams, counts = held.sorted()
            for target, t in _blocks(groups, words, grams, counts, sent.value, block) if len(grams) else ():
                yield pa.record_batch({"target": pa.array([target], pa.int32()), "blob": pa.array([t.dump()], pa.binary())})

        for batch in batches:
            for part, groups in _slices(batch):
                w = Running(part)
                n = len(w.start)
                if n < size:
                    continue
                by_doc = _hashes(groups)[w.doc] if part.offsets[-1] else np.zeros(0, np.uint64)
                known = bloom.hits(filter_.value, gram_keys(by_doc[: n - size + 2], [w.hash[k : n - size + 2 + k] for k in range(size - 1)]))
                begins = np.flatnonzero((w.piece[: n - size + 1] == w.piece[size - 1 :]) & known[:-1] & known[1:])
                for at in np.split(begins, range(limit >> 1, len(begins), limit >> 1)):
                    if not len(at):
                        continue
                    if len(held.words) > limit or len(held.groups) > limit:
                        yield from flush()
                        held = Held(2 * hold)
                    used = np.zeros(n, bool)
                    for k in range(size):
                        used[at + k] = True
                    ones, which = w.classes(np.flatnonzero(used))
                    number = np.zeros(n, np.int64)
                    number[used] = held.words.of(w.spell(ones))[which]
                    grams = np.column_stack([held.groups.of(groups)[w.doc[at]], *(number[at + k] for k in range(size))])
                    held.add(*distinct(grams, np.ones(len(grams), np.int64))[:2])
                    if held.rows > hold:
                        held.compact()
                    if held.rows > hold:
                        yield from flush()
                        held = Held(2 * hold)
        yield from flush()

    return docs.mapInArrow(run, "target int, blob binary")


def _by_target(rows: DataFrame, *keys: str, order: tuple[str, ...], parts: int) -> DataFrame:
    """Rows of a prefix range (the first key) in a partition of their own."""
    return rows.repartitionById(parts, F.col(keys[0])).sortWithinPartitions(*keys, *order)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Successive rows with equal values in the first ``keys`` columns; a run is read as it is used."""
    import itertools

    def rows() -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}

    yield from itertools.groupby(rows(), key=lambda r: tuple(r.values())[:keys])


def unite(counted: DataFrame, size: int, least: int, parts: int, hold: int = HOLD, block: int = BLOCK) -> DataFrame:
    """The union of the count transducers of each prefix range: phrases counted ``least`` times, as transducers, and their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (target,), rows in _runs(batches, 1):
            held = Held(hold)
            for row in rows:
                t = Transducer.load(row["blob"])
                grams, counts = t.expand()
                group, word = held.groups.of(t.groups), held.words.of(t.words)
                held.add(np.column_stack([group[grams[:, 0]], *(word[grams[:, k]] for k in range(1, size + 1))]), counts)
            groups, words, grams, counts = held.sorted(least)
            if not len(grams):
                continue
            of, h = _hashes(groups), _hashes(words)
            keys = gram_keys(of[grams[:, 0]], [h[grams[:, k]] for k in range(1, size + 1)])
            for number, at in enumerate(range(0, len(grams), block)):
                t = Transducer.build(groups, words, grams[at : at + block], counts[at : at + block])
                yield _record(target, size, 0, target, size, number, t.dump()).append_column("keys", pa.array([keys[at : at + block]], pa.list_(pa.int64())))

    return _by_target(counted, "target", order=(), parts=parts).mapInArrow(run, f"{TRANSDUCERS}, keys array<long>")


def _record(target: int, level: int, kind: int, home: int, size: int, block: int, blob: bytes) -> pa.RecordBatch:
    numbers = {"target": target, "level": level, "kind": kind, "home": home, "size": size, "block": block}
    return pa.record_batch({k: pa.array([v], pa.int32()) for k, v in numbers.items()} | {"blob": pa.array([blob], pa.binary())})


def word_transducers(frequent: DataFrame, cuts: list[Cut], hold: int = HOLD, block: int = BLOCK) -> DataFrame:
    """The frequent words as transducers by prefix range."""
    sent = frequent.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            for target, t in _blocks(*held.sorted(), sent.value, block) if held.rows else ():
                yield _record(target, 1, 0, target, 1, 0, t.dump())

        held = Held(2 * hold)
        for batch in batches:
            groups, words = [g.encode() for g in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            held.add(np.column_stack([held.groups.of(groups), held.words.of(words)]), batch.column(2).to_numpy())
            if held.rows > hold:
                yield from flush()
                held = Held(2 * hold)
        yield from flush()

    return frequent.select("lang", "word", "f").mapInArrow(run, TRANSDUCERS)


def _word_keys(frequent: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                groups, words = [g.encode() for g in batch.column(0).to_pylist()], batch.column(1).to_pylist()
                yield pa.record_batch({"key": gram_keys(_hashes(groups), [_hashes(words)])})

    return frequent.select("lang", "word").mapInArrow(run, "key long")


def _parts(grams: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]]:
    """By length: the distinct parts of sorted phrases of one length, the largest count around each, and by first word the part of each phrase.

    Parts are all of at least two words, and the first and the last word.
    """
    size, n, out = grams.shape[1] - 1, len(grams), {}
    for length in range(1, size):
        begins = [0, size - 1] if length == 1 else list(range(size - length + 1))
        every = np.concatenate([grams[:, [0, *range(1 + b, 1 + b + length)]] for b in begins])
        some, around, where = distinct(every, np.tile(counts, len(begins)), np.maximum)
        out[length] = some, around, {b: where[k * n : (k + 1) * n] for k, b in enumerate(begins)}
    return out


def ask(phrases: DataFrame, cuts: list[Cut]) -> DataFrame:
    """The distinct parts of every block of phrases, as transducers by prefix range, weighted by the largest count around."""
    sent = phrases.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (home, size, block, _), rows in _runs(batches, 4):
            for row in rows:
                t = Transducer.load(row["blob"])
                for length, (some, around, _) in _parts(*t.expand()).items():
                    for target, q in _blocks(t.groups, t.words, some, around, sent.value, len(some)):
                        yield _record(target, length, 1, home, size, block, q.dump())

    return phrases.select("home", "size", "block", "kind", "blob").mapInArrow(run, TRANSDUCERS)


def answer(tables: DataFrame, parts: int) -> DataFrame:
    """Compose the parts asked for with the counts of their range.

    Kind 1: counts of a block's parts of one length, in order; kind 2: for the phrases of a block the largest count around them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reply(home: int, size: int, block: int, kind: int, level: int, target: int, numbers: np.ndarray) -> pa.RecordBatch:
            made = {"home": home, "size": size, "block": block, "kind": kind, "level": level, "target": target}
            return pa.record_batch({k: pa.array([v], pa.int32()) for k, v in made.items()} | {"numbers": pa.array([numbers], pa.list_(pa.int64()))})

        for (target, level), rows in _runs(batches, 2):
            held, blocks, index, counts, around = Held(HOLD), [], None, None, None
            for row in rows:
                t = Transducer.load(row["blob"])
                if row["kind"] == 0:
                    grams, n = t.expand()
                    group, word = held.groups.of(t.groups), held.words.of(t.words)
                    held.add(np.column_stack([group[grams[:, 0]], *(word[grams[:, k]] for k in range(1, level + 1))]), n)
                    blocks.append((row["block"], len(grams)))
                    continue
                if index is None:
                    groups, words, grams, counts = held.sorted()
                    index, around = Transducer.build(groups, words, grams, np.arange(len(grams))), np.zeros(len(grams), np.int64)
                found = t.compose(index)
                if (found < 0).any():
                    raise ValueError("a part of a frequent phrase has no count")
                np.maximum.at(around, found, t.expand()[1])
                yield reply(row["home"], row["size"], row["block"], 1, level, target, counts[found])
            if level > 1 and around is not None:
                at = 0
                for block, n in blocks:  # blocks come in order and hold the range's phrases in order
                    yield reply(target, level, block, 2, level, target, around[at : at + n])
                    at += n

    dealt = _by_target(tables, "target", "level", order=("kind", "home", "size", "block"), parts=parts)
    return dealt.mapInArrow(run, "home int, size int, block int, kind int, level int, target int, numbers array<long>")


def score(phrases: DataFrame, answers: DataFrame, parts: int, cover: int = COVER, best: int = BEST) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases not covered by a longer one; per task and language the best only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, list[tuple]] = {}

        def order(row: tuple) -> tuple:
            return -row[4], -row[1], row[0]

        for (_, size, _), rows in _runs(batches, 3):
            counts: dict[int, list[np.ndarray]] = {}
            around = t = None
            for row in rows:
                if row["kind"] == 0:
                    t = Transducer.load(row["blob"])
                elif row["kind"] == 1:
                    counts.setdefault(row["level"], []).append(np.array(row["numbers"], np.int64))
                else:
                    around = np.array(row["numbers"], np.int64)
            grams, a = t.expand()
            kind = object if int(a.max()) > 2**63 // SCORE else np.int64
            where = {length: made[2] for length, made in _parts(grams, a).items()}
            whole = {length: np.concatenate(n) for length, n in counts.items()}
            a = a.astype(kind)
            sides = [(whole[k][where[k][0]].astype(kind), whole[size - k][where[size - k][k]].astype(kind)) for k in range(1, size)]
            scores = np.stack([SCORE * a // (one + two) for one, two in sides])
            at = scores.argmin(0)  # of equal ones the shortest first part
            stay = np.ones(len(a), bool) if around is None else 100 * around.astype(kind) < cover * a
            for k in np.flatnonzero(stay).tolist():
                phrase = b" ".join(t.words[w] for w in grams[k, 1:].tolist())
                own = kept.setdefault(t.groups[grams[k, 0]], [])
                own.append((phrase, int(a[k]), int(sides[at[k]][0][k]), int(sides[at[k]][1][k]), int(scores[at[k], k])))
                if len(own) >= 4 * best:
                    own.sort(key=order)
                    del own[best:]
        for group, own in kept.items():
            own.sort(key=order)
            made = own[:best]
            yield pa.record_batch(
                {"lang": [group.decode()] * len(made), "phrase": [r[0].decode("utf-8", "replace") for r in made]} | {name: pa.array([r[k] for r in made], pa.int64()) for k, name in enumerate(("a", "l", "r", "score"), 1)}
            )

    asked = phrases.select("home", "size", "block", "kind", F.lit(0).alias("level"), F.lit(0).alias("target"), "blob", F.lit(None).cast("array<long>").alias("numbers"))
    told = answers.select("home", "size", "block", "kind", "level", "target", F.lit(None).cast("binary").alias("blob"), "numbers")
    dealt = _by_target(asked.unionByName(told), "home", "size", "block", order=("kind", "level", "target"), parts=parts)
    return dealt.mapInArrow(run, "lang string, phrase string, a long, l long, r long, score long")


def _rank(window: Callable) -> object:
    return window.orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))


def phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, best: int = BEST, cover: int = COVER, share: int = SHARE, hold: int = HOLD, block: int = BLOCK
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``best`` phrases of 2 to ``longest`` words.

    Counts are over all rows and whole texts, within pieces parted by ``.,;:!?`` and line ends. A null language is ``und``; null
    and empty texts have no words; equal rows each count; other columns are ignored; no rows or no frequent phrase give no
    rows. Equal scores are ordered by count, then by the bytes of the phrase. ``share``, ``hold`` and ``block`` set the size of
    prefix ranges, of what a task holds and of one transducer; they never change the result.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = store.keep(count_words(rows, hold), "op13-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = store.keep(words.where(F.col("f") >= least), "op13-frequent")
    cuts = prefix_cuts(frequent, share)
    parts = len(cuts) + 1
    tables, keys = [], _word_keys(frequent)
    for size in range(2, longest + 1):
        table = store.keep(unite(count_phrases(rows, size, keys, cuts, hold, block), size, least, parts, hold, block), f"op13-phrases-{size}")
        tables.append(table)
        keys = table.select(F.explode("keys").alias("key"))
    candidates = tables[0].drop("keys")
    for table in tables[1:]:
        candidates = candidates.unionByName(table.drop("keys"))
    asked = word_transducers(frequent, cuts, hold, block).unionByName(candidates).unionByName(ask(candidates, cuts))
    answers = store.keep(answer(asked, parts), "op13-answers")
    scored = score(candidates, answers, parts, cover, best)
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = scored.withColumn("rank", F.row_number().over(_rank(dealt))).where(F.col("rank") <= best)
    top = some.withColumn("rank", F.row_number().over(_rank(Window.partitionBy("lang")))).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql() -> str:
    """SQL of the registered query."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gram = "array_to_string(w[i:i+m-1], ' ')"
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
found AS (SELECT lang, m, unnest([{gram} FOR i IN range(1, len(w) - m + 2)]) AS g FROM words, range(1, {LONGEST + 1}) t(m)),
often AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM found GROUP BY lang, m, g HAVING count(*) >= {LEAST}),
candidate AS (SELECT lang, m, g, string_split(g, ' ') AS w, f AS a FROM often WHERE m >= 2),
around AS (SELECT lang, p AS g, max(a) AS a FROM (
  SELECT lang, a, array_to_string(w[i:i+j-1], ' ') AS p FROM candidate, range(2, {LONGEST}) s(j), range(1, {LONGEST}) t(i) WHERE j < m AND i + j - 1 <= m) GROUP BY lang, p),
split AS (SELECT lang, g, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k+1:], ' ') AS two FROM candidate, range(1, {LONGEST}) t(k) WHERE k < m),
cut AS (SELECT s.lang, s.g, s.a, k, x.f AS l, y.f AS r, CAST((CAST({SCORE} AS HUGEINT) * s.a) // (x.f + y.f) AS BIGINT) AS score
  FROM split s JOIN often x ON x.lang = s.lang AND x.g = s.one JOIN often y ON y.lang = s.lang AND y.g = s.two),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, encode(l.g)) AS rank
  FROM lowest l LEFT JOIN around o ON o.lang = l.lang AND o.g = l.g WHERE o.a IS NULL OR 100 * o.a < {COVER} * l.a)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, g AS phrase, r.a, l, r, t.n, score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= {BEST}"""
