"""Byte-level BPE in two tiers, and back to bytes.

First tier: the vocabulary's byte strings lie in a minimal perfect hash (one slot per entry, a displacement per bucket). A
whole pre-token is looked up there with one probe, and its bytes are compared with the entry's. Second tier: a pre-token
that is no entry is merged from its bytes, linked to their neighbours, with a heap of (rank, place): the lowest rank first,
of equal ones the leftmost. A task remembers merged pre-tokens.

The hash, the entries and the class of every code point go to the tasks: a few megabytes, bounded by the rank file and by
Unicode. Classes are asked from the tokenizer library's own pattern engine, so all versions of Unicode agree. Texts are
worked through in slices; a longer text is cut where a space follows another sign, which is always a pre-token's edge.
"""

from __future__ import annotations

import base64
import functools
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import text
from fieldspark.llm.pieces import equal, gather
from fieldspark.llm.text import Slice, mix, span_hashes

OTHER, LETTER, DIGIT, SPACE = range(4)
REMEMBER = 1 << 18  # merged pre-tokens that a task remembers
LONG = 1 << 12  # bytes; longer pre-tokens are not remembered
# What may follow an apostrophe as a pre-token of its own. Fixed values.
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]


def ranks(path: str) -> dict[bytes, int]:
    """The rank file: a line per entry, its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(raw): int(rank) for raw, rank in map(bytes.split, f)}


@functools.cache
def classes() -> np.ndarray:
    """Letter, digit, white space or other for every code point, as the tokenizer library's patterns see it."""
    import tiktoken

    every = np.delete(np.arange(sys.maxunicode + 1, dtype=np.uint32), slice(0xD800, 0xE000))
    signs = every.tobytes().decode("utf-32-le")
    bytewise = {bytes([b]): b for b in range(256)}
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        alone = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=bytewise, special_tokens={})
        found = alone.decode_bytes(alone.encode_ordinary(signs)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: hash and displace.

    Large buckets are placed first, each with the first displacement that sends its keys to free slots; a bucket of one key
    gets a free slot directly, written as a negative number.
    """

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.shift = np.zeros(max(1, self.n // 4), np.int64)
        bucket = (keys % np.uint64(len(self.shift))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(self.shift))
        first = np.cumsum(sizes) - sizes
        free = np.ones(self.n, bool)
        alone = []
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] == 0:
                break
            own = keys[order[first[b] : first[b] + sizes[b]]]
            if len(own) == 1:
                alone.append(b)
                continue
            at = 0
            while True:
                slots = self._slot(own, np.arange(at, at + 64)[:, None])
                spread = np.sort(slots, axis=1)
                good = np.flatnonzero(free[slots].all(1) & (spread[:, 1:] != spread[:, :-1]).all(1))
                if len(good):
                    self.shift[b] = at + good[0]
                    free[slots[good[0]]] = False
                    break
                at += 64
        self.shift[alone] = -1 - np.flatnonzero(free)

    def _slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; a key that was not among those given gets some slot."""
        shift = self.shift[(keys % np.uint64(len(self.shift))).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slot(keys, np.maximum(shift, 0)))


class Vocabulary:
    """Entries by slot of the perfect hash, their bytes in one pool, and the places of tokens in it by rank."""

    def __init__(self, entries: dict[bytes, int]):
        spelled = list(entries)
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(spelled), np.uint8)
        keys = span_hashes(self.pool.astype(np.uint64) + np.uint64(1), self.at, self.at + self.size)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two entries share a hash")
        self.slot = PerfectHash(keys)
        order = np.argsort(self.slot(keys))
        self.key, self.rank = keys[order], np.array(list(entries.values()), np.uint32)[order]
        self.size, self.at = self.size[order], self.at[order]
        top = int(self.rank.max(initial=0)) + 1
        self.token_at, self.token_size = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.token_at[self.rank], self.token_size[self.rank] = self.at, self.size

    def entries(self) -> dict[bytes, int]:
        raw = self.pool.tobytes()
        return {raw[a : a + n]: r for a, n, r in zip(self.at.tolist(), self.size.tolist(), self.rank.tolist())}


def merge(piece: bytes, entries: dict[bytes, int]) -> list[int]:
    """Ranks of the tokens of one pre-token: a heap of pairs over linked bytes.

    A pair is one integer, its rank, begin and end from the highest bits on, so the smallest is the next to merge.
    """
    n, get = len(piece), entries.get
    bits = n.bit_length()
    mask = (1 << bits) - 1
    stop = list(range(1, n + 1))  # end of the token that begins here, 0 once it is merged away
    back = list(range(-1, n))  # begin of the token before the one that begins here
    heap = [(rank << bits | i) << bits | i + 2 for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        pair = heappop(heap)
        end, i = pair & mask, pair >> bits & mask
        middle = stop[i]
        if not middle or middle >= end or stop[middle] != end:  # one of the two has changed since
            continue
        stop[i], stop[middle], back[end] = end, 0, i
        if end < n and (rank := get(piece[i : stop[end]])) is not None:
            heappush(heap, (rank << bits | i) << bits | stop[end])
        before = back[i]
        if before >= 0 and (rank := get(piece[before:end])) is not None:
            heappush(heap, (rank << bits | before) << bits | end)
    out, i = [], 0
    while i < n:
        out.append(entries[piece[i : stop[i]]])
        i = stop[i]
    return out


def pretokens(part: Slice, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of a slice of valid UTF-8 begin, in bytes, with one more entry for the end, and each document's first.

    A run of one class is a pre-token, with these exceptions: of white space before another sign the last one parts from
    the run, and if it is a space it leads the next pre-token; an apostrophe that begins a run and its suffix stand alone.
    """
    lead = np.append(np.flatnonzero((part.data & 0xC0) != 0x80), len(part.data))
    code = np.frombuffer(part.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    edges = np.searchsorted(lead, part.offsets)
    kind = kinds[code]
    start, edge = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    edge[edges] = True
    start[1:n] = kind[1:] != kind[:-1]
    start |= edge
    start[n] = True

    turn = np.flatnonzero(start[1:n] & (kind[:-1] == SPACE) & ~edge[1:n])  # the last white space before another sign
    start[turn] = True
    start[turn[code[turn] == 0x20] + 1] = False

    quote = np.flatnonzero(start[:n] & (code == 0x27))
    room = np.searchsorted(edges, quote, "right")
    room = edges[np.minimum(room, len(edges) - 1)] - quote - 1  # signs up to the document's end
    padded = np.concatenate([code, np.zeros(3, np.uint32)])
    for suffix in SUFFIXES:
        fits = room >= len(suffix)
        for k, sign in enumerate(suffix):
            fits &= padded[quote + 1 + k] == ord(sign)
        start[quote[fits] + 1] = False
        start[quote[fits] + 1 + len(suffix)] = True
    begins = np.flatnonzero(start)
    return lead[begins], np.searchsorted(begins, edges)


class Encoder:
    """Encodes slices in one task."""

    def __init__(self, vocabulary: Vocabulary, kinds: np.ndarray):
        self.words, self.kinds, self.entries = vocabulary, kinds, vocabulary.entries()
        self.known: dict[bytes, bytes] = {}

    def merged(self, piece: bytes) -> bytes:
        """Ids of a pre-token as unsigned 32-bit integers."""
        ids = self.known.get(piece)
        if ids is None:
            ids = array("I", merge(piece, self.entries)).tobytes()
            if len(piece) <= LONG:
                if len(self.known) >= REMEMBER:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice, and where each document's begin (one more entry)."""
        begins, first = pretokens(part, self.kinds)
        at, size = begins[:-1], np.diff(begins)
        v, n = self.words, len(begins) - 1
        key = span_hashes(part.data.astype(np.uint64) + np.uint64(1), at, begins[1:])
        slot = v.slot(key) if n and v.slot.n else np.zeros(n, np.int64)
        hit = np.flatnonzero((v.key[slot] == key) & (v.size[slot] == size))
        hit = hit[equal(part.data, at[hit], v.pool, v.at[slot[hit]], size[hit])]
        whole = np.zeros(n, bool)
        whole[hit] = True

        rest = np.flatnonzero(~whole)
        _, one, which = np.unique(key[rest], return_index=True, return_inverse=True)
        alike = size[rest] == size[rest[one[which]]]
        same = np.flatnonzero(alike)
        alike[same] = equal(part.data, at[rest[same]], part.data, at[rest[one[which[same]]]], size[rest[same]])
        odd = np.flatnonzero(~alike)  # of two spellings with one hash the second is merged by itself
        which[odd] = len(one) + np.arange(len(odd))
        raw = part.data.tobytes()
        merged = [self.merged(raw[at[k] : begins[k + 1]]) for k in np.concatenate([rest[one], rest[odd]]).tolist()]

        count = np.ones(n, np.int64)
        pool = np.concatenate([v.rank[slot[hit]], np.frombuffer(b"".join(merged), np.uint32)])
        sizes = np.array([len(m) for m in merged], np.int64) // 4
        place = np.zeros(n, np.int64)
        place[hit] = np.arange(len(hit))
        count[rest], place[rest] = sizes[which], (len(hit) + np.cumsum(sizes) - sizes)[which]
        upto = np.concatenate([[0], np.cumsum(count)])
        return gather(pool, place, count), upto[first]


def cuts(data: np.ndarray, size: int) -> list[int]:
    """Ends of pieces of about ``size`` bytes, each before a space that follows another sign; a text without any stays whole."""
    ends, at = [], 0
    while at + size < len(data):
        found, to = (), at + size
        while not len(found) and to < len(data):
            window = data[to - 1 : to + size]
            found = np.flatnonzero((window[1:] == 0x20) & (window[:-1] > 0x20) & (window[:-1] < 0x7F))
            if len(found):
                to += int(found[0])
            else:
                to += size
        if to >= len(data):
            break
        ends.append(to)
        at = to
    return [*ends, len(data)]


def _valid(part: Slice) -> Slice:
    """The slice with what is no UTF-8 replaced, as Python decodes it."""
    try:
        part.data.tobytes().decode("utf-8")
        return part
    except UnicodeDecodeError:
        raw = [part.text(a, b).encode() for a, b in zip(part.offsets[:-1], part.offsets[1:])]
        return Slice(part.rows, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: a row for every row of ``docs``, ids as little-endian unsigned 32-bit integers in one binary.

    They are those of the rank file at ``path`` with the public pattern, without special tokens. Null and empty texts have no
    ids; ids of documents may be null or repeat; other columns are ignored; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((Vocabulary(ranks(path)), classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value)
        for batch in batches:
            for part in text.slices(batch.column(1)):
                part = _valid(part)
                if len(part.data) > 2 * text.SLICE:  # a single text
                    ends = cuts(part.data, text.SLICE)
                    pieces = [encoder.encode(Slice(part.rows, part.data[a:b], np.array([0, b - a])))[0] for a, b in zip([0, *ends[:-1]], ends)]
                    ids = np.concatenate(pieces)
                    first = np.array([0, len(ids)])
                else:
                    ids, first = encoder.encode(part)
                raw = ids.astype("<u4").tobytes()
                yield pa.record_batch({"doc_id": batch.column(0)[part.rows], "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (``doc_id, ids``) with ``decoded``, the bytes of the ids. Null ids have no bytes; an unknown id raises."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary(ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in batches:
            out = []
            for raw in batch.column(1):
                ids = np.frombuffer(raw.as_py() or b"", "<u4")
                out.append(gather(v.pool, v.token_at[ids], v.token_size[ids]).tobytes())
            yield pa.record_batch({"doc_id": batch.column(0), "ids": batch.column(1), "decoded": pa.array(out, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what ``decode`` gives."""
    ids, plain = F.coalesce("ids", F.lit(b"")), F.coalesce("decoded", F.lit(b""))
    return decoded.select("doc_id", F.floor(F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(plain, 256).alias("decoded_sha256"))
