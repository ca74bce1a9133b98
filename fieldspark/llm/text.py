"""Vectorised words, shingles and hashes over Arrow batches of texts.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; both rules are ASCII only, so they hold on UTF-8 bytes.
All functions work on slices of an eighth of a megabyte, so a task's memory does not depend on the table.
A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 17  # bytes of text that one slice holds, unless a single document is longer; working on one takes some fifty times as much
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        for k, base in enumerate((_PRIME, inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span, in time linear in the input."""
    n = len(values)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Slice:
    """A few whole documents: their bytes, and where each starts."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray  # one more than documents, from 0

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


@dataclass
class Words:
    """Words of a slice; ``first`` has a document's first word, and one more entry for the end."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Slice]:
    """Cut a batch's text column into runs of whole documents of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Slice(slice(at, end), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def words(part: Slice, lower: bool = True) -> Words:
    """All words of a slice. Long documents are worked through piece by piece, cut at separators."""
    pieces, at, n = [], 0, len(part.data)
    while at < n:
        end = min(n, at + SLICE)
        if end < n:
            gaps = np.flatnonzero(_SEPARATOR[part.data[at:end]])
            while not len(gaps) and end < n:
                end = min(n, end + SLICE)
                gaps = np.flatnonzero(_SEPARATOR[part.data[at:end]])
            if end < n:
                end = at + int(gaps[-1]) + 1
        pieces.append(_words(part, at, end, lower))
        at = end
    if not pieces:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(part.offsets), np.int64))
    start, stop, h = (np.concatenate(x) if len(pieces) > 1 else x[0] for x in zip(*pieces, strict=True))
    return Words(start, stop, h, np.searchsorted(start, part.offsets))


def _words(part: Slice, at: int, end: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = part.data[at:end]
    gap = _SEPARATOR[data]
    edges = part.offsets[(part.offsets >= at) & (part.offsets < end)] - at
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    before[edges] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    after[edges[edges > 0] - 1] = True
    start, stop = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    values = _LOWER[data] if lower else data.astype(np.uint64) + np.uint64(1)
    return start + at, stop + at, span_hashes(values, start, stop)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` successive word hashes; the caller drops those that cross a document's end."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), 1
    for k in range(size):
        total += h[k : k + n] * np.uint64(factor)
        factor = factor * int(_PRIME) % (1 << 64)
    return mix(total)


def whole_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence."""
    return grams(h, len(h))[0] if len(h) else np.uint64(0)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct ``size``-word shingles of one document; a shorter one is a single shingle, an empty one has none."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(grams(h, min(size, len(h))))


def char_counts(part: Slice) -> np.ndarray:
    """Running count of code points before each byte, and one more entry for the end."""
    out = np.zeros(len(part.data) + 1, np.int64)
    np.cumsum((part.data & 0xC0) != 0x80, out=out[1:])
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
