"""Weighted acyclic automata of counted n-grams, as arrays.

An n-gram is a path of symbols, the first a group (such as a language), the others words. All paths of one automaton are of
equal length, so its states lie in layers and only the last layer is final. The weight of a path is the sum of its arcs'
weights and the base. Sorted n-grams are taken layer by layer from the last: the smallest weight of a state is pushed to the
arc before it, and a state is closed by looking it up in a register of its arcs, so equal states, whatever their prefixes
and counts, are one state.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np

from fieldspark.llm.pieces import equal, gather
from fieldspark.llm.text import mix, span_hashes

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Symbols:
    """Numbers of byte strings in the order they come."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.number)

    def of(self, strings: list[bytes]) -> np.ndarray:
        number = self.number
        return np.array([number.setdefault(s, len(number)) for s in strings], np.int64)

    def sorted(self) -> tuple[list[bytes], np.ndarray]:
        """The strings in byte order, and each number's rank in it."""
        ordered = sorted(self.number)
        rank = np.empty(len(ordered), np.int64)
        rank[[self.number[s] for s in ordered]] = np.arange(len(ordered))
        return ordered, rank


def packed(grams: np.ndarray) -> list[np.ndarray]:
    """As few unsigned columns as hold the columns of ``grams`` in order, for sorting and comparing."""
    out, used = [], 64
    for k in range(grams.shape[1]):
        column = grams[:, k].astype(np.uint64)
        bits = max(1, int(column.max(initial=0)).bit_length())
        if used + bits > 64:
            out.append(column)
            used = bits
        else:
            out[-1] = out[-1] << np.uint64(bits) | column
            used += bits
    return out


def distinct(grams: np.ndarray, weights: np.ndarray, add=np.add) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in order, their weights put together by ``add``, and where each row went."""
    if not len(grams):
        return grams, weights, np.zeros(0, np.int64)
    columns = packed(grams)
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    fresh = np.zeros(len(grams), bool)
    fresh[0] = True
    for c in columns:
        c = c[order]
        fresh[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(fresh)
    where = np.empty(len(grams), np.int64)
    where[order] = np.cumsum(fresh) - 1
    return grams[order[first]], add.reduceat(weights[order], first), where


@dataclass
class Layer:
    first: np.ndarray  # a state's first arc, and one more entry
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray


def _close(label: np.ndarray, weight: np.ndarray, target: np.ndarray, first: np.ndarray) -> tuple[Layer, np.ndarray]:
    """The layer with equal states made one, and the state that each became."""
    sizes = np.diff(np.append(first, len(label)))
    value = mix(label.astype(np.uint64) + mix(target.astype(np.uint64) + _A) * _B + mix(weight.astype(np.uint64)) * _A)
    _, one, which = np.unique(span_hashes(value, first, first + sizes), return_index=True, return_inverse=True)
    head = one[which]
    other = np.flatnonzero(head != np.arange(len(first)))
    other_head = head[other]
    same = sizes[other] == sizes[other_head]
    for column in (label, weight, target):
        k = np.flatnonzero(same)
        same[k] = equal(column, first[other[k]], column, first[other_head[k]], sizes[other[k]])
    head[other[~same]] = other[~same]  # of two states with one hash
    kept, became = np.unique(head, return_inverse=True)
    arcs = gather(np.arange(len(label)), first[kept], sizes[kept])
    return Layer(np.concatenate([[0], np.cumsum(sizes[kept])]), label[arcs], weight[arcs], target[arcs]), became


@dataclass
class Transducer:
    groups: list[bytes]  # symbols of the first layer, in byte order
    words: list[bytes]  # symbols of the others, in byte order
    layers: list[Layer]
    base: int

    @classmethod
    def build(cls, groups: list[bytes], words: list[bytes], grams: np.ndarray, weights: np.ndarray) -> Transducer:
        """From distinct rows of symbol ranks in order, at least one; only the words in use are kept."""
        used, number = np.unique(grams[:, 1:], return_inverse=True)
        heads, head = np.unique(grams[:, 0], return_inverse=True)
        grams = np.column_stack([head, number.reshape(len(grams), -1)])
        differs = np.logical_or.accumulate(grams[1:] != grams[:-1], axis=1)
        starts = [np.zeros(1, np.int64), *(np.concatenate([[0], np.flatnonzero(differs[:, d]) + 1]) for d in range(grams.shape[1]))]
        weight, target, layers = weights.astype(np.int64), np.zeros(len(grams), np.int64), []
        for d in reversed(range(grams.shape[1])):
            first = np.searchsorted(starts[d + 1], starts[d])
            low = np.minimum.reduceat(weight, first)
            rest = weight - np.repeat(low, np.diff(np.append(first, len(weight))))
            layer, target = _close(grams[starts[d + 1], d], rest, target, first)
            layers.append(layer)
            weight = low
        return cls([groups[k] for k in heads], [words[k] for k in used], layers[::-1], int(weight[0]))

    def expand(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths in order, as rows of symbol ranks, and their weights."""
        state, weight, columns = np.zeros(1, np.int64), np.full(1, self.base, np.int64), []
        for layer in self.layers:
            begin = layer.first[state]
            size = layer.first[state + 1] - begin
            arc = gather(np.arange(len(layer.label)), begin, size)
            columns = [np.repeat(c, size) for c in columns] + [layer.label[arc]]
            weight, state = np.repeat(weight, size) + layer.weight[arc], layer.target[arc]
        return np.column_stack(columns), weight

    def compose(self, other: Transducer) -> np.ndarray:
        """The weight in ``other`` of every path of this one, in order; -1 where it has none. Both are walked in step."""
        state, theirs, weight = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, other.base, np.int64)
        for d, (mine, layer) in enumerate(zip(self.layers, other.layers, strict=True)):
            known = {s: k for k, s in enumerate(other.words if d else other.groups)}
            label = np.array([known.get(s, -1) for s in (self.words if d else self.groups)], np.int64)
            begin = mine.first[state]
            size = mine.first[state + 1] - begin
            arc = gather(np.arange(len(mine.label)), begin, size)
            state, theirs, weight = mine.target[arc], np.repeat(theirs, size), np.repeat(weight, size)
            arcs = np.repeat(np.arange(len(layer.first) - 1), np.diff(layer.first)) << 32 | layer.label
            want = theirs << 32 | label[mine.label[arc]]
            at = np.minimum(np.searchsorted(arcs, want), len(arcs) - 1)
            there = (theirs >= 0) & (label[mine.label[arc]] >= 0) & (arcs[at] == want)
            weight, theirs = np.where(there, weight + layer.weight[at], -1), np.where(there, layer.target[at], -1)
        return weight

    def dump(self) -> bytes:
        """Arrays in the smallest unsigned types that hold them."""
        arrays = [np.array([self.base, len(self.groups), len(self.words)])]
        arrays += [np.array([len(s) for s in (*self.groups, *self.words)], np.int64), np.frombuffer(b"".join((*self.groups, *self.words)), np.uint8)]
        for layer in self.layers:
            arrays += [np.diff(layer.first), layer.label, layer.weight, layer.target]
        head, body = [], []
        for a in arrays:
            kind = next(t for t in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << 8 * t)
            head += [kind, len(a)]
            body.append(a.astype(f"<u{kind}").tobytes())
        return len(head).to_bytes(4, "little") + np.array(head, "<u4").tobytes() + b"".join(body)

    @classmethod
    def load(cls, raw: bytes) -> Transducer:
        n = int.from_bytes(raw[:4], "little")
        head = np.frombuffer(raw, "<u4", n, 4).tolist()
        at, arrays = 4 + 4 * n, []
        for kind, count in zip(head[::2], head[1::2]):
            arrays.append(np.frombuffer(raw, f"<u{kind}", count, at).astype(np.int64))
            at += kind * count
        (base, n_groups, _), sizes, pool = arrays[0].tolist(), arrays[1], arrays[2].astype(np.uint8).tobytes()
        ends = np.cumsum(sizes).tolist()
        strings = [pool[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        layers = [Layer(np.concatenate([[0], np.cumsum(arrays[k])]), *arrays[k + 1 : k + 4]) for k in range(3, len(arrays), 4)]
        return cls(strings[:n_groups], strings[n_groups:], layers, base)


Cut = tuple[bytes, bytes, bytes | None]  # group, first word and perhaps the second one at which a prefix range begins


def places(groups: list[bytes], words: list[bytes], grams: np.ndarray, cuts: list[Cut]) -> np.ndarray:
    """Where in sorted ``grams`` each prefix range begins; a path is before its own continuations."""
    out = np.zeros(len(cuts), np.int64)
    for k, cut in enumerate(cuts):
        lo, hi = 0, len(grams)
        for depth, symbol in enumerate(cut):
            if symbol is None:
                break
            if depth >= grams.shape[1]:
                lo = hi
                break
            strings = words if depth else groups
            rank = bisect_left(strings, symbol)
            column = grams[lo:hi, depth]
            exact = rank < len(strings) and strings[rank] == symbol
            lo, hi = lo + int(np.searchsorted(column, rank)), lo + int(np.searchsorted(column, rank, "right" if exact else "left"))
            if not exact:
                break
        out[k] = lo
    return out
