"""Statistics of whole documents, computed for a slice of texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from fieldspark.llm import text

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "beyond_ascii")
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[ord(c) for c in SYMBOLS]] = 4
_CLASS[0xC0:] = 6
_CLASS[0x80:0xC0] = 7  # bytes inside a code point
_DOC = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Stats:
    words: text.Words
    n_words: np.ndarray
    word_chars: np.ndarray
    classes: np.ndarray  # documents x CLASSES, in code points
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_distinct: np.ndarray


def per_document(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over each document's stretch."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[first])


def class_totals(part: text.Slice) -> np.ndarray:
    """Code points of each class in a slice."""
    return np.bincount(_CLASS[part.data], minlength=8)[:7]


def _keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return text.mix(h + doc.astype(np.uint64) * _DOC)


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    _, first = np.unique(_keyed(h, doc), return_index=True)
    return np.bincount(doc[first], minlength=docs)


def stats(part: text.Slice) -> Stats:
    """Words are taken as they stand; equality of lines, words and windows is that of 64-bit hashes."""
    docs = len(part.offsets) - 1
    w = text.words(part, lower=False)
    doc, n_words = w.doc, np.diff(w.first)
    kind = _CLASS[part.data]
    owner = np.repeat(np.arange(docs), np.diff(part.offsets))
    classes = np.bincount(owner * 8 + kind, minlength=docs * 8).reshape(docs, 8)[:, :7]
    word_chars = classes.sum(axis=1) - classes[:, 3]

    breaks = np.flatnonzero(part.data == 0x0A)
    starts = np.sort(np.concatenate([part.offsets[:-1], breaks + 1]))
    line_doc = np.searchsorted(part.offsets, starts, "right") - 1
    inside = line_doc < docs
    # a line break that ends a document starts an empty line, which has no word
    starts, line_doc = starts[inside], line_doc[inside]
    stops = np.minimum(np.append(starts[1:], len(part.data)), part.offsets[line_doc + 1]) if len(starts) else starts
    stops = stops - ((stops > starts) & (part.data[np.maximum(stops - 1, 0)] == 0x0A)) if len(part.data) else stops
    filled = np.searchsorted(w.start, stops) > np.searchsorted(w.start, starts)
    starts, stops, line_doc = starts[filled], stops[filled], line_doc[filled]
    n_lines = np.bincount(line_doc, minlength=docs)
    lines = text.span_hashes(part.data.astype(np.uint64) + np.uint64(1), starts, stops)

    g = text.grams(w.hash, 3)
    whole = np.flatnonzero(doc[: len(g)] == doc[2:]) if len(g) else np.zeros(0, np.int64)
    _, inverse, n = np.unique(_keyed(g[whole], doc[whole]), return_inverse=True, return_counts=True)
    again = np.zeros(len(w.hash) + 1, np.int64)
    at = whole[n[inverse] > 1]
    np.add.at(again, at, 1)
    again[3:] -= again[:-3].copy()
    covered = np.cumsum(again)[:-1] > 0
    return Stats(w, n_words, word_chars, classes, classes[:, 4], n_lines, n_lines - _distinct(lines, line_doc, docs), per_document(covered, w.first), _distinct(w.hash, doc, docs))
