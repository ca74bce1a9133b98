"""Pre-tokens of the byte-level BPE, cut on whole slices of text with array operations.

The tokenizer's pattern splits text into contractions, runs of letters, digits or other signs with one leading space, and
white space. Here the runs come from a class per code point, and the exceptions (spaces, contractions) are edits of the
run starts. A document whose code points have no settled class here, or that contains a special token, is left to the
tokenizer itself.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np

from fieldspark.llm.text import Slice, char_counts, span_hashes

OTHER, LETTER, DIGIT, SPACE, UNSETTLED = range(5)
SETTLED = 0x3000
# White space of Unicode. Fixed values.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
SPECIAL = "<|endoftext|>"


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(SETTLED + 1, UNSETTLED, np.uint8)
    for cp in range(SETTLED):
        kind = unicodedata.category(chr(cp))
        out[cp] = LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else UNSETTLED if kind in ("Cn", "Cs") else OTHER
    out[_WHITE] = SPACE
    out[0] = UNSETTLED  # parts the pre-tokens that are merged in one call
    return out


@dataclass
class PreTokens:
    text: str  # of the whole slice
    code: np.ndarray  # its code points
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # a document's first pre-token, and one more entry
    edges: np.ndarray  # a document's first code point, and one more entry
    special: np.ndarray  # documents to be left to the tokenizer

    def spell(self, which: np.ndarray) -> str:
        """Pre-tokens, each closed by a NUL."""
        size = self.end[which] - self.start[which] + 1
        upto = np.cumsum(size)
        codes = self.code[np.minimum(np.repeat(self.start[which] - upto + size, size) + np.arange(upto[-1]), len(self.code) - 1)]
        codes[upto - 1] = 0
        return codes.tobytes().decode("utf-32-le", "surrogatepass")

    def document(self, k: int) -> str:
        return self.text[self.edges[k] : self.edges[k + 1]]


def pretokens(part: Slice) -> PreTokens:
    whole = part.data.tobytes().decode("utf-8", "replace")
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = char_counts(part)[part.offsets]
    n = len(code)
    kind = _classes()[np.minimum(code, SETTLED)]
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[edges[:-1]] = True
    start[n] = True

    runs = np.flatnonzero(start)
    a, b = runs[:-1], runs[1:]
    white = (kind[a] == SPACE) & (b < n) if n else np.zeros(0, bool)
    ends = np.zeros(n + 1, bool)
    ends[edges] = True
    white &= ~ends[b]  # at a document's end the run stays whole
    last = b[white] - 1
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False

    mark = np.flatnonzero((code == 0x27) & start[:n]) if n else np.zeros(0, np.int64)
    mark = mark[(mark + 1 < n)]
    mark = mark[~ends[mark + 1]]
    after = np.zeros((len(mark), 2), np.uint32)
    after[:, 0] = code[mark + 1]
    two = (mark + 2 < n) & ~ends[np.minimum(mark + 2, n)]
    after[two, 1] = code[mark[two] + 2]
    one = np.isin(after[:, 0], [ord(c) for c in "stmd"])
    pair = ((after[:, 1] == ord("e")) & np.isin(after[:, 0], [ord("r"), ord("v")])) | ((after[:, 0] == ord("l")) & (after[:, 1] == ord("l")))
    for chosen, size in ((one, 2), (pair, 3)):
        start[mark[chosen] + 1] = False
        start[mark[chosen] + size] = True

    starts = np.flatnonzero(start[:n])
    stops = np.append(starts[1:], n) if n else starts
    odd = np.flatnonzero(kind == UNSETTLED)
    special = np.zeros(len(edges) - 1, bool)
    special[np.searchsorted(edges, odd, "right") - 1] = True
    at = whole.find(SPECIAL)
    while at >= 0:
        special[np.searchsorted(edges, at, "right") - 1] = True
        at = whole.find(SPECIAL, at + 1)
    mine = ~np.repeat(special, np.diff(np.searchsorted(starts, edges)))
    starts, stops = starts[mine], stops[mine]  # none of a document that the tokenizer itself gets
    return PreTokens(whole, code, starts, stops, span_hashes(code.astype(np.uint64) + np.uint64(1), starts, stops), np.searchsorted(starts, edges), edges, special)


class Memo:
    """Ids of pre-tokens already seen in this task, by hash; bounded, and refilled when another pre-token took the slot."""

    def __init__(self, encode, bits: int = 20, pool: int = 1 << 22):
        self.encode, self.shift, self.limit = encode, np.uint64(64 - bits), pool
        self.keys, self.at, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, tokens: PreTokens, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the pre-tokens ``which`` begin in the pool, and how many there are."""
        if self.used > self.limit:
            self.keys[:], self.used = 0, 0
        h = tokens.hash[which]
        slot = h >> self.shift
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            ids, sizes = self.encode(tokens.spell(which[miss[first]]))
            begin = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            if self.used > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), self.used), np.uint32)])
            self.pool[begin[0] : self.used] = ids
            at[miss], size[miss] = begin[inverse], sizes[inverse]
            self.keys[slot[miss]], self.at[slot[miss]], self.size[slot[miss]] = h[miss], at[miss], size[miss]
        return at, size

    def ids(self, tokens: PreTokens) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in order, and where each document's begin (one more entry)."""
        at, size = self.find(tokens, np.arange(len(tokens.start)))
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        return self.pool[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])], upto[tokens.first]


@functools.cache
def vocabulary(path: str):
    """The tokenizer itself, the merges of pre-tokens by the same vocabulary, and the bytes of its tokens."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    # the printable stand-ins of bytes: themselves where printable, else shifted by 256 in order
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
    ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items() if word != SPECIAL}
    merges = tiktoken.Encoding("pretoken", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})
    part = ranks[b"\x00"]

    def merge(spelled: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that are each closed by a NUL, and how many each has."""
        ids = np.asarray(merges.encode_to_numpy(spelled, disallowed_special=()), np.uint32)
        stops = np.flatnonzero(ids == part)
        return ids[ids != part], np.diff(stops, prepend=-1) - 1

    return whole, merge, ranks
