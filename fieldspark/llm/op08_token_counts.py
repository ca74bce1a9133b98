"""Token counts with the whole-token shortcut.

Offline, every vocabulary string is encoded alone. Those that give exactly their own token, and that the pattern does not
cut, are proven: a pre-token with that spelling is one token. Their hashes (at most one per vocabulary entry, so bounded
by the tokenizer file) go to the tasks. A task counts pre-tokens of the proven set directly and merges only the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import text
from fieldspark.llm.pretokens import Memo, pretokens, vocabulary

_BITS = 20


def proven(path: str) -> np.ndarray:
    """Hashes of the vocabulary strings that alone encode to one token and are one pre-token."""
    whole, _, ranks = vocabulary(path)
    spelled = []
    for raw, i in ranks.items():
        try:
            spelled.append((raw.decode("utf-8"), i))
        except UnicodeDecodeError:
            continue
    alone = whole.encode_batch([s for s, _ in spelled], add_special_tokens=False)
    good = [s for (s, i), e in zip(spelled, alone, strict=True) if e.ids == [i]]
    found = []
    for part in text.slices(pa.array(good)):
        t = pretokens(part)
        single = (np.diff(t.first) == 1) & ~t.special
        found.append(t.hash[t.first[:-1][single]])
    return np.concatenate(found)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_whole``: a row for every row of ``docs``.

    Counts are those of the tokenizer file at ``path`` (byte-level BPE) without added special tokens; special strings inside
    a text are single tokens, as the library has them. ``n_whole``: pre-tokens counted by the shortcut.
    Null and empty texts have no tokens; ids may be null or repeat; other columns are ignored; no rows give no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(proven(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, merge, _ = vocabulary(path)
        table = np.zeros(1 << _BITS, np.uint64)
        shift = np.uint64(64 - _BITS)
        table[known.value >> shift] = known.value  # of two in one slot one is merged as any other
        memo = Memo(merge)
        for batch in batches:
            for part in text.slices(batch.column(1)):
                t = pretokens(part)
                shortcut = table[t.hash >> shift] == t.hash
                counts = shortcut.astype(np.int64)
                rest = np.flatnonzero(~shortcut)
                counts[rest] = memo.find(t, rest)[1]
                total, direct = (np.concatenate([[0], np.cumsum(x)])[t.first] for x in (counts, shortcut))
                n, direct = np.diff(total), np.diff(direct)
                for k in np.flatnonzero(t.special):
                    n[k], direct[k] = len(whole.encode(t.document(k), add_special_tokens=False).ids), 0
                size = np.diff(part.offsets)
                yield pa.record_batch({"doc_id": batch.column(0)[part.rows], "n_bytes": size.astype(np.int64), "n_tokens": n, "over_limit": n > limit, "n_whole": direct})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
