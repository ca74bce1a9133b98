"""A Bloom filter over ids, to leave most rows of a large table out of a join's shuffle.

The filter has a fixed size of ``BITS`` bits whatever the table, so it may be sent to the tasks. It only ever lets too much
through: the join that follows decides. With very many ids it lets everything through, and the join is a plain one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from fieldspark.llm.store import forget, keep_numbers
from fieldspark.llm.text import mix

BITS = 26


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.view(np.uint64) + np.uint64(0xA0761D6478BD642F))
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def build(ids: DataFrame) -> Broadcast:
    """The filter of a one-column table of longs; words of 64 bits are combined in the tasks and by a shuffle."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = _places(batch.column(0).drop_null().to_numpy())
            at = np.concatenate([one, two])
            yield pa.record_batch({"word": at >> 6, "bit": np.left_shift(np.int64(1), at & 63)})

    # written, since what a write shuffles is removed with it
    written = keep_numbers(ids.mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")), "filter")
    words = written.toArrow()
    forget(written)
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(table)


def hits(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """False where an id is certainly not in the filter."""
    one, two = _places(ids)
    return ((table[one >> 6] >> (one & 63)) & (table[two >> 6] >> (two & 63)) & 1).astype(bool)


def maybe(rows: DataFrame, column: str, filter_: Broadcast) -> DataFrame:
    """``rows`` with the flag ``_maybe``: false where the long in ``column`` is certainly not among the ids, or null."""
    at = rows.columns.index(column)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filter_.value
        for batch in batches:
            hit = hits(table, batch.column(at).fill_null(0).to_numpy()) & batch.column(at).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, "_maybe"])

    return rows.mapInArrow(flag, StructType([*rows.schema.fields, StructField("_maybe", BooleanType())]))


def semi(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``ids`` (a written table with one column)."""
    passed = maybe(rows, column, build(ids)).where("_maybe").drop("_maybe")
    return passed.join(ids.select(F.col(ids.columns[0]).alias("_id")), F.col(column) == F.col("_id"), "left_semi")


def anti(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` is not among ``ids`` (a written table with one column), nulls included."""
    flagged = maybe(rows, column, build(ids))
    rest = flagged.where("_maybe").drop("_maybe").join(ids.select(F.col(ids.columns[0]).alias("_id")), F.col(column) == F.col("_id"), "left_anti")
    return flagged.where("not _maybe").drop("_maybe").unionByName(rest)
