"""Rows that share a key with a neighbour in sorted order: one range shuffle, no group is gathered anywhere.

The range partitioning is on the key and the place, so a key with very many rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.store import keep_numbers


def shared(rows: DataFrame, key: str, *place: str, distinct: bool = False, hashed: bool = False) -> DataFrame:
    """The rows whose key another row has too, and at most two others of each partition, whose neighbour lies in the next one.

    ``rows`` should be a written table or cheap to make, since the range partitioning samples it first. The key is a long. ``distinct``: of rows equal in key and place one counts.
    ``hashed``: for rows that cost much to make, of which no key has very many; they are dealt by the key's hash and made once.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, alike = None, True  # the last row so far, and whether it stays; a partition's first row does
        for batch in batches:
            if not batch.num_rows:
                continue
            if distinct:
                new = np.zeros(batch.num_rows, bool)
                for c in (key, *place):
                    column = batch.column(batch.schema.get_field_index(c))
                    new[1:] |= column.to_numpy()[1:] != column.to_numpy()[:-1]
                    new[0] |= held is None or held.column(held.schema.get_field_index(c))[0].as_py() != column[0].as_py()
                batch = batch.filter(pa.array(new))
                if not batch.num_rows:
                    continue
            k = batch.column(batch.schema.get_field_index(key)).to_numpy()
            same = np.zeros(len(k) + 1, bool)
            same[1:-1] = k[1:] == k[:-1]
            if held is None:
                same[0] = True
            else:
                same[0] = held.column(held.schema.get_field_index(key))[0].as_py() == k[0]
                if alike or same[0]:
                    yield held
            stay = same[:-1] | same[1:]
            held, alike = batch.slice(batch.num_rows - 1), bool(stay[-1])
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(stay[:-1]))
        if held is not None:
            yield held

    dealt = rows.repartition(key) if hashed else rows.repartitionByRange(key, *place)
    return dealt.sortWithinPartitions(key, *place).mapInArrow(compare, rows.schema)


def later(rows: DataFrame, key: str, *place: str) -> DataFrame:
    """The rows with a ``mark``: 1 for every row whose key the row before it in sorted order has, so all but the first of a key.

    Each partition also gives its first row with mark 2 and its last with mark 3; ``settle`` decides them.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, None

        def marked(some: pa.RecordBatch, mark: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(np.full(some.num_rows, mark, np.int32)), some.columns[-1]], [*some.schema.names[:-1], "mark", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(batch.schema.get_field_index(key)).to_numpy()
            same = np.zeros(len(k), bool)
            same[1:] = k[1:] == k[:-1]
            if last is None:
                yield marked(batch.slice(0, 1), 2)
            else:
                same[0] = last.column(last.schema.get_field_index(key))[0].as_py() == k[0]
            last = batch.slice(batch.num_rows - 1)
            yield marked(batch.filter(pa.array(same)), 1)
        if last is not None:
            yield marked(last, 3)

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    dealt = rows.repartitionByRange(key, *place).sortWithinPartitions(key, *place).withColumn("part", F.spark_partition_id())
    return dealt.mapInArrow(compare, f"{kinds}, mark int, part int")


def first_places(rows: DataFrame, key: str, *place: str) -> DataFrame:
    """The rows whose key another row has too, with the place of the first of them as ``first_<column>``.

    ``rows`` is a written table without nulls in the key and the last two columns of ``place``; no two rows are equal in key and place. Rows of a partition's first and last key
    are marked, and settled from two rows a partition: a key may go on over many partitions.
    """
    names, firsts = list(place[-2:]), [f"first_{c}" for c in place[-2:]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, opening = None, None, True  # the last row so far, the place of its key's first row, whether that key is the partition's first

        def made(some: pa.RecordBatch, begun: list[np.ndarray], mark: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*some.columns[:-1], *map(pa.array, begun), pa.array(mark.astype(np.int32)), some.columns[-1]], [*some.schema.names[:-1], *firsts, "mark", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            k = batch.column(batch.schema.get_field_index(key)).to_numpy()
            own = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            begun = [x[start] for x in own]
            leading = start == 0
            if first is not None:  # the held row may not be the first of its key
                for x, v in zip(begun, first, strict=True):
                    x[leading] = v
            again = np.zeros(len(k), bool)  # alike with the row before or after it
            again[1:] |= ~new[1:]
            again[:-1] |= ~new[1:]
            again[0] |= first is not None and any(x[0] != v for x, v in zip(own, first, strict=True))
            mark = (leading & opening).astype(np.int32)
            send = np.flatnonzero((again | (mark > 0))[:-1])
            if len(send):
                yield made(batch.take(pa.array(send)), [x[send] for x in begun], mark[send])
            held, first, opening = batch.slice(len(k) - 1), [x[-1] for x in begun], opening and bool(leading[-1])
        if held is not None:
            yield made(held, [np.array([v]) for v in first], np.array([1 if opening else 2]))

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), *(f"{f} {kinds[c]}" for f, c in zip(firsts, names, strict=True)), "mark int", "part int"])
    dealt = rows.repartitionByRange(key, *place).sortWithinPartitions(key, *place).withColumn("part", F.spark_partition_id())
    marked = keep_numbers(dealt.mapInArrow(compare, schema), "places")
    # the last row of a partition stands for its last key, unless that is its first one too
    later_row = F.max(reduce(or_, [F.col(c) != F.col(f) for c, f in zip(names, firsts, strict=True)]).cast("int"))
    edges = marked.where("mark > 0").groupBy("part", "mark").agg(F.min(F.struct(key, *firsts)).alias("e"), (F.count("*") + later_row).alias("n")).collect()
    chains: list[list] = []  # a key over successive partitions: the key, rows (2 stands for more), and each partition's rows of it with the place they hold for the first
    for r in sorted(edges, key=lambda r: (r["part"], r["mark"])):
        if not chains or chains[-1][0] != r["e"][0] or r["mark"] == 2:
            chains.append([r["e"][0], 0, []])
        chains[-1][1] += r["n"]
        chains[-1][2].append((r["part"], r["mark"], *r["e"][1:]))
    wrong = [(*group[:2], n == 1, *groups[0][2:]) for _, n, groups in chains for group in groups if n == 1 or group[2:] != groups[0][2:]]
    types = [pa.int32(), pa.int32(), pa.bool_(), *({"int": pa.int32(), "bigint": pa.int64()}[kinds[c]] for c in names)]
    columns = [pa.array([w[k] for w in wrong], t) for k, t in enumerate(types)]
    right = rows.sparkSession.createDataFrame(pa.table(columns, ["part", "mark", "single", *(f"right_{c}" for c in names)]))
    settled = marked.join(F.broadcast(right), ["part", "mark"], "left").where("not coalesce(single, false)")
    return settled.select(*rows.columns, *(F.coalesce(f"right_{c}", f).alias(f) for c, f in zip(names, firsts, strict=True)))


def settle(marked: DataFrame, key: str) -> DataFrame:
    """Of a written table from ``later`` the rows that are not the first with their key.

    Only two rows of each partition are looked at on the driver; they tell where a key goes on from one partition to the next.
    """
    edges = sorted(marked.where("mark > 1").select("part", "mark", key).collect())
    ends = {r["part"]: r[key] for r in edges if r["mark"] == 3}
    go_on, before = [], None
    for r in edges:
        if r["mark"] == 2:
            if before is not None and ends[before] == r[key]:
                go_on.append(r["part"])
            before = r["part"]
    chosen = (F.col("mark") == 1) | ((F.col("mark") == 2) & F.col("part").isin(go_on))
    return marked.where(chosen).drop("mark", "part")
