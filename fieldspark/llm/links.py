"""From bucket memberships to verified links between items, without emitting all pairs of a bucket.

1. Every member of a bucket is checked against the bucket's smallest id: one pair per membership.
2. The links found so far give components. A bucket whose members lie in one component can add nothing and is dropped.
3. The buckets left over are compared member by member inside tasks, on packed signatures; members with a likely partner in
   another component stay, and are compared once more on their full sets, again inside tasks. Only links leave a task, at most
   as many as join its components. A large bucket is split into blocks, and a task holds two blocks at a time.

So a group of near copies costs rows for its members, never for its pairs, and no link that the buckets contain is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.graph import components
from fieldspark.llm.store import keep

BLOCK = 512  # members of one block; larger buckets are compared block against block
PAIRS = "a long, b long"
Likely = Callable[[np.ndarray, np.ndarray], np.ndarray]
Verify = Callable[[DataFrame], DataFrame]


def bucket_members(rows: DataFrame) -> DataFrame:
    """``key, n, pivot, id`` of ``key, id`` rows whose key has two ids at least."""
    rows = rows.distinct()
    top = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top"), F.count("*").alias("n")).where("pivot < top").drop("top")
    return rows.join(top, "key").select("key", "n", "pivot", "id")


def _blocks(rows: DataFrame) -> DataFrame:
    """Deal ``key, n, id, …`` rows to pairs of blocks ``lo, hi`` of a bucket, sorted: every two members meet in one of them."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.hash("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("blocks", "other")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    lo, hi, own = group["lo"][0].as_py(), group["hi"][0].as_py(), group["own"].to_numpy()
    return np.flatnonzero(own == lo), np.flatnonzero(own == hi), lo == hi


def mixed_buckets(members: DataFrame, linked: DataFrame) -> DataFrame:
    """``key, n, id, component`` of the buckets whose members lie in several components. Buckets of two were settled by the first step."""
    rows = members.where("n > 2").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return rows.join(mixed, "key").select("key", "n", "id", "component")


def likely_members(mixed: DataFrame, signatures: DataFrame, likely: Likely) -> DataFrame:
    """The rows of ``mixed`` that have a likely partner in another component and meet it in no earlier band.

    ``signatures``: ``id, bands, sig``.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ("key", "lo", "hi")):
            ids, comp = group["id"].to_numpy(), group["component"].to_numpy()
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(ids), -1)
            bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            before = bands[:, : int((bands[0] == group["key"][0].as_py()).argmax())]
            left, right, one = _sides(group)
            hot = np.zeros(len(ids), bool)
            for i in left:
                against = right[right > i] if one else right
                against = against[comp[against] != comp[i]]
                against = against[likely(sig[i], sig[against])] if len(against) else against
                against = against[~(before[against] == before[i]).any(axis=1)] if len(against) else against
                if len(against):
                    hot[i] = True
                    hot[against] = True
            yield pa.RecordBatch.from_arrays([group[c].combine_chunks().filter(pa.array(hot)) for c in ("key", "n", "id", "component")], ["key", "n", "id", "component"])

    return _blocks(mixed.join(signatures, "id")).select("key", "lo", "hi", "own", "n", "id", "component", "bands", "sig").mapInArrow(compare, "key long, n long, id long, component long").distinct()


def last_links(rows: DataFrame, sets: DataFrame, likely: Likely, percent: int) -> DataFrame:
    """``a, b``: links between different components of a bucket, on full sets (``id, sig, shingles``), as many as join them.

    Within a task components that a link has joined are one from then on, so a group gives no more links than it has members.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ("key", "lo", "hi")):
            ids, comp = group["id"].to_numpy(), group["component"].to_numpy().copy()
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(ids), -1)
            full = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
            size = np.array([len(s) for s in full])
            left, right, one = _sides(group)
            out = []
            for i in left:
                against = right[right > i] if one else right
                against = against[comp[against] != comp[i]]
                against = against[likely(sig[i], sig[against])] if len(against) else against
                for at in range(0, len(against), 64):
                    some = against[at : at + 64]
                    some = some[comp[some] != comp[i]]
                    if not len(some):
                        continue
                    flat = np.concatenate([full[k] for k in some])
                    hit = full[i][np.minimum(np.searchsorted(full[i], flat), size[i] - 1)] == flat
                    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[some]) - size[some])
                    for k in some[100 * both >= percent * (size[some] + size[i] - both)]:
                        if comp[k] != comp[i]:
                            out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                            comp[comp == comp[k]] = comp[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return _blocks(rows.join(sets, "id")).select("key", "lo", "hi", "own", "id", "component", "sig", "shingles").mapInArrow(compare, PAIRS).distinct()


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys of rows sorted by them; a run may go on in the next batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if rest:
            last = rest[-1]
            change[0] = any(last.column(last.schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True))
        cuts = [0, *np.flatnonzero(change[0:]).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:], strict=False):
            if change[at] and rest:
                yield pa.Table.from_batches(rest)
                rest = []
            if end > at:
                rest.append(batch.slice(at, end - at))
    if rest:
        yield pa.Table.from_batches(rest)


def all_links(members: DataFrame, signatures: DataFrame, likely: Likely, verify: Verify, full_sets: Verify, percent: int, known: DataFrame | None = None) -> DataFrame:
    """``node, component`` of the items that have a verified link.

    ``signatures``: ``id, bands, sig``. ``verify`` takes and returns pairs ``a, b``; ``full_sets`` takes a written table of ids and gives
    ``id, shingles``; ``known``: links to add.
    """
    stars = members.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    first = verify(stars)
    first = keep(first.unionByName(known) if known is not None else first, "links")
    linked = keep(components(first), "linked")
    mixed = keep(mixed_buckets(members, linked), "mixed")
    rows = keep(likely_members(mixed, signatures, likely), "likely")
    sets = full_sets(keep(rows.select("id").distinct(), "ids")).join(signatures.select("id", "sig"), "id")
    more = keep(last_links(rows, sets, likely, percent), "links")
    return components(first.unionByName(more))
