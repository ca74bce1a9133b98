"""Packing tokenised documents into sequences with a grouping genetic algorithm.

A document's ids are cut into pieces of at most one sequence; pieces that fill a sequence are done. The rest is dealt into
shards of about ``SHARD`` pieces. For every shard several islands evolve packings of the same pieces, each in its own task:
crossover injects whole well-filled bins of one parent into the other, bins that would hold a piece twice are taken apart,
and displaced pieces go in by best fit. Between epochs each island's elite moves to the next island through a join.
Of the best packing of a shard the least filled tenth of the bins is pooled with those of the other shards and packed
again in the same way, until the pool fits in one shard. So each level is a tenth of the one before, whatever the size.

Only lengths take part in the search; pieces of one length are interchangeable. Ids never leave the task that made them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import text
from fieldspark.llm.pretokens import Memo, pretokens, vocabulary
from fieldspark.llm.store import keep

SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS, POOLED = 4096, 2, 2, 5, 5, 0.1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", bin long, fill long, offset long"


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, size: int, end_id: int) -> DataFrame:
    """The pieces of every document with the checksum of their ids; the first may be shorter than the others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, merge, _ = vocabulary(path)
        memo = Memo(merge)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in text.slices(batch.column(1)):
                t = pretokens(part)
                stream, edge = memo.ids(t)
                rows = []
                for k, doc in enumerate(ids[part.rows]):
                    own = stream[edge[k] : edge[k + 1]] if not t.special[k] else np.array(whole.encode(t.document(k), add_special_tokens=False).ids, np.uint32)
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    at = 0
                    for n, stop in enumerate(range((len(own) - 1) % size + 1, len(own) + 1, size)):
                        rows.append((doc, n, at, stop - at, zlib.crc32(own[at:stop])))
                        at = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE)


def best_fit(lengths: list[int], size: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Best fit of ``lengths`` in the given order into new bins, or into copies of ``bins`` first. Room is kept as a bit set."""
    out = [list(b) for b in bins or ()]
    room: list[list[int]] = [[] for _ in range(size + 1)]
    free = 0
    for k, b in enumerate(out):
        left = size - sum(b)
        room[left].append(k)
        free |= 1 << left
    for x in lengths:
        fits = free >> x
        if fits:
            left = x + (fits & -fits).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                free ^= 1 << left
            out[k].append(x)
        else:
            k, left = len(out), size
            out.append([x])
        room[left - x].append(k)
        free |= 1 << (left - x)
    return out


def fitness(packing: list[list[int]]) -> tuple[int, int]:
    """Fewer bins first, then fuller ones: smaller is better."""
    return len(packing), -sum(sum(b) ** 2 for b in packing)


def crossover(one: list[list[int]], two: list[list[int]], size: int, rng: np.random.Generator) -> list[list[int]]:
    """Bins of ``one``, the well-filled ones most likely, put into ``two``; its bins that lose a piece are taken apart."""
    take = rng.random(len(one))
    injected = [b for b, r in zip(one, take.tolist(), strict=True) if r < 0.5 * (sum(b) / size) ** 8]
    taken = [0] * (size + 1)  # pieces of each length that the rest must give up
    for b in injected:
        for x in b:
            taken[x] += 1
    kept, displaced = [], []
    for b in sorted(two, key=sum):  # the least filled bins give first
        if any(taken[x] for x in b):
            for x in b:
                if taken[x]:
                    taken[x] -= 1
                else:
                    displaced.append(x)
        else:
            kept.append(b)
    displaced.sort(reverse=True)
    return best_fit(displaced, size, injected + kept)


def evolve(lengths: list[int], size: int, elites: list[list[list[int]]], rng: np.random.Generator) -> list[list[list[int]]]:
    """One epoch of an island: its two best packings, best first."""
    people = [*elites]
    if not people:
        people.append(best_fit(sorted(lengths, reverse=True), size))
    noise = size / 64
    while len(people) < POPULATION:
        key = np.asarray(lengths) + rng.normal(0, noise, len(lengths))
        people.append(best_fit([lengths[i] for i in np.argsort(-key, kind="stable").tolist()], size))
    people.sort(key=fitness)
    least = -(-sum(lengths) // size)
    for _ in range(GENERATIONS):
        if len(people[0]) == least:
            break
        a, b = sorted(rng.choice(len(people), 2, replace=False).tolist())
        for one, two in ((a, b), (b, a)):
            people.append(crossover(people[one], people[two], size, rng))
        people = sorted(people, key=fitness)[:POPULATION]
    return people[:2]


def _dump(people: list[list[list[int]]]) -> list[list[int]]:
    """A packing as a flat list: each bin's count of pieces, then their lengths."""
    return [[x for b in p for x in (len(b), *b)] for p in people]


def _load(flat: list[int]) -> list[list[int]]:
    out, at = [], 0
    while at < len(flat):
        out.append(flat[at + 1 : at + 1 + flat[at]])
        at += 1 + flat[at]
    return out


def _epoch(islands: DataFrame, size: int, epoch: int) -> DataFrame:
    """``shard, island, lengths, elites`` to ``shard, island, elites, bins, waste``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = np.random.default_rng([row["shard"], row["island"], epoch])
                people = evolve(row["lengths"], size, [_load(e) for e in row["elites"] or ()], rng)
                bins, waste = fitness(people[0])
                yield pa.RecordBatch.from_pylist(
                    [{"shard": row["shard"], "island": row["island"], "elites": _dump(people), "bins": bins, "waste": waste}],
                    pa.schema([("shard", pa.int32()), ("island", pa.int32()), ("elites", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int64()), ("waste", pa.int64())]),
                )

    return islands.mapInArrow(run, "shard int, island int, elites array<array<int>>, bins long, waste long")


def _level(items: DataFrame, count: int, size: int, level: int) -> DataFrame:
    """Every item with its bin, the bin's fill and the item's offset; ``done`` tells whether the bin stays as it is."""
    shards = -(-count // SHARD)
    whole = F.collect_list(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("items")
    dealt = items.repartition(shards).withColumn("shard", F.spark_partition_id()).groupBy("shard").agg(whole)
    dealt = keep(dealt, "shards")
    lengths = dealt.select("shard", F.transform("items", lambda x: x["length"].cast("int")).alias("lengths"))
    islands = lengths.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).withColumn("elites", F.lit(None).cast("array<array<int>>"))
    tasks = shards * ISLANDS
    best = keep(_epoch(islands.repartition(tasks, "shard", "island"), size, 0), "islands")
    for epoch in range(1, EPOCHS):
        guests = best.select("shard", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.slice("elites", 1, 1).alias("guests"))
        mixed = best.join(guests, ["shard", "island"]).join(lengths, "shard").select("shard", "island", "lengths", F.concat("elites", "guests").alias("elites"))
        best = keep(_epoch(mixed.repartition(tasks, "shard", "island"), size, epoch), "islands")
    best = best.groupBy("shard").agg(F.min_by(F.col("elites")[0], F.struct("bins", "waste", "island")).alias("packing"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                by_length: dict[int, list[dict]] = {}
                for item in row["items"]:
                    by_length.setdefault(item["length"], []).append(item)
                packing = sorted(_load(row["packing"]), key=sum)
                pooled = int(len(packing) * POOLED) if shards > 1 else 0
                out = []
                for k, b in enumerate(packing):
                    fill = sum(b)
                    at = 0
                    for x in b:
                        out.append(by_length[x].pop() | {"bin": (level << 56) + (row["shard"] << 24) + k, "fill": fill, "offset": at, "done": k >= pooled or fill == size})
                        at += x
                yield pa.RecordBatch.from_pylist(out, _PLACED)

    return dealt.join(best, "shard").mapInArrow(place, PLACED + ", done boolean")


_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "bin", "fill", "offset")], ("done", pa.bool_())])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: a row for every piece of every document.

    A document is its ids by the tokenizer file at ``path`` and then ``end_id``; only longer ones than ``size`` are cut.
    A null or empty text is the end id alone. Every row of ``docs`` is packed, also where ids repeat or are null; other columns
    are ignored; no rows give no rows.
    """
    cut = keep(pieces(docs, path, id_col, text_col, size, end_id), "pieces")
    full = cut.where(F.col("length") == size)
    out = [full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))]
    items = cut.where(F.col("length") < size)
    count, level = items.count(), 0
    while count:
        placed = keep(_level(items, count, size, level), "packed")
        out.append(placed.where("done").drop("done", "fill").withColumnRenamed("bin", "sequence_id"))
        items = placed.where("not done").select("doc_id", "piece", "start", "length", "ids_crc32")
        count, level = items.count(), level + 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    packed = out[0].select(columns)
    for more in out[1:]:
        packed = packed.unionByName(more.select(columns))
    return packed
