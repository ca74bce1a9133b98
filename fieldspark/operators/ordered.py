"""Ordered computations whose groups may be arbitrarily large.

A plain window partitioned by video puts a whole video into one task. That is right
while groups are small and one shuffle does it. When the largest group exceeds
``HUGE_GROUP`` rows, every group is cut along its order column into chunks, the
window runs per (group, chunk), and one small row per chunk carries the state of
everything before it. The two results meet in a join on (group, chunk), for which
the big side is already partitioned. ``chunk`` must not decrease along the order.

The size is measured by one map-side combined count, or passed in as ``huge`` by
jobs that run several ordered steps over the same groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.session import cut_lineage

FRAMES_PER_CHUNK = 65_536
HUGE_GROUP = 4_000_000


@dataclass(frozen=True)
class Carry:
    """One output column: how it looks inside a chunk and across chunks."""

    local: Callable
    summary: Callable
    across: Callable
    combine: Callable
    backward: bool = False
    alone: Callable = lambda local: local  # noqa: E731 - the value when one window holds the group


def _position(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(name) for name in order])


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _upto(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def row_index() -> Carry:
    """0-based position inside the group."""
    return Carry(
        local=lambda w, order: F.row_number().over(w).cast("long") - 1,
        summary=lambda order: F.count(F.lit(1)),
        across=lambda w, s: F.coalesce(F.sum(s).over(_before(w)), F.lit(0)),
        combine=lambda a, b: a + b,
    )


def running_sum(value: Column) -> Carry:
    """Sum of all rows up to and including the current one."""
    return Carry(
        local=lambda w, order: F.sum(value).over(_upto(w)),
        summary=lambda order: F.sum(value),
        across=lambda w, s: F.sum(s).over(_before(w)),
        combine=lambda a, b: F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0))),
    )


def max_before(value: Column) -> Carry:
    """Largest value among all earlier rows."""
    return Carry(
        local=lambda w, order: F.max(value).over(_before(w)),
        summary=lambda order: F.max(value),
        across=lambda w, s: F.max(s).over(_before(w)),
        combine=lambda a, b: F.greatest(a, b),
    )


def last_value(value: Column) -> Carry:
    """Latest non-null value at or before the current row."""
    return Carry(
        local=lambda w, order: F.last(value, ignorenulls=True).over(_upto(w)),
        summary=lambda order: F.max_by(value, F.when(value.isNotNull(), _position(order))),
        across=lambda w, s: F.last(s, ignorenulls=True).over(_before(w)),
        combine=lambda a, b: F.coalesce(a, b),
    )


def next_value(value: Column) -> Carry:
    """Earliest non-null value at or after the current row."""
    return Carry(
        local=lambda w, order: F.last(value, ignorenulls=True).over(_upto(w)),
        summary=lambda order: F.min_by(value, F.when(value.isNotNull(), _position(order))),
        across=lambda w, s: F.last(s, ignorenulls=True).over(_before(w)),
        combine=lambda a, b: F.coalesce(a, b),
        backward=True,
    )


def previous(value: Column) -> Carry:
    """Value of the row just before, null on the first row."""
    boxed = F.struct(value.alias("v"))
    return Carry(
        local=lambda w, order: F.lag(boxed).over(w),
        summary=lambda order: F.max_by(boxed, _position(order)),
        across=lambda w, s: F.lag(s).over(w),
        combine=lambda a, b: F.coalesce(a, b)["v"],
        alone=lambda local: local["v"],
    )


def following(value: Column) -> Carry:
    """Value of the row just after, null on the last row."""
    boxed = F.struct(value.alias("v"))
    return Carry(
        local=lambda w, order: F.lag(boxed).over(w),
        summary=lambda order: F.min_by(boxed, _position(order)),
        across=lambda w, s: F.lag(s).over(w),
        combine=lambda a, b: F.coalesce(a, b)["v"],
        backward=True,
        alone=lambda local: local["v"],
    )


def whole_sum(value: Column) -> Carry:
    """Sum over the entire group."""
    return _whole(F.sum, value)


def whole_max(value: Column) -> Carry:
    """Maximum over the entire group; a struct led by the order column gives its last row."""
    return _whole(F.max, value)


def whole_min(value: Column) -> Carry:
    """Minimum over the entire group."""
    return _whole(F.min, value)


def _whole(fn: Callable, value: Column) -> Carry:
    everything = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return Carry(
        local=lambda w, order: fn(value).over(everything(w)),
        summary=lambda order: fn(value),
        across=lambda w, s: fn(s).over(everything(w)),
        combine=lambda a, b: b,
    )


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the biggest group; only the key columns are read."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def frame_chunks(column: str = "frame_index", rows: int = FRAMES_PER_CHUNK) -> Column:
    """Chunks of a dense per-video index: at most ``rows`` index values each."""
    return F.floor(F.col(column) / F.lit(rows)).cast("long")


def balanced_chunks(df: DataFrame, column: str, rows: int = 4_000_000, pieces: int = 512) -> Column:
    """Chunks of an arbitrary numeric order column, cut at its own quantiles.

    Whatever the skew, a chunk holds about ``1/pieces`` of the table over *all*
    groups, so no (group, chunk) can be larger. Only the cut points (at most
    ``pieces`` numbers) reach the driver.
    """
    steps = [i / pieces for i in range(1, pieces)]
    n, cuts = df.agg(
        F.count(F.lit(1)), F.percentile_approx(F.col(column), [float(s) for s in steps], 10 * pieces)
    ).first()
    if n <= rows or not cuts:
        return F.lit(0).cast("long")
    wanted = min(pieces, -(-n // rows))
    step = max(1, pieces // wanted)
    bounds = sorted(set(cuts[step - 1 :: step]))
    edges = F.array(*[F.lit(b) for b in bounds])
    return F.size(F.filter(edges, lambda edge: edge < F.col(column))).cast("long")


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column | Callable[[DataFrame], Column],
    huge: bool | None = None,
    **outputs: Carry,
) -> DataFrame:
    """Add ordered columns to ``df``; ``by`` and ``order`` must not be null and order must be unique per group.

    ``chunk`` is only used for huge groups. The chunked table is then written once to
    the shared folder, hashed by (group, chunk), because both sides of the join read it.
    """
    by, order = list(by), list(order)
    if huge is None:
        huge = largest_group(df, by) > HUGE_GROUP
    kept = [name for name in df.columns if name not in outputs]
    descending = [F.col(name).desc() for name in order]
    if not huge:
        ahead, behind = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by).orderBy(*descending)
        boxed = df.select("*", *[c.local(behind if c.backward else ahead, order).alias(f"_local_{n}") for n, c in outputs.items()])
        return boxed.select(*kept, *[c.alone(F.col(f"_local_{n}")).alias(n) for n, c in outputs.items()])
    keys = [*by, "_chunk"]
    column = chunk(df) if callable(chunk) else chunk
    chunked = cut_lineage(df.withColumn("_chunk", column).repartition(*keys))
    ahead = Window.partitionBy(*keys).orderBy(*order)
    behind = Window.partitionBy(*keys).orderBy(*descending)
    local = chunked.select(
        "*",
        *[c.local(behind if c.backward else ahead, order).alias(f"_local_{n}") for n, c in outputs.items()],
    )
    parts = chunked.groupBy(*keys).agg(*[c.summary(order).alias(f"_part_{n}") for n, c in outputs.items()])
    chunks_ahead = Window.partitionBy(*by).orderBy("_chunk")
    chunks_behind = Window.partitionBy(*by).orderBy(F.col("_chunk").desc())
    carried = parts.select(
        *keys,
        *[
            c.across(chunks_behind if c.backward else chunks_ahead, F.col(f"_part_{n}")).alias(f"_carry_{n}")
            for n, c in outputs.items()
        ],
    )
    return local.join(carried, keys, "left").select(
        *kept, *[c.combine(F.col(f"_local_{n}"), F.col(f"_carry_{n}")).alias(n) for n, c in outputs.items()]
    )


_RADIX = 16  # bits settled by one pass


def _ordered_bits(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; NaN is the largest, both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _with_bits(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    names = list(by)
    schema = T.StructType([*[f for f in df.schema.fields if f.name in names], T.StructField("_bits", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.ascontiguousarray(batch.column(len(names)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(_ordered_bits(values))], [*names, "_bits"])

    return df.select(*names, F.col(value).cast("double").alias("_value")).mapInArrow(run, T.StructType([schema[n] for n in names] + [schema["_bits"]]))


def _from_bits(rows: DataFrame) -> DataFrame:
    """Replace the ordered bits in ``_bits`` by their double."""
    names = [c for c in rows.columns if c != "_bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(batch.schema.get_field_index("_bits")).to_numpy()
            values = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(values)], [*names, "_value"])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[n] for n in names], T.StructField("_value", T.DoubleType())]))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles per group, as rows (by…, probability, value); nulls do not count.

    Ranks are found by radix selection, whatever the size of a group. A pass counts the rows of each group by the leading
    16 bits of their value (in an order-preserving form); the running counts tell which bucket holds a wanted rank, and
    the next pass counts only the rows of those buckets by the next 16 bits. Four passes settle a double. No values
    are sorted or collected: a group has at most 65536 counts in a pass and two wanted ranks for each probability.
    """
    by = list(by)
    keyed = _with_bits(df.where(F.col(value).isNotNull()), by, value)
    levels = F.array(*[F.lit(float(p)) for p in probabilities])
    wanted = None
    for step in range(64 // _RADIX):
        shift = 64 - _RADIX * (step + 1)
        rows = keyed.withColumn("_part", F.shiftright("_bits", shift))
        held = []
        if wanted is not None:
            held = ["_held"]
            chosen = wanted.select(*by, F.col("_part").alias("_held")).distinct()
            rows = rows.withColumn("_held", F.shiftright("_bits", shift + _RADIX)).join(chosen, [*by, "_held"], "left_semi")
        counts = rows.groupBy(*by, *held, "_part").agg(F.count(F.lit(1)).alias("_n"))
        inside = Window.partitionBy(*by, *held)
        upto = F.sum("_n").over(inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.select("*", upto.alias("_upto"))
        if wanted is None:
            total = F.sum("_n").over(inside)
            at = F.transform(levels, lambda p: p * (F.col("_total") - 1))
            ends = F.flatten(F.transform(at, lambda a: F.array(F.floor(a), F.ceil(a))))
            # a bucket takes the ranks that fall into it
            taken = F.filter(F.transform(ends, lambda rank, k: F.struct(k.alias("k"), rank.alias("rank"))), lambda e: (e["rank"] >= F.col("_upto") - F.col("_n")) & (e["rank"] < F.col("_upto")))
            ranked = counts.withColumn("_total", total)
            wanted = ranked.select(*by, "_part", "_total", "_upto", "_n", F.explode(taken).alias("_e")).select(*by, "_part", "_total", F.col("_e.k").alias("_k"), (F.col("_e.rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"))
        else:
            before = wanted.select(*by, F.col("_part").alias("_held"), "_total", "_k", "_rank")
            met = counts.join(before, [*by, "_held"]).where((F.col("_rank") >= F.col("_upto") - F.col("_n")) & (F.col("_rank") < F.col("_upto")))
            wanted = met.select(*by, "_part", "_total", "_k", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"))
    found = _from_bits(wanted.select(*by, "_total", "_k", F.col("_part").alias("_bits")))
    low = F.max(F.when(F.col("_k") % 2 == 0, F.col("_value")))
    high = F.max(F.when(F.col("_k") % 2 == 1, F.col("_value")))
    paired = found.groupBy(*by, F.expr("_k div 2").alias("_p")).agg(low.alias("_low"), high.alias("_high"), F.max("_total").alias("_total"))
    at = F.col("probability") * (F.col("_total") - 1)
    named = paired.withColumn("probability", F.element_at(levels, (F.col("_p") + 1).cast("int")))
    return named.select(*by, "probability", (F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at))).alias(value))


PARTS = 4096  # of an entry's values in one pass of array_quantiles


def array_quantiles(df: DataFrame, column: str, size: int, probabilities: Sequence[float]) -> list[list[float]]:
    """The quantiles of :func:`exact_quantiles` for every entry of an array of ``size`` numbers, in few passes over the arrays as they are.

    A pass counts the values of the intervals that hold a wanted rank in equal parts, with each part's lowest and highest value; these are the
    next pass's intervals, until a wanted rank lies in an interval of one value. A pass gives at most ``PARTS`` rows for an entry, whatever
    the table, and no values are sorted but those of a batch. Runs jobs at once. Null arrays, NaN and infinite values do not count.
    """
    found: list[dict[int, float]] = [{} for _ in range(size)]
    total, ranks = [0] * size, [[0] for _ in range(size)]
    # of every entry the intervals: lowest and highest value, values below it
    spans = [[(-np.finfo(float).max, np.finfo(float).max, 0)] for _ in range(size)]
    parts = 1
    while any(spans):
        ends = [tuple(np.array(x) for x in zip(*own, strict=True)) if own else None for own in spans]
        counts = _count_parts(df, column, ends, parts)
        entry, span, n, low, high = (counts.column(c).to_numpy() for c in ("entry", "span", "n", "low", "high"))
        spans = [[] for _ in range(size)]
        for k in np.unique(entry).tolist():
            own = np.flatnonzero(entry == k)
            if parts == 1:
                total[k] = int(n[own].sum())
                ranks[k] = sorted({end for p in probabilities for end in (math.floor(p * (total[k] - 1)), math.ceil(p * (total[k] - 1)))})
            inside = np.cumsum(n[own]) - n[own]
            first = np.searchsorted(span[own], span[own])  # the first part of the same interval
            below = ends[k][2][span[own]] + inside - inside[first]
            for at in np.unique(np.searchsorted(below, ranks[k], "right") - 1).tolist():
                held = [r for r in ranks[k] if below[at] <= r < below[at] + n[own][at]]
                if low[own][at] == high[own][at]:
                    found[k].update(dict.fromkeys(held, float(low[own][at])))
                elif held:
                    spans[k].append((low[own][at], high[own][at], int(below[at])))
        parts = max(2, PARTS // max(1, *map(len, spans)))
    out = []
    for own, n in zip(found, total, strict=True):
        places = [p * (n - 1) for p in probabilities] if n else []
        out.append([own[math.floor(at)] + (own[math.ceil(at)] - own[math.floor(at)]) * (at - math.floor(at)) for at in places])
    return out


def _count_parts(df: DataFrame, column: str, ends: list[tuple[np.ndarray, ...] | None], parts: int) -> pa.Table:
    """``entry, span, part, n, low, high``, sorted: the values of each part of each interval that has some."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = [None if e is None else len(e[0]) * parts for e in ends]
        tables = [None if s is None else (np.zeros(s, np.int64), np.full(s, np.inf), np.full(s, -np.inf)) for s in slots]
        for batch in batches:
            lists = batch.column(0).drop_null()
            values = np.sort(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(ends)).T, axis=1)
            for own, end, table in zip(values, ends, tables, strict=False):
                if end is None:
                    continue
                low, high, _ = end
                first, last = np.searchsorted(own, low), np.searchsorted(own, high, "right")
                held = last - first
                span = np.repeat(np.arange(len(low)), held)
                x = own[np.arange(len(span)) + np.repeat(first - (np.cumsum(held) - held), held)]
                # halves, since the distance of two numbers may be too large for one
                share = (x / 2 - low[span] / 2) / (high[span] / 2 - low[span] / 2)
                slot = span * parts + np.minimum(share * parts, parts - 1).astype(np.int64)
                begin = np.flatnonzero(np.diff(slot, prepend=-1))
                n, lowest, highest = table
                n[slot[begin]] += np.diff(begin, append=len(slot))
                lowest[slot[begin]] = np.minimum(lowest[slot[begin]], x[begin])
                highest[slot[begin]] = np.maximum(highest[slot[begin]], x[np.append(begin[1:], len(slot)) - 1] if len(begin) else x[:0])
        for k, table in enumerate(tables):
            some = np.flatnonzero(table[0]) if table is not None else []
            if len(some):
                yield pa.record_batch({"entry": np.full(len(some), k), "span": some // parts, "part": some % parts, "n": table[0][some], "low": table[1][some], "high": table[2][some]})

    counted = df.select(column).mapInArrow(count, "entry long, span long, part long, n long, low double, high double")
    summed = counted.groupBy("entry", "span", "part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return summed.toArrow().sort_by([(c, "ascending") for c in ("entry", "span", "part")])


def medians(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``median_<column>`` per group, all columns in the same passes; groups without any value have no row."""
    named = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_middle")) for c in columns])
    found = exact_quantiles(df.select(*by, F.inline(named)), [*by, "_column"], "_middle", [0.5])
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_column") == c, F.col("_middle"))).alias(f"median_{c}") for c in columns])
