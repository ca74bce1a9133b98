"""Raster masks as horizontal runs ``(key…, y, x0, x1, value)``, ``x1`` exclusive.

A frame is a bounded group (its pixel count is capped by the mask rules), so all
per-frame work hashes by the frame key once; the windows and aggregates on
(frame, y) reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.session import cut_lineage

KEY = ("mission_id", "video_id", "frame_index")


def _int(column: Column) -> Column:
    return column.cast("int")


def encode_runs(pixels: DataFrame, value: str, key: Sequence[str] = KEY) -> DataFrame:
    """Pixel rows to maximal runs per image line; pixels with a null value end a run."""
    line = Window.partitionBy(*key, "y", value).orderBy("x")
    return (
        pixels.where(F.col(value).isNotNull())
        .select(*key, "y", "x", value)
        .repartition(*key)
        .withColumn("_island", F.col("x") - F.row_number().over(line))
        .groupBy(*key, "y", value, "_island")
        .agg(_int(F.min("x")).alias("x0"), _int(F.max("x") + 1).alias("x1"))
        .select(*key, _int(F.col("y")).alias("y"), "x0", "x1", _int(F.col(value)).alias("value"))
    )


def encode_lines(lines: DataFrame, values: Column, key: Sequence[str] = KEY) -> DataFrame:
    """Runs of an image stored one array per line: no shuffle at all. Value 0 gives no run."""
    count = F.size("_v")
    starts = F.filter(
        F.sequence(F.lit(0), count - 1),
        lambda i: (i == 0) | (F.element_at("_v", _int(i + 1)) != F.element_at("_v", _int(F.greatest(i, F.lit(1))))),
    )
    runs = F.transform(
        "_starts",
        lambda start, i: F.struct(
            _int(start).alias("x0"),
            _int(F.coalesce(F.try_element_at("_starts", _int(i + 2)), count)).alias("x1"),
            _int(F.element_at("_v", _int(start + 1))).alias("value"),
        ),
    )
    return (
        lines.select(*key, _int(F.col("y")).alias("y"), values.alias("_v"))
        .where(count > 0)
        .withColumn("_starts", starts)
        .select(*key, "y", F.inline(F.filter(runs, lambda run: run["value"] != 0)))
    )


def decode_rle(masks: DataFrame, rle: str, width: str, key: Sequence[str] = KEY) -> DataFrame:
    """Wire form ``[value, length, …]`` (row-major, running over line ends) to runs per line."""
    half = (F.size("_rle") / 2).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(1), half),
        lambda i: F.struct(
            F.element_at("_rle", _int(2 * i - 1)).alias("value"), F.element_at("_rle", _int(2 * i)).alias("length")
        ),
    )
    frame = Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return (
        masks.select(*key, F.col(rle).alias("_rle"), F.col(width).alias("_w"))
        .where(F.size("_rle") >= 2)
        .select(*key, "_w", F.posexplode(pairs).alias("_i", "_run"))
        .withColumn("_end", F.sum(F.col("_run.length").cast("long")).over(frame))
        .withColumn("_start", F.col("_end") - F.col("_run.length"))
        .where((F.col("_run.value") != 0) & (F.col("_run.length") > 0))
        .withColumn("y", F.explode(F.expr("sequence(_start div _w, (_end - 1) div _w)")))
        .select(
            *key,
            _int(F.col("y")).alias("y"),
            _int(F.greatest(F.lit(0), F.col("_start") - F.col("y") * F.col("_w"))).alias("x0"),
            _int(F.least(F.col("_w"), F.col("_end") - F.col("y") * F.col("_w"))).alias("x1"),
            _int(F.col("_run.value")).alias("value"),
        )
    )


def to_rle(runs: DataFrame, frames: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Wire form per frame of ``frames(key…, width, height)``; unmarked pixels become value 0."""
    frame = Window.partitionBy(*key).orderBy("_s")
    flat = (
        frames.select(*key, "width", "height")
        .join(runs.where(F.col("value") != 0), list(key), "left")
        .withColumn("_s", F.coalesce(F.col("y").cast("long") * F.col("width") + F.col("x0"), F.lit(0)))
        .withColumn("_e", F.coalesce(F.col("y").cast("long") * F.col("width") + F.col("x1"), F.lit(0)))
        .withColumn("_v", F.coalesce("value", F.lit(0)))
        .repartition(*key)
        .withColumn("_next", F.coalesce(F.lead("_s").over(frame), F.col("width").cast("long") * F.col("height")))
        .withColumn("_first", F.lag("_s").over(frame).isNull())
    )
    piece = lambda s, e, v: F.struct(s.alias("s"), e.alias("e"), v.alias("v"))
    pieces = flat.select(
        *key,
        F.inline(
            F.filter(
                F.array(
                    piece(F.lit(0).cast("long"), F.when(F.col("_first"), F.col("_s")).otherwise(F.lit(0)), F.lit(0)),
                    piece(F.col("_s"), F.col("_e"), F.col("_v")),
                    piece(F.col("_e"), F.col("_next"), F.lit(0)),
                ),
                lambda p: p["e"] > p["s"],
            )
        ),
    )
    order = Window.partitionBy(*key).orderBy("s")
    changed = F.coalesce(F.lag("v").over(order) != F.col("v"), F.lit(True)).cast("int")
    return (
        pieces.withColumn("_new", changed)
        .withColumn("_island", F.sum("_new").over(order))
        .groupBy(*key, "_island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("v").alias("v"))
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("s", "e", "v"))).alias("_runs"))
        .select(*key, F.flatten(F.transform("_runs", lambda r: F.array(r["v"].cast("long"), r["e"] - r["s"]))).alias("rle"))
    )


def mask_overlap(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Pixels in both masks as ``(key…, y, x0, x1, va, vb)``: equi-join on line, residual range test."""
    left = a.select(*key, "y", F.col("x0").alias("_a0"), F.col("x1").alias("_a1"), F.col("value").alias("va"))
    right = b.select(*key, "y", F.col("x0").alias("_b0"), F.col("x1").alias("_b1"), F.col("value").alias("vb"))
    left, right = left.repartition(*key), right.repartition(*key)
    return (
        left.join(right, [*key, "y"])
        .where((F.col("_a0") < F.col("_b1")) & (F.col("_b0") < F.col("_a1")))
        .select(
            *key, "y", F.greatest("_a0", "_b0").alias("x0"), F.least("_a1", "_b1").alias("x1"), "va", "vb"
        )
    )


def _steps(changes: DataFrame, key: Sequence[str], keep: Column) -> DataFrame:
    """Turn ``(key…, y, x, d)`` coverage changes into the runs where ``keep`` holds for ``cover``."""
    line = Window.partitionBy(*key, "y").orderBy("x")
    return (
        changes.repartition(*key)
        .groupBy(*key, "y", "x")
        .agg(F.sum("d").alias("d"), F.max("need").alias("need"))
        .withColumn("cover", F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_in", keep)
        .withColumn("_was", F.coalesce(F.lag("_in").over(line), F.lit(False)))
        .where(F.col("_in") != F.col("_was"))
        .withColumn("x1", F.lead("x").over(line))
        .where("_in")
        .select(*key, _int(F.col("y")).alias("y"), _int(F.col("x")).alias("x0"), _int(F.col("x1")).alias("x1"), F.lit(1).alias("value"))
    )


def _changes(runs: DataFrame, key: Sequence[str], x0: Column, x1: Column, need: Column) -> DataFrame:
    return (
        runs.select(*key, "y", x0.alias("_x0"), x1.alias("_x1"), need.alias("need"))
        .where(F.col("_x0") < F.col("_x1"))
        .select(
            *key,
            "y",
            "need",
            F.inline(F.array(F.struct(F.col("_x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("_x1").alias("x"), F.lit(-1).alias("d")))),
        )
    )


def merge_runs(runs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Union of possibly overlapping runs, value 1."""
    return _steps(_changes(runs, key, F.col("x0"), F.col("x1"), F.lit(1)), key, F.col("cover") >= 1)


def _neighbour_rows(runs: DataFrame, radius: int, height: Column) -> DataFrame:
    rows = F.sequence(F.greatest(F.lit(0), F.col("y") - radius), F.least(height - 1, F.col("y") + radius))
    return runs.withColumn("y", F.explode(rows))


def dilate(runs: DataFrame, kx: int, ky: int, width: int, height: int, key: Sequence[str] = KEY) -> DataFrame:
    """Rectangular dilation; outside the image counts as empty."""
    rx, ry = kx // 2, ky // 2
    spread = _neighbour_rows(runs, ry, F.lit(height))
    return _steps(
        _changes(spread, key, F.greatest(F.lit(0), F.col("x0") - rx), F.least(F.lit(width), F.col("x1") + rx), F.lit(1)),
        key,
        F.col("cover") >= 1,
    )


def erode(runs: DataFrame, kx: int, ky: int, width: int, height: int, key: Sequence[str] = KEY) -> DataFrame:
    """Rectangular erosion; outside the image has no effect.

    Each run shrinks along x; a pixel stays where the shrunk runs of *all* lines in
    reach cover it, so counting coverage replaces complement-dilate-complement.
    """
    rx, ry = kx // 2, ky // 2
    shrunk0 = F.when(F.col("x0") > 0, F.col("x0") + rx).otherwise(F.lit(0))
    shrunk1 = F.when(F.col("x1") < width, F.col("x1") - rx).otherwise(F.lit(width))
    spread = _neighbour_rows(runs, ry, F.lit(height))
    need = F.least(F.lit(height - 1), F.col("y") + ry) - F.greatest(F.lit(0), F.col("y") - ry) + 1
    return _steps(_changes(spread, key, shrunk0, shrunk1, need), key, F.col("cover") >= F.col("need"))


def morph(runs: DataFrame, op: str, kx: int, ky: int, width: int, height: int, key: Sequence[str] = KEY) -> DataFrame:
    """``dilate``, ``erode``, ``open`` or ``close`` with a kx × ky rectangle."""
    steps = {"dilate": [dilate], "erode": [erode], "open": [erode, dilate], "close": [dilate, erode]}[op]
    for step in steps:
        runs = step(runs, kx, ky, width, height, key)
    return runs


def dense_filter(mask: np.ndarray, op: str, kx: int, ky: int) -> np.ndarray:
    """Rectangular min/max filter of one frame, or of each of a stack of frames; pixels outside the image have no effect. Frames are masks or scores."""
    steps = {"dilate": "d", "erode": "e", "open": "ed", "close": "de"}[op]
    low, high = (False, True) if mask.dtype == bool else (-np.inf, np.inf)
    for step in steps:
        join, neutral = (np.maximum, low) if step == "d" else (np.minimum, high)
        for axis, radius in ((-1, kx // 2), (-2, ky // 2)):
            n = mask.shape[axis]
            pad = [(0, 0)] * mask.ndim
            pad[axis] = (radius, radius)
            wide = np.moveaxis(np.pad(mask, pad, constant_values=neutral), axis, -1)
            joined = wide[..., :n].copy()
            for i in range(1, 2 * radius + 1):
                join(joined, wide[..., i : i + n], out=joined)
            mask = np.moveaxis(joined, -1, axis)
    return mask


CLEAN = (("open", 3, 3), ("close", 7, 7))


def dense_clean(mask: np.ndarray) -> np.ndarray:
    """The clean-up of :func:`clean_mask`. It only takes minima and maxima, so cleaned scores cut at any threshold are the cleaned mask of scores cut there."""
    for op, kx, ky in CLEAN:
        mask = dense_filter(mask, op, kx, ky)
    return mask


def dense_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1) of a dense mask in raster order."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edges == 1)
    return y, x0, np.nonzero(edges == -1)[1]


def dense_value_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1, value) of the stretches of equal non-zero values in raster order."""
    edge = np.ones((values.shape[0], values.shape[1] + 1), bool)
    edge[:, 1:-1] = values[:, 1:] != values[:, :-1]
    y, x = np.nonzero(edge)
    last = np.append(y[1:] != y[:-1], True)
    y0, x0, x1 = y[~last], x[~last], x[1:][~last[:-1]]
    value = values[y0, x0]
    return y0[value != 0], x0[value != 0], x1[value != 0], value[value != 0]


def morph_chain(runs: DataFrame, steps: Sequence[tuple[str, int, int]], width: int, height: int, key: Sequence[str] = KEY) -> DataFrame:
    """Several morphology steps with one shuffle.

    :func:`morph` sorts the runs anew for every step. A chain is cheaper on the dense
    raster of a frame, which is a bounded group: the runs of one frame are painted,
    filtered and encoded again inside the task that holds them.
    """
    slim = runs.select(*key, "y", "x0", "x1")
    names = list(key)
    schema = T.StructType([*[f for f in slim.schema.fields if f.name in key], *[T.StructField(c, T.IntegerType()) for c in ("y", "x0", "x1", "value")]])

    def run(frame: pa.Table) -> pa.Table:
        mask = np.zeros((height, width), bool)
        for y, a, b in zip(*(frame.column(c).to_numpy() for c in ("y", "x0", "x1"))):
            mask[y, a:b] = True
        for op, kx, ky in steps:
            mask = dense_filter(mask, op, kx, ky)
        y, a, b = dense_runs(mask)
        keys = [pa.array([frame.column(n)[0].as_py()] * len(y), frame.schema.field(n).type) for n in names]
        cells = [pa.array(v.astype(np.int32)) for v in (y, a, b, np.ones(len(y)))]
        return pa.Table.from_arrays([*keys, *cells], names=[*names, "y", "x0", "x1", "value"])

    return slim.groupBy(*key).applyInArrow(run, schema)


def clean_mask(runs: DataFrame, width: int, height: int, key: Sequence[str] = KEY) -> DataFrame:
    """The prediction clean-up: 3×3 opening, then 7×7 closing."""
    return morph_chain(runs, CLEAN, width, height, key)


def ellipse_half_widths(size: int) -> list[int]:
    """Half width of an elliptic kernel of odd ``size`` for each row offset -r…r."""
    r = size // 2
    return [int(round(np.sqrt(max(0.0, 1 - (dy / r) ** 2)) * r)) if r else 0 for dy in range(-r, r + 1)]


def dilate_ellipse(runs: DataFrame, size: int, width: int, height: int, key: Sequence[str] = KEY) -> DataFrame:
    """Dilation with an elliptic kernel: every row offset widens the run by its own half width."""
    r = size // 2
    offsets = F.array(
        *[F.struct(F.lit(dy).alias("dy"), F.lit(half).alias("half")) for dy, half in zip(range(-r, r + 1), ellipse_half_widths(size))]
    )
    spread = (
        runs.withColumn("_o", F.explode(offsets))
        .withColumn("y", F.col("y") + F.col("_o.dy"))
        .where((F.col("y") >= 0) & (F.col("y") < height))
    )
    return _steps(
        _changes(
            spread,
            key,
            F.greatest(F.lit(0), F.col("x0") - F.col("_o.half")),
            F.least(F.lit(width), F.col("x1") + F.col("_o.half")),
            F.lit(1),
        ),
        key,
        F.col("cover") >= 1,
    )


def subtract(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Pixels of ``a`` outside ``b``; both are sets of disjoint runs."""
    plus = _changes(a, key, F.col("x0"), F.col("x1"), F.lit(1))
    minus = _changes(b, key, F.col("x0"), F.col("x1"), F.lit(1)).withColumn("d", F.col("d") * -2)
    return _steps(plus.unionByName(minus), key, F.col("cover") == 1)


def intersect(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Pixels in both; both are sets of disjoint runs."""
    both = _changes(a, key, F.col("x0"), F.col("x1"), F.lit(1)).unionByName(
        _changes(b, key, F.col("x0"), F.col("x1"), F.lit(1))
    )
    return _steps(both, key, F.col("cover") >= 2)


def union(*parts: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Pixels in any of the masks."""
    columns = [*key, "y", "x0", "x1"]
    stacked = parts[0].select(*columns)
    for part in parts[1:]:
        stacked = stacked.unionByName(part.select(*columns))
    return merge_runs(stacked, key)


def complement(runs: DataFrame, frames: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Unmarked pixels of every frame in ``frames(key…, width, height)``."""
    full = frames.select(*key, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.lit(0).alias("x0"), F.col("width").alias("x1"))
    return subtract(full, runs, key)


def overlay(layers: Sequence[DataFrame], key: Sequence[str] = KEY) -> DataFrame:
    """Paint layers in order, later ones on top; value 0 erases.

    Runs of one layer may overlap each other when they carry a ``rank`` column
    (higher paints later), as refinement items do.
    """
    stacked = None
    for level, layer in enumerate(layers):
        rank = F.col("rank") if "rank" in layer.columns else F.lit(0)
        part = layer.select(*key, "y", "x0", "x1", "value", F.struct(F.lit(level).alias("level"), rank.cast("long").alias("rank")).alias("_p"))
        stacked = part if stacked is None else stacked.unionByName(part)
    stacked = stacked.repartition(*key)
    line = Window.partitionBy(*key, "y").orderBy("x")
    cuts = (
        stacked.select(*key, "y", F.explode(F.array("x0", "x1")).alias("x"))
        .dropDuplicates([*key, "y", "x"])
        .withColumn("_to", F.lead("x").over(line))
        .where(F.col("_to").isNotNull())
    )
    painted = (
        cuts.join(stacked, [*key, "y"])
        .where((F.col("x0") <= F.col("x")) & (F.col("x") < F.col("x1")))
        .groupBy(*key, "y", "x", "_to")
        .agg(F.max_by("value", "_p").alias("value"))
        .where(F.col("value") != 0)
        .select(*key, "y", F.col("x").alias("x0"), F.col("_to").alias("x1"), "value")
    )
    return join_touching(painted, key)


def join_touching(runs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Merge neighbouring runs of equal value into maximal ones."""
    line = Window.partitionBy(*key, "y").orderBy("x0")
    new = F.coalesce((F.lag("x1").over(line) != F.col("x0")) | (F.lag("value").over(line) != F.col("value")), F.lit(True))
    return (
        runs.repartition(*key)
        .withColumn("_new", new.cast("int"))
        .withColumn("_island", F.sum("_new").over(line))
        .groupBy(*key, "y", "_island")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("value").alias("value"))
        .select(*key, _int(F.col("y")).alias("y"), _int(F.col("x0")).alias("x0"), _int(F.col("x1")).alias("x1"), _int(F.col("value")).alias("value"))
    )


def apply_refinements(runs: DataFrame, refinements: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Overwrite a mask by correction regions ``(key…, pos, y, x0, x1, value)``; higher ``pos`` wins."""
    return overlay([runs, refinements.withColumn("rank", F.col("pos"))], key)


def comparison_mask(truth: DataFrame, predicted: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """1 correct, 2 missed, 3 invented; pixels in neither mask have no run."""
    plus = _changes(truth, key, F.col("x0"), F.col("x1"), F.lit(1))
    minus = _changes(predicted, key, F.col("x0"), F.col("x1"), F.lit(1)).withColumn("d", F.col("d") * 2)
    line = Window.partitionBy(*key, "y").orderBy("x")
    return (
        plus.unionByName(minus)
        .repartition(*key)
        .groupBy(*key, "y", "x")
        .agg(F.sum("d").alias("d"))
        .where(F.col("d") != 0)
        .withColumn("cover", F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("x1", F.lead("x").over(line))
        .where(F.col("cover") > 0)
        .select(
            *key,
            _int(F.col("y")).alias("y"),
            _int(F.col("x")).alias("x0"),
            _int(F.col("x1")).alias("x1"),
            _int(F.when(F.col("cover") == 3, 1).when(F.col("cover") == 1, 2).otherwise(3)).alias("value"),
        )
    )


def mask_shares(runs: DataFrame, frames: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Pixels and share per mask value, plus the labelled share of the frame."""
    size = frames.select(*key, (F.col("width").cast("long") * F.col("height")).alias("_total"))
    areas = runs.groupBy(*key, "value").agg(F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("pixels"))
    labelled = Window.partitionBy(*key)
    return (
        size.join(areas, list(key))
        .withColumn("_labelled", F.sum(F.when(F.col("value") != 0, F.col("pixels")).otherwise(0)).over(labelled))
        .select(
            *key,
            "value",
            "pixels",
            F.bround(F.col("pixels") / F.greatest(F.lit(1), F.col("_total")), 5).alias("fraction"),
            F.bround(F.col("_labelled") / F.greatest(F.lit(1), F.col("_total")), 5).alias("labelled_fraction"),
        )
    )


def widest_run(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """First longest run per group: a max over (length, -x0), combined map-side."""
    best = F.max(F.struct((F.col("x1") - F.col("x0")).alias("length"), (-F.col("x0")).alias("neg")))
    return runs.groupBy(*by).agg(best.alias("_b")).select(*by, (-F.col("_b.neg")).alias("x0"), F.col("_b.length").alias("length"))


def horizontal_clearance(runs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per pixel of a run the distance to its nearer end: ``min(x - x0 + 1, x1 - x)``."""
    return runs.select(*key, "y", "x0", "x1", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x")).select(
        *key, "y", "x", F.least(F.col("x") - F.col("x0") + 1, F.col("x1") - F.col("x")).alias("clearance")
    )


def resize_nearest(runs: DataFrame, size: tuple[int, int], target: tuple[int, int], key: Sequence[str] = KEY) -> DataFrame:
    """Nearest-neighbour rescale in closed form: target cell t reads source cell ⌊t·w/W⌋."""
    (w, h), (tw, th) = size, target
    rows = F.expr(f"sequence(int(({th} * y + {h - 1}) div {h}), int(({th} * (y + 1) + {h - 1}) div {h}) - 1)")
    return (
        runs.where(F.expr(f"({th} * (y + 1) + {h - 1}) div {h} > ({th} * y + {h - 1}) div {h}"))
        .select(
            *key,
            F.explode(rows).alias("y"),
            F.expr(f"int(({tw} * x0 + {w - 1}) div {w})").alias("x0"),
            F.expr(f"int(({tw} * x1 + {w - 1}) div {w})").alias("x1"),
            "value",
        )
        .where(F.col("x0") < F.col("x1"))
    )


def value_at(runs: DataFrame, points: DataFrame, width: int, height: int, key: Sequence[str] = KEY) -> DataFrame:
    """Mask value under normalised points ``(key…, point_id, px, py)``; 0 where nothing is marked."""
    cell = lambda c, n: _int(F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(c) * n))))
    asked = points.withColumn("y", cell("py", height)).withColumn("_x", cell("px", width))
    hits = runs.select(*key, "y", "x0", "x1", "value")
    joined = asked.join(hits, [*key, "y"], "left")
    covered = (F.col("x0") <= F.col("_x")) & (F.col("_x") < F.col("x1"))
    return joined.groupBy(*points.columns).agg(F.coalesce(F.max(F.when(covered, F.col("value"))), F.lit(0)).alias("value"))


def clip_to_mask(runs: DataFrame, values: Sequence[int] = (1, 2)) -> DataFrame:
    """Only the spans of the given classes."""
    return runs.where(F.col("value").isin(*values))


def trapezoid_runs(frames: DataFrame, corners: dict[str, Column], key: Sequence[str] = KEY) -> DataFrame:
    """Fixed trapezoid per frame in closed form.

    ``corners``: ``top``, ``bottom`` (rows) and ``tl``, ``tr``, ``bl``, ``br`` (columns),
    integer pixel positions; both edges belong to the area.
    """
    y = F.col("y")
    part = (y - F.col("_top")) / F.greatest(F.lit(1), F.col("_bottom") - F.col("_top"))
    edge = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * part + 0.5)
    sized = frames.select(*key, "width", "height", *[F.floor(c).cast("int").alias(f"_{n}") for n, c in corners.items()])
    return (
        sized.withColumn("y", F.explode(F.sequence(F.col("_top"), F.least(F.col("_bottom"), F.col("height") - 1))))
        .select(
            *key,
            "y",
            _int(F.greatest(F.lit(0), edge("_tl", "_bl"))).alias("x0"),
            _int(F.least(F.col("width"), edge("_tr", "_br") + 1)).alias("x1"),
            F.lit(1).alias("value"),
        )
        .where(F.col("x0") < F.col("x1"))
    )


def roi_runs(frames: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Driving area of a terrain frame."""
    w, h = F.col("width"), F.col("height")
    portrait = h > w
    return trapezoid_runs(
        frames,
        {
            "top": h * 0.34,
            "bottom": h * 0.98,
            "tl": w * 0.42,
            "tr": w * 0.58,
            "bl": F.when(portrait, w * 0.04).otherwise(w * 0.08),
            "br": F.when(portrait, w * 0.96).otherwise(w * 0.92),
        },
        key,
    )


def centre_prior_runs(frames: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Area straight ahead of the vehicle."""
    w, h = F.col("width"), F.col("height")
    return trapezoid_runs(
        frames, {"top": h * 0.40, "bottom": h, "tl": w * 0.46, "tr": w * 0.54, "bl": w * 0.24, "br": w * 0.76}, key
    )


def road_exclusion_runs(frames: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Road area in which vegetation is not reported."""
    w, h = F.col("width"), F.col("height")
    portrait = h > w
    return trapezoid_runs(
        frames,
        {
            "top": h * 0.46,
            "bottom": h,
            "tl": w * 0.44,
            "tr": w * 0.56,
            "bl": F.when(portrait, w * 0.07).otherwise(w * 0.20),
            "br": F.when(portrait, w * 0.93).otherwise(w * 0.80),
        },
        key,
    )


def rasterize(polygons: DataFrame, width: int, height: int, classes: Sequence[str] | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Union of polygons ``(key…, polygon_id, class_id, points array<struct<x,y>>)`` as runs.

    Points are rounded to the grid (half to even). A line is filled by the even-odd
    rule and the outline itself belongs to the area.
    """
    if classes is not None:
        polygons = polygons.where(F.coalesce("class_id", F.lit("traversable")).isin(*classes))
    grid = F.transform(
        "points",
        lambda p: F.struct(
            F.rint(p["x"] * (width - 1)).cast("int").alias("x"), F.rint(p["y"] * (height - 1)).cast("int").alias("y")
        ),
    )
    ring = F.transform(
        "_p",
        lambda p, i: F.struct(
            p["x"].alias("ax"),
            p["y"].alias("ay"),
            F.element_at("_p", _int((i + 1) % F.size("_p") + 1))["x"].alias("bx"),
            F.element_at("_p", _int((i + 1) % F.size("_p") + 1))["y"].alias("by"),
        ),
    )
    edges = (
        polygons.where(F.size("points") >= 3)
        .withColumn("_p", grid)
        .select(*key, "polygon_id", F.inline(ring))
        .repartition(*key)
    )
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    line = Window.partitionBy(*key, "polygon_id", "y").orderBy("_x")
    inner = (
        edges.where(ay != by)
        .withColumn("y", F.explode(F.sequence(F.least(ay, by), F.greatest(ay, by) - 1)))
        .withColumn("_x", ax + (F.col("y") - ay) * (bx - ax) / (by - ay))
        .withColumn("_n", F.row_number().over(line))
        .withColumn("_to", F.lead("_x").over(line))
        .where(F.col("_n") % 2 == 1)
        .select(*key, "y", _int(F.ceil("_x")).alias("x0"), _int(F.floor("_to") + 1).alias("x1"))
    )
    steep = F.abs(by - ay) >= F.abs(bx - ax)
    steps = F.greatest(F.abs(by - ay), F.abs(bx - ax))
    outline = (
        edges.withColumn("_t", F.explode(F.sequence(F.lit(0), steps)))
        .withColumn("_f", F.col("_t") / F.greatest(F.lit(1), steps))
        .select(
            *key,
            _int(F.when(steep, ay + F.signum((by - ay).cast("double")) * F.col("_t")).otherwise(F.floor(ay + (by - ay) * F.col("_f") + 0.5))).alias("y"),
            _int(F.when(steep, F.floor(ax + (bx - ax) * F.col("_f") + 0.5)).otherwise(ax + F.signum((bx - ax).cast("double")) * F.col("_t"))).alias("x0"),
        )
        .withColumn("x1", F.col("x0") + 1)
    )
    return merge_runs(
        inner.unionByName(outline).where((F.col("y") >= 0) & (F.col("y") < height)), key
    )


def label_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """Component number per run of one frame, 1-based in order of first appearance.

    ``reach`` 1 joins diagonal neighbours, 0 only direct ones. Runs come sorted by (y, x0). Neighbours in the row above are a
    stretch of the sorted runs; roots are settled by hooking every root under a smaller neighbour and pointer jumping.
    """
    n = len(y)
    if not n:
        return np.zeros(0, np.int32)
    y, x0, x1 = (v.astype(np.int64) for v in (y, x0, x1))
    span = int(x1.max()) + 2
    begins, ends, above = y * span + x0, y * span + x1, (y - 1) * span
    low = np.searchsorted(ends, above + np.maximum(x0 - reach, 0), "right")
    high = np.searchsorted(begins, above + np.minimum(x1 + reach, span - 1), "left")
    size = np.maximum(high - low, 0)
    one = np.repeat(np.arange(n), size)
    two = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
    root = np.arange(n)
    while True:
        a, b = root[one], root[two]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    return (np.unique(root, return_inverse=True)[1] + 1).astype(np.int32)


def components(runs: DataFrame, connectivity: int = 8, key: Sequence[str] = KEY) -> DataFrame:
    """Add ``component`` to every run. One frame is one (bounded) group; frames run in parallel."""
    schema = runs.select(*key, "y", "x0", "x1").schema.add("component", T.IntegerType())
    reach = 1 if connectivity == 8 else 0

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x0"], kind="stable").reset_index(drop=True)
        frame["component"] = label_runs(frame["y"].to_numpy(), frame["x0"].to_numpy(), frame["x1"].to_numpy(), reach)
        return frame

    return runs.select(*key, "y", "x0", "x1").groupBy(*key).applyInPandas(label, schema)


def seed_component(runs: DataFrame, seed: DataFrame, width: int, key: Sequence[str] = KEY) -> DataFrame:
    """Of the components touching the seed the one with the best area + 24·overlap − centre penalty."""
    # Read three times below (shape, overlap, result): written once to the shared folder.
    labelled = cut_lineage(components(runs, 8, key).repartition(*key))
    length = (F.col("x1") - F.col("x0")).cast("long")
    shape = labelled.groupBy(*key, "component").agg(
        F.sum(length).alias("area"), F.sum(length * (F.col("x0") + F.col("x1") - 1) / 2.0).alias("_mx")
    )
    touching = (
        mask_overlap(labelled.withColumnRenamed("component", "value"), seed.withColumn("value", F.lit(1)), key)
        .groupBy(*key, F.col("va").alias("component"))
        .agg(F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("seed_overlap"))
    )
    score = (
        F.col("area")
        + F.col("seed_overlap") * 24
        - F.abs(F.col("_mx") / F.col("area") / max(1, width) - 0.5) * F.col("area") * 0.45
    )
    best = (
        shape.join(touching, [*key, "component"])
        .groupBy(*key)
        .agg(F.max_by("component", F.struct(score.alias("s"), (-F.col("component")).alias("c"))).alias("component"))
    )
    return labelled.join(best, [*key, "component"]).select(*key, "y", "x0", "x1", F.lit(1).alias("value"))


def region_table(runs: DataFrame, width: int, height: int, min_share: float = 0.0015, k: int = 18, key: Sequence[str] = KEY) -> DataFrame:
    """Components per class with area share and bounding box, the ``k`` largest above ``min_share``."""
    parts = components(runs, 8, [*key, "value"])
    length = (F.col("x1") - F.col("x0")).cast("long")
    regions = parts.groupBy(*key, "value", "component").agg(
        F.sum(length).alias("area"),
        F.min("x0").alias("left"),
        F.min("y").alias("top"),
        F.max("x1").alias("right"),
        (F.max("y") + 1).alias("bottom"),
    )
    regions = regions.withColumn("area_ratio", F.bround(F.col("area") / (width * height), 5))
    return top_regions(regions, width * height, min_share, k, key)


def top_regions(regions: DataFrame, frame_area: int, min_share: float = 0.0015, k: int = 18, key: Sequence[str] = KEY) -> DataFrame:
    """Largest regions per class; equal areas keep the lower component number."""
    order = Window.partitionBy(*key, "value").orderBy(F.col("area").desc(), "component")
    return (
        regions.where(F.col("area") >= min_share * frame_area)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def refine_region(clicks: DataFrame, comparison: DataFrame, width: int, height: int, key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Connected error areas under clicks become corrections.

    ``clicks(key…, click_id, px, py, expected_kind)``. Returns the correction runs
    (with ``correct_value`` and ``pixel_count``) and the clicks whose pixel no longer
    has the expected kind.
    """
    wanted = F.when(F.col("expected_kind") == "missed_label", 2).otherwise(3)
    cell = lambda c, n: _int(F.least(F.lit(n - 1), F.greatest(F.lit(0), F.rint(F.col(c) * (n - 1)))))
    placed = clicks.withColumn("y", cell("py", height)).withColumn("_x", cell("px", width)).withColumn("value", wanted)
    errors = comparison.where(F.col("value").isin(2, 3))
    labelled = cut_lineage(components(errors, 8, [*key, "value"]))
    hits = (
        placed.join(labelled, [*key, "value", "y"])
        .where((F.col("x0") <= F.col("_x")) & (F.col("_x") < F.col("x1")))
        .select(*key, "value", "component", "click_id", "expected_kind")
    )
    accepted = (
        labelled.join(hits, [*key, "value", "component"])
        .withColumn("pixel_count", F.sum((F.col("x1") - F.col("x0")).cast("long")).over(Window.partitionBy(*key, "click_id")))
        .select(
            *key,
            "click_id",
            "expected_kind",
            "pixel_count",
            F.when(F.col("value") == 2, 0).otherwise(1).alias("correct_value"),
            "y",
            "x0",
            "x1",
        )
    )
    rejected = clicks.join(hits.select(*key, "click_id"), [*key, "click_id"], "left_anti")
    return accepted, rejected
