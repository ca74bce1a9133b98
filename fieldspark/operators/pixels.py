"""Pixel-level features: colour, neighbourhood filters, descriptors.

Frames are bounded, so all neighbourhood windows hash by the frame key once; the
windows along x and along y only re-sort inside that partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions import colour
from fieldspark.operators import runs as R

FEATURES = (
    "blue", "green", "red", "sin_hue", "cos_hue", "saturation", "value", "lab_l", "lab_a", "lab_b", "excess_green",
    "gradient", "local_mean", "local_std", "px", "py", "px2", "py2", "centre_distance", "green_y", "saturation_y", "value_y",
)
POSITIONAL = 8
PIXELS_PER_TASK = 1 << 17
DESCRIPTOR = (
    "blue", "green", "red", "sin_hue", "cos_hue", "saturation", "value", "lab_l", "lab_a", "lab_b", "excess_green", "gradient", "local_std",
)


def add_colour(pixels: DataFrame) -> DataFrame:
    """Add gray, hue, sat, val (8-bit) and Lab to ``(key…, y, x, b, g, r)``."""
    base = pixels.withColumns({c: F.col(c).cast("double") for c in "bgr"})
    l_, a_, b_ = colour.lab()
    return (
        base.withColumns({"gray": F.expr(colour.GRAY), "hue": F.expr(colour.HUE), "sat": F.expr(colour.SATURATION), "val": F.expr(colour.VALUE)})
        .withColumns({n: F.expr(e) for n, e in colour.XYZ.items()})
        .withColumns({"lab_l8": F.expr(l_), "lab_a8": F.expr(a_), "lab_b8": F.expr(b_)})
        .drop(*colour.XYZ)
    )


def _mirrored(pixels: DataFrame, axis: str, n: int, radius: int) -> DataFrame:
    """Repeat pixels beyond the image edge by reflection (edge pixel not repeated)."""
    c = F.col(axis)
    places = F.array_compact(
        F.array(c, F.when(c.between(1, radius), -c), F.when(c.between(n - 1 - radius, n - 2), 2 * (n - 1) - c))
    )
    return pixels.withColumn(axis, F.explode(places))


def box_mean(pixels: DataFrame, columns: dict[str, str], k: int, width: int, height: int, key: Sequence[str] = R.KEY) -> DataFrame:
    """k × k mean with mirrored borders; ``columns`` maps input to output names. Separable: along x, then y."""
    r = k // 2
    if r >= min(width, height):
        raise ValueError("filter larger than the image")
    across = Window.partitionBy(*key, "y").orderBy("x").rangeBetween(-r, r)
    down = Window.partitionBy(*key, "x").orderBy("y").rangeBetween(-r, r)
    temp = {f"_{out}": F.avg(src).over(across) for src, out in columns.items()}
    wide = _mirrored(pixels.repartition(*key), "x", width, r).withColumns(temp).where(F.col("x").between(0, width - 1))
    tall = _mirrored(wide, "y", height, r).withColumns({out: F.avg(f"_{out}").over(down) for out in columns.values()})
    return tall.where(F.col("y").between(0, height - 1)).drop(*temp)


def local_std(pixels: DataFrame, column: str, k: int, width: int, height: int, key: Sequence[str] = R.KEY, mean: str = "local_mean", std: str = "local_std") -> DataFrame:
    """Mean and standard deviation in a k × k box."""
    squared = pixels.withColumn("_sq", F.col(column) * F.col(column))
    boxed = box_mean(squared, {column: mean, "_sq": "_msq"}, k, width, height, key)
    return boxed.withColumn(std, F.sqrt(F.greatest(F.lit(0.0), F.col("_msq") - F.col(mean) * F.col(mean)))).drop("_sq", "_msq")


def _beside(column: str, window) -> tuple[Column, Column]:
    before, after = F.lag(column).over(window), F.lead(column).over(window)
    return F.coalesce(before, after), F.coalesce(after, before)


def tasks_for(frames: DataFrame) -> int:
    """To how many tasks the pixels of ``frames(width, height)`` should be dealt, so that one holds about ``PIXELS_PER_TASK``.

    Shuffled pixels are small and in memory they are not, so tasks merged by shuffled bytes may hold too many. With fewer tasks
    than a shuffle has, Spark would take the shuffle's number.
    """
    total = frames.agg(F.sum(F.col("width").cast("long") * F.col("height"))).first()[0] or 0
    return max(-(-total // PIXELS_PER_TASK), int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sobel(pixels: DataFrame, column: str, key: Sequence[str] = R.KEY, dealt: bool = False) -> DataFrame:
    """Add 3×3 Sobel derivatives ``grad_x`` and ``grad_y`` with mirrored borders. With ``dealt`` all pixels of a frame are in one task already."""
    across, down = Window.partitionBy(*key, "y").orderBy("x"), Window.partitionBy(*key, "x").orderBy("y")
    up, low = _beside(column, down)
    smooth = (pixels if dealt else pixels.repartition(*key)).withColumn("_sv", up + 2 * F.col(column) + low).withColumn("_dv", low - up)
    sl, sr = _beside("_sv", across)
    dl, dr = _beside("_dv", across)
    return smooth.withColumn("grad_x", sr - sl).withColumn("grad_y", dl + 2 * F.col("_dv") + dr).drop("_sv", "_dv")


def gradient(pixels: DataFrame, column: str, key: Sequence[str] = R.KEY) -> DataFrame:
    """Sobel magnitude, at most one."""
    size = F.least(F.lit(1.0), F.sqrt(F.col("grad_x") * F.col("grad_x") + F.col("grad_y") * F.col("grad_y")))
    return sobel(pixels, column, key).withColumn("gradient", size).drop("grad_x", "grad_y")


def laplacian(pixels: DataFrame, column: str, key: Sequence[str] = R.KEY) -> DataFrame:
    across, down = Window.partitionBy(*key, "y").orderBy("x"), Window.partitionBy(*key, "x").orderBy("y")
    left, right = _beside(column, across)
    up, low = _beside(column, down)
    return pixels.repartition(*key).withColumn("laplacian", left + right + up + low - 4 * F.col(column))


def sharpness(pixels: DataFrame, column: str = "gray", key: Sequence[str] = R.KEY) -> DataFrame:
    """Variance of the Laplacian per frame."""
    return laplacian(pixels, column, key).groupBy(*key).agg(F.var_pop("laplacian").alias("sharpness"))


def _shifted(grid: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The neighbour at (dy, dx), NaN beyond the edge."""
    out = np.full_like(grid, np.nan)
    h, w = grid.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = grid[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def _pair(grid: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
    """Both neighbours along one axis; a missing one mirrors the other."""
    before, after = _shifted(grid, -dy, -dx), _shifted(grid, dy, dx)
    return np.where(np.isnan(before), after, before), np.where(np.isnan(after), before, after)


def dense_box(grid: np.ndarray, k: int) -> np.ndarray:
    """k × k mean with mirrored image borders; missing pixels do not count."""
    r = k // 2
    for axis in (1, 0):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        wide = np.pad(grid, pad, mode="reflect")
        n = grid.shape[axis]
        parts = np.stack([np.take(wide, range(i, i + n), axis=axis) for i in range(k)])
        known = ~np.isnan(parts)
        grid = np.where(known, parts, 0.0).sum(axis=0) / np.where(known.any(axis=0), known.sum(axis=0), np.nan)
    return grid


def dense_gradient(grid: np.ndarray) -> np.ndarray:
    """Sobel magnitude, at most one."""
    up, low = _pair(grid, 1, 0)
    smooth, diff = up + 2 * grid + low, low - up
    left, right = _pair(smooth, 0, 1)
    d_left, d_right = _pair(diff, 0, 1)
    return np.minimum(1.0, np.hypot(right - left, d_left + 2 * diff + d_right))


def area_weights(n: int, target: int) -> np.ndarray:
    """target × n matrix: the share of each source cell in a target cell of an image line rescaled by area."""
    edges = np.arange(target + 1) * (n / target)
    cells = np.arange(n)
    shared = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    shared = np.clip(shared, 0.0, None)
    return shared / shared.sum(axis=1, keepdims=True)


def resize_area(
    pixels: DataFrame, columns: Sequence[str], size: tuple[int, int], target: tuple[int, int], key: Sequence[str] = R.KEY, nearest: Sequence[str] = ()
) -> DataFrame:
    """Complete 8-bit frames rescaled by area means, rounded half to even; a frame is a bounded group, shuffled once.

    ``nearest`` names integer columns that take the value of the nearest source cell, as :func:`runs.resize_nearest` does. Frames come out one after the other, their pixels in order.
    """
    (w, h), (tw, th) = size, target
    across, down, names = area_weights(w, tw), area_weights(h, th), list(key)
    slim = pixels.select(*key, "y", "x", *[F.col(c).cast("double").alias(c) for c in columns], *[F.col(c).cast("int").alias(c) for c in nearest])
    schema = T.StructType(
        [*[f for f in slim.schema.fields if f.name in names], *[T.StructField(c, T.IntegerType()) for c in ("y", "x")], *[T.StructField(c, T.DoubleType()) for c in columns], *[T.StructField(c, T.IntegerType()) for c in nearest]]
    )
    y, x = (v.ravel().astype(np.int32) for v in np.indices((th, tw)))
    source = np.ix_(np.arange(th) * h // th, np.arange(tw) * w // tw)

    def run(frame: pa.Table) -> pa.Table:
        rows, cols = frame.column("y").to_numpy(), frame.column("x").to_numpy()
        made = []
        for c in columns:
            grid = np.zeros((h, w))
            grid[rows, cols] = frame.column(c).to_numpy()
            made.append(pa.array(np.rint(down @ grid @ across.T).ravel()))
        for c in nearest:
            grid = np.zeros((h, w), np.int32)
            grid[rows, cols] = frame.column(c).to_numpy()
            made.append(pa.array(grid[source].ravel()))
        head = [pa.array(frame.column(n)[:1].to_pylist() * len(y), frame.schema.field(n).type) for n in names]
        return pa.Table.from_arrays([*head, pa.array(y), pa.array(x), *made], names=[*names, "y", "x", *columns, *nearest])

    return slim.groupBy(*key).applyInArrow(run, schema)


def frame_filters(pixels: DataFrame, column: str, filters: dict, width: int, height: int, key: Sequence[str] = R.KEY) -> DataFrame:
    """Several neighbourhood filters with one shuffle.

    The window forms above sort a frame once per direction and filter. Here the frame, a
    bounded group, is laid out once as a raster and ``filters`` (name → function of the
    raster) add one column each.
    """
    schema = T.StructType([*pixels.schema.fields, *[T.StructField(n, T.DoubleType()) for n in filters]])

    def run(frame: pa.Table) -> pa.Table:
        y, x = frame.column("y").to_numpy(), frame.column("x").to_numpy()
        grid = np.full((height, width), np.nan)
        grid[y, x] = frame.column(column).to_numpy()
        for name, fn in filters.items():
            frame = frame.append_column(name, pa.array(fn(grid)[y, x]))
        return frame

    return pixels.groupBy(*key).applyInArrow(run, schema)


def whole_frame_filters(pixels: DataFrame, column: str, filters: dict, width: int, height: int) -> DataFrame:
    """:func:`frame_filters` without any shuffle, for rows as :func:`resize_area` leaves them: complete frames one after the other, in order."""
    schema, size = T.StructType([*pixels.schema.fields, *[T.StructField(n, T.DoubleType()) for n in filters]]), width * height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            if sum(b.num_rows for b in rest) < size:
                continue
            table = pa.Table.from_batches(rest).combine_chunks()
            full = table.num_rows // size
            for k in range(full):
                frame = table.slice(k * size, size)
                grid = frame.column(column).to_numpy().reshape(height, width)
                for name, fn in filters.items():
                    frame = frame.append_column(name, pa.array(fn(grid).ravel()))
                yield from frame.combine_chunks().to_batches()
            rest = table.slice(full * size).to_batches()
        if sum(b.num_rows for b in rest):
            raise ValueError("an incomplete frame")

    return pixels.mapInArrow(run, schema)


def _texture(k: int) -> dict:
    spread = lambda g: np.sqrt(np.maximum(0.0, dense_box(g * g, k) - dense_box(g, k) ** 2))
    return {"gradient": dense_gradient, "local_mean": lambda g: dense_box(g, k), "local_std": spread}


def feature_columns(pixels: DataFrame, width: int, height: int, key: Sequence[str] = R.KEY, keep: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """The 22 pixel features as named columns; the last eight depend on position. ``whole`` rows are as :func:`resize_area` leaves them."""
    return named_features(textured_pixels(pixels, width, height, key, keep, whole), width, height, key, keep)


def textured_pixels(pixels: DataFrame, width: int, height: int, key: Sequence[str] = R.KEY, keep: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """Pixels with the features that depend on neighbours, which are made of all pixels of a frame."""
    raw = pixels.select(*key, "y", "x", "b", "g", "r", *keep).withColumn("_gray", F.expr(colour.GRAY) / 255)
    return whole_frame_filters(raw, "_gray", _texture(9), width, height) if whole else frame_filters(raw, "_gray", _texture(9), width, height, key)


def named_features(pixels: DataFrame, width: int, height: int, key: Sequence[str] = R.KEY, keep: Sequence[str] = ()) -> DataFrame:
    """All features of the given ones of :func:`textured_pixels`."""
    textured = add_colour(pixels)
    angle = F.expr(colour.HUE_ANGLE)
    px, py = F.col("x") / F.lit(float(max(1, width - 1))), F.col("y") / F.lit(float(max(1, height - 1)))
    named = {
        "blue": F.col("b") / 255,
        "green": F.col("g") / 255,
        "red": F.col("r") / 255,
        "sin_hue": F.sin(angle),
        "cos_hue": F.cos(angle),
        "saturation": F.col("sat") / 255,
        "value": F.col("val") / 255,
        "lab_l": F.col("lab_l8") / 255,
        "lab_a": F.col("lab_a8") / 255,
        "lab_b": F.col("lab_b8") / 255,
        "excess_green": F.expr(colour.EXCESS_GREEN),
        "gradient": F.col("gradient"),
        "local_mean": F.col("local_mean"),
        "local_std": F.col("local_std"),
        "px": px,
        "py": py,
        "px2": px * px,
        "py2": py * py,
        "centre_distance": F.abs(px - 0.5),
        "green_y": F.col("g") / 255 * py,
        "saturation_y": F.col("sat") / 255 * py,
        "value_y": F.col("val") / 255 * py,
    }
    return textured.select(*key, "y", "x", *keep, *[named[n].alias(n) for n in FEATURES])


def pixel_features(pixels: DataFrame, width: int, height: int, positional: bool = True, key: Sequence[str] = R.KEY) -> DataFrame:
    """Feature vector per pixel, 22 values or 14 without the positional ones."""
    names = FEATURES if positional else FEATURES[:-POSITIONAL]
    return feature_columns(pixels, width, height, key).select(*key, "y", "x", F.array(*names).alias("features"))


def cell_number(value: Column, n: int, parts: int = 3) -> Column:
    """Which of ``parts`` nearly equal slices an index falls into; earlier slices take the remainder."""
    ends = [sum(n // parts + (1 if j < n % parts else 0) for j in range(i + 1)) for i in range(parts)]
    result = F.lit(parts - 1)
    for i in reversed(range(parts - 1)):
        result = F.when(value < ends[i], i).otherwise(result)
    return result


def grid_statistics(pixels: DataFrame, width: int, height: int, grid: int = 3, key: Sequence[str] = R.KEY) -> DataFrame:
    """Mean and population std of the 13 descriptor channels per grid cell (one row per cell)."""
    named = feature_columns(pixels, width, height, key)
    celled = named.withColumn("cell", cell_number(F.col("y"), height, grid) * grid + cell_number(F.col("x"), width, grid))
    return celled.groupBy(*key, "cell").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in DESCRIPTOR], *[F.stddev_pop(c).alias(f"std_{c}") for c in DESCRIPTOR]
    )


def grid_descriptor(pixels: DataFrame, width: int, height: int, grid: int = 3, key: Sequence[str] = R.KEY) -> DataFrame:
    """234 numbers per frame: per cell the 13 means, then the 13 deviations."""
    cells = grid_statistics(pixels, width, height, grid, key)
    part = F.struct("cell", F.array(*[f"mean_{c}" for c in DESCRIPTOR], *[f"std_{c}" for c in DESCRIPTOR]).alias("v"))
    return cells.groupBy(*key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["v"])).alias("features"))


def colour_ratios(pixels: DataFrame, height: int, key: Sequence[str] = R.KEY) -> DataFrame:
    """Share of vegetation colours, of ground colours in the lower half, and brightness."""
    hit = lambda box: F.expr(f"CASE WHEN {colour.in_box(box)} THEN 1.0D ELSE 0.0D END")
    lower = F.col("y") >= height // 2
    return add_colour(pixels).groupBy(*key).agg(
        F.bround(F.avg(hit(colour.VEGETATION_HSV)), 4).alias("vegetation_ratio"),
        F.bround(F.avg(F.when(lower, hit(colour.GROUND_HSV))), 4).alias("ground_ratio_lower"),
        F.bround(F.avg("val") / 255, 4).alias("brightness"),
    )


def extreme(gray: Column, sat: Column) -> Column:
    """Clipped or glaring pixel: nothing can be seen there."""
    return (gray < 16) | (gray > 248) | ((gray >= 170) & (sat <= 28))


def gradient_percentiles(pixels: DataFrame, column: str = "vertical_gradient", key: Sequence[str] = R.KEY) -> DataFrame:
    """P88 (integer, at least 45) and P95 (at least 55) per frame; a frame is a bounded group."""
    return pixels.groupBy(*key).agg(
        F.greatest(F.lit(45.0), F.floor(F.percentile(column, F.lit(0.88)))).alias("p88"),
        F.greatest(F.lit(55.0), F.percentile(column, F.lit(0.95))).alias("p95"),
    )


def vertical_gradient(pixels: DataFrame, key: Sequence[str] = R.KEY, dealt: bool = False) -> DataFrame:
    """8-bit absolute horizontal derivative of gray."""
    return sobel(pixels, "gray", key, dealt).withColumn("vertical_gradient", F.least(F.lit(255.0), F.abs("grad_x"))).drop("grad_x", "grad_y")


def prototype_colours(pixels: DataFrame, height: int, min_n: int = 40, key: Sequence[str] = R.KEY) -> DataFrame:
    """Median Lab of ground seed pixels, bottom and middle zone apart.

    ``pixels`` carries ``seed`` and ``roi`` flags. A zone needs ``min_n`` pixels; with
    neither zone the ROI median stands in, and a neutral grey without any ROI pixel.
    """
    middle = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    lab = ("lab_l8", "lab_a8", "lab_b8")
    zone = F.when(F.col("y") > height * 0.80, "bottom").otherwise("middle")
    zones = (
        pixels.where("seed").withColumn("zone", zone).groupBy(*key, "zone")
        .agg(F.count(F.lit(1)).alias("_n"), *[middle(c) for c in lab])
        .where(F.col("_n") >= min_n).drop("_n")
    )
    fallback = pixels.groupBy(*key).agg(*[F.coalesce(F.percentile(F.when(F.col("roi"), F.col(c)), F.lit(0.5)), F.lit(128.0)).alias(c) for c in lab])
    missing = fallback.join(zones.select(*key).distinct(), list(key), "left_anti").withColumn("zone", F.lit("roi"))
    return zones.unionByName(missing)


def visibility_score(pixels: DataFrame, key: Sequence[str] = R.KEY) -> DataFrame:
    """Blur, exposure and the mixed visibility. ``pixels`` carries gray and flags ``extreme`` and ``roi``."""
    bad = F.sum((F.col("extreme") & F.col("roi")).cast("long")) / F.greatest(F.lit(1), F.sum(F.col("roi").cast("long")))
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    measured = laplacian(pixels, "gray", key).groupBy(*key).agg(F.var_pop("laplacian").alias("sharpness"), bad.alias("_bad"))
    blurred = measured.withColumn("blur_score", clip((1800 - F.col("sharpness")) / 1350))
    return blurred.select(
        *key,
        "blur_score",
        (1 - F.col("_bad")).alias("exposure_score"),
        clip(0.78 * (1 - F.least(F.lit(1.0), F.col("_bad") * 2.4)) + 0.22 * (1 - F.col("blur_score"))).alias("visibility"),
    )


def flag_pixels(pixels: DataFrame, runs: DataFrame, name: str, key: Sequence[str] = R.KEY, tasks: int | None = None) -> DataFrame:
    """Boolean column: does a run cover the pixel? Pixels and the cells of runs are dealt by their place, to ``tasks`` if given."""
    cells = runs.select(*key, "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"), F.lit(True).alias(name))
    pixels = pixels if tasks else pixels.repartition(*key)
    cells = cells.repartition(tasks, *key, "y", "x") if tasks else cells.repartition(*key)
    # runs look small enough for a broadcast, their cells are not
    return pixels.join(cells.hint("merge"), [*key, "y", "x"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
