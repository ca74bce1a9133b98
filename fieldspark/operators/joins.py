"""Generic time, interval and space joins, and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.ordered import last_value, max_before, next_value, ordered_scan

MEDIA_CHUNK_MS = 600_000


def media_chunks(column: str, width: int = MEDIA_CHUNK_MS) -> Column:
    """Ten minutes of media time: the frame rate bounds how many frames fit."""
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def _stacked(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, right_tie: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Right rows (tag 0) and left rows (tag 1) in one ordered table with boxed payloads."""
    payload = [c for c in right.columns if c not in (*by, on)]
    # Equal right times keep one row, reduced map-side: the first by tie key.
    hits = right.groupBy(*by, on).agg(
        F.min_by(F.struct(F.col(on).alias("_time"), *payload), F.struct(*right_tie)).alias("_hit")
    )
    rows = left.select(*by, on, F.struct(*left.columns).alias("_row"))
    both = hits.select(*by, on, F.lit(0).alias("_tag"), "_hit", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(0).cast("long").alias("_id"))
    both = both.unionByName(
        rows.select(*by, on, F.lit(1).alias("_tag"), F.lit(None).cast(hits.schema["_hit"].dataType).alias("_hit"), "_row", F.xxhash64("_row").alias("_id"))
    )
    return both, payload


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, tolerance: int, right_tie: Sequence[str], huge: bool | None = None
) -> DataFrame:
    """Latest right row at or before each left row, if not older than ``tolerance``."""
    both, payload = _stacked(left, right, by, on, right_tie)
    scanned = ordered_scan(both, by, [on, "_tag", "_id"], media_chunks(on), huge, _found=last_value(F.col("_hit")))
    fits = F.col("_row")[on] - F.col("_found._time") <= tolerance
    return scanned.where(F.col("_tag") == 1).select(
        "_row.*", *[F.when(fits, F.col("_found")[c]).alias(f"right_{c}") for c in payload], F.when(fits, F.col("_found._time")).alias(f"right_{on}")
    )


def nearest_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, right_tie: Sequence[str], tolerance: int = 180, huge: bool | None = None
) -> DataFrame:
    """Right row nearest in time within ``tolerance``; the earlier one wins a tie."""
    both, payload = _stacked(left, right, by, on, right_tie)
    scanned = ordered_scan(
        both, by, [on, "_tag", "_id"], media_chunks(on), huge, _back=last_value(F.col("_hit")), _ahead=next_value(F.col("_hit"))
    )
    time = F.col("_row")[on]
    back, ahead = time - F.col("_back._time"), F.col("_ahead._time") - time
    closer = F.when(ahead.isNull() | (back <= ahead), F.col("_back")).otherwise(F.col("_ahead"))
    fits = F.abs(F.col("_near._time") - time) <= tolerance
    return (
        scanned.where(F.col("_tag") == 1)
        .withColumn("_near", closer)
        .select("_row.*", *[F.when(fits, F.col("_near")[c]).alias(f"right_{c}") for c in payload], F.when(fits, F.col("_near._time")).alias(f"right_{on}"))
    )


def overlapping_intervals(df: DataFrame, by: Sequence[str], start: str, end: str, tie: str, huge: bool | None = None) -> DataFrame:
    """Intervals that overlap an earlier one of the same group; touching is fine."""
    scanned = ordered_scan(df, by, [start, tie], media_chunks(start), huge, _reach=max_before(F.col(end)))
    return scanned.where(F.col("_reach") > F.col(start)).drop("_reach")


def point_in_polygon(px: Column, py: Column, polygon: Column) -> Column:
    """Even-odd test over ``array<struct<x,y>>``."""
    n = F.size(polygon)

    def crosses(a: Column, i: Column) -> Column:
        b = F.element_at(polygon, F.when(i == 0, n).otherwise(i).cast("int"))
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(polygon, lambda a, i: F.coalesce(crosses(a, i), F.lit(False)))) % 2 == 1


def region_at_point(points: DataFrame, regions: DataFrame, by: Sequence[str], priority: dict[str, int]) -> DataFrame:
    """Region under each point, highest risk class first.

    Equi-join on the frame, then a bounding-box test before the exact one. ``points``
    needs ``point_id``; regions need ``region_id``, ``class_id``, ``polygon``, ``seq`` (list order).
    """
    boxed = regions.withColumn("_x", F.transform("polygon", lambda p: p["x"])).withColumn("_y", F.transform("polygon", lambda p: p["y"]))
    risk = F.create_map(*[F.lit(v) for pair in priority.items() for v in pair])
    hits = (
        points.join(boxed, list(by))
        .where(F.col("px").between(F.array_min("_x"), F.array_max("_x")) & F.col("py").between(F.array_min("_y"), F.array_max("_y")))
        .where(point_in_polygon(F.col("px"), F.col("py"), F.col("polygon")))
        .groupBy(*by, "point_id")
        .agg(F.max_by("region_id", F.struct(risk[F.col("class_id")].alias("r"), (-F.col("seq")).alias("s"))).alias("region_id"))
    )
    return points.join(hits, [*by, "point_id"], "left")


def minus(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``."""
    return a.join(b.select(*key).distinct(), list(key), "left_anti")


def removed_runs(registry: DataFrame, inventory: DataFrame, key: Sequence[str] = ("run_id",)) -> DataFrame:
    return minus(registry, inventory, key)


def unprocessed_frames(frames: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    return minus(frames, done, key)


def union_all(*parts: DataFrame) -> DataFrame:
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked


def shared_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys in both tables; training and validation must share none."""
    return a.select(*key).intersect(b.select(*key))


def assert_disjoint(a: DataFrame, b: DataFrame, key: Sequence[str]) -> None:
    leaked = shared_keys(a, b, key).take(3)
    if leaked:
        raise ValueError(f"rows in both parts, e.g. {[tuple(r) for r in leaked]}")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Best ``k`` rows per group; Spark keeps only k per group and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
