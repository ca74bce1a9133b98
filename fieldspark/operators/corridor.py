"""Corridor checks on masks: three parallel strips in the near field."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators import runs as R

# Corridor geometry and decision limits.
VEHICLE_WIDTH_M, CLEARANCE_M, GROUND_WIDTH_M = 1.2, 0.10, 4.0
SEARCH_FACTOR = 1.5
OFFSETS = {"mitte": 0.0, "rechts": 1.0, "links": -1.0}
NEAR_FIELD_START = 0.42
MIN_ROWS, MAX_CLIPPED, MAX_BLOCKED = 8, 0.2, 0.05
SAMPLE_ROWS, SMOOTHING = 28, 9
FREE_GRADES, UNCERTAIN_GRADES = (1, 2), (3, 4)
STATUS_RANK = ("free", "uncertain", "blocked")


def moving_average(df: DataFrame, by: Sequence[str], order: str, column: str, n: int = SMOOTHING, out: str | None = None) -> DataFrame:
    """Centred mean whose missing neighbours repeat the edge value; fewer than three points stay as they are.

    Groups are lines of one frame, bounded by the image height.
    """
    half = n // 2
    w = Window.partitionBy(*by).orderBy(order)
    around, whole = w.rowsBetween(-half, half), Window.partitionBy(*by)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, size = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    before = F.greatest(F.lit(0), half - (at - 1))
    after = F.greatest(F.lit(0), half - (size - at))
    total = F.sum(column).over(around) + before * F.first(column).over(full) + after * F.last(column).over(full)
    return df.withColumn(out or column, F.when(size < 3, F.col(column)).otherwise(total / n))


def thin_points(df: DataFrame, by: Sequence[str], order: str, k: int = 9, half_even: bool = False) -> DataFrame:
    """At most ``k`` evenly spaced rows with both ends; lines are bounded (≤ 400 points)."""
    w = Window.partitionBy(*by).orderBy(order)
    place = lambda i: (F.rint(i) if half_even else F.floor(i + 0.5)).cast("int")
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: place(i * (F.col("_n") - 1) / (k - 1)))
    return (
        df.withColumn("_i", F.row_number().over(w) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        .where((F.col("_n") <= k) | F.array_contains(picks, F.col("_i")))
        .drop("_i", "_n")
    )


def strips(width: int, height: int, vehicle: float, clearance: float, ground: float) -> list[tuple]:
    """(name, first column, end column, clipped share, required pixels) of the three strips."""
    strip = (vehicle + clearance) / ground * width
    band = strip * SEARCH_FACTOR
    result = []
    for name, offset in OFFSETS.items():
        start, stop = width / 2 + offset * strip - band / 2, width / 2 + offset * strip + band / 2
        low, high = (min(width, max(0, v)) for v in (math.floor(start), math.ceil(stop)))
        outside = max(0.0, -start) + max(0.0, stop - width)
        result.append((name, int(low), int(high), outside / max(1.0, band), max(1, math.ceil(strip))))
    return result


def evaluate_rows(
    runs: DataFrame, frames: DataFrame, width: int, height: int, graded: bool, vehicle: float, clearance: float, ground: float, key: Sequence[str]
) -> DataFrame:
    """Status and drivable centre per frame, corridor and image row. Everything is arithmetic on runs."""
    if ground <= 0:
        raise ValueError("ground width must be positive")
    table = strips(width, height, vehicle, clearance, ground)
    first_row = min(height - 1, max(0, round(height * NEAR_FIELD_START)))
    lanes = F.array(
        *[
            F.struct(F.lit(n).alias("corridor"), F.lit(a).alias("_a"), F.lit(b).alias("_b"), F.lit(c).alias("_clip"), F.lit(need).alias("_need"))
            for n, a, b, c, need in table
        ]
    )
    grid = frames.select(*key, F.explode(F.expr(f"sequence({first_row}, {height - 1})")).alias("y")).select("*", F.inline(lanes))
    near = runs.where(F.col("y") >= first_row)
    free = R.merge_runs(near.where(F.col("value").isin(*FREE_GRADES)) if graded else near.where(F.col("value") != 0), key)
    kinds = [free.withColumn("_kind", F.lit(0))]
    if graded:
        usable = R.merge_runs(near.where(F.col("value").isin(*FREE_GRADES, *UNCERTAIN_GRADES)), key)
        kinds += [usable.withColumn("_kind", F.lit(1)), near.where(F.col("value") != 0).select(*key, "y", "x0", "x1", "value", F.lit(2).alias("_kind"))]
    stacked = kinds[0]
    for part in kinds[1:]:
        stacked = stacked.unionByName(part)
    clipped = (
        stacked.select(*key, "y", "x0", "x1", "_kind", F.inline(lanes))
        .withColumn("x0", F.greatest("x0", "_a"))
        .withColumn("x1", F.least("x1", "_b"))
        .where(F.col("x0") < F.col("x1"))
    )
    widest = lambda kind: F.max(F.when(F.col("_kind") == kind, F.struct((F.col("x1") - F.col("x0")).alias("len"), (-F.col("x0")).alias("neg"))))
    measured = clipped.groupBy(*key, "corridor", "y").agg(widest(0).alias("_f"), widest(1).alias("_u"), F.count(F.when(F.col("_kind") == 2, 1)).alias("_d"))
    joined = grid.join(measured, [*key, "corridor", "y"], "left")
    length = lambda c: F.coalesce(F.col(f"{c}.len"), F.lit(0))
    decided = (F.col("_a") < F.col("_b")) & (F.coalesce("_d", F.lit(0)) > 0 if graded else F.lit(True))
    status = (
        F.when(~decided, F.lit(None))
        .when(F.col("_clip") > MAX_CLIPPED, "uncertain")
        .when(length("_f") >= F.col("_need"), "free")
        .when(length("_u") >= F.col("_need"), "uncertain")
        .otherwise("blocked")
    )
    chosen = F.when(F.col("row_status") == "free", F.col("_f")).otherwise(F.col("_u") if graded else F.col("_f"))
    centre = F.when(
        F.col("row_status").isin("free", "uncertain") & chosen.isNotNull(), -chosen["neg"] + (chosen["len"] - 1) / 2
    )
    return joined.withColumn("row_status", status).withColumn("centre", centre).select(*key, "corridor", "y", "row_status", "centre")


def evaluate_corridors(
    runs: DataFrame,
    frames: DataFrame,
    width: int,
    height: int,
    graded: bool = False,
    vehicle: float = VEHICLE_WIDTH_M,
    clearance: float = CLEARANCE_M,
    ground: float = GROUND_WIDTH_M,
    key: Sequence[str] = R.KEY,
) -> DataFrame:
    """Status, row counts and sampled centre line per frame and corridor."""
    by = [*key, "corridor"]
    rows = evaluate_rows(runs, frames, width, height, graded, vehicle, clearance, ground, key)
    count = lambda s: F.sum((F.col("row_status") == s).cast("long"))
    counted = rows.groupBy(*by).agg(
        F.count("row_status").alias("evaluated"),
        *[F.coalesce(count(s), F.lit(0)).alias(s) for s in STATUS_RANK],
        F.sum(F.col("row_status").isNull().cast("long")).alias("undecided"),
        F.count("centre").alias("drivable_rows"),
    )
    blocked, uncertain, evaluated = F.col("blocked"), F.col("uncertain"), F.col("evaluated")
    status = (
        F.when(evaluated < MIN_ROWS, "uncertain")
        .when(blocked > MAX_BLOCKED * evaluated, "blocked")
        .when((blocked > 0) | (uncertain > 0), "uncertain")
        .otherwise("free")
    )
    line = thin_points(moving_average(rows.where(F.col("centre").isNotNull()), by, "y", "centre"), by, "y", SAMPLE_ROWS, half_even=True)
    px = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(float(width - 1)), F.col("centre"))) / max(1, width - 1), 5)
    points = line.groupBy(*by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("y", px.alias("x")))),
            lambda p: F.struct(p["x"].alias("x"), F.bround(p["y"] / F.lit(float(max(1, height - 1))), 5).alias("y")),
        ).alias("points")
    )
    return counted.withColumn("status", status).join(points, by, "left")


def corridor_rank(status: Column, corridor: Column) -> Column:
    rank = F.lit(len(STATUS_RANK))
    for i, name in enumerate(STATUS_RANK):
        rank = F.when(status == name, i).otherwise(rank)
    place = F.lit(len(OFFSETS))
    for i, name in enumerate(OFFSETS):
        place = F.when(corridor == name, i).otherwise(place)
    return F.struct(rank.alias("status"), place.alias("corridor"))


def propose_corridor(corridors: DataFrame, key: Sequence[str] = R.KEY) -> DataFrame:
    """Best corridor with a centre line: status first, then middle, right, left."""
    return (
        corridors.where(F.col("points").isNotNull())
        .groupBy(*key)
        .agg(F.min_by(F.struct("corridor", "status", "points"), corridor_rank(F.col("status"), F.col("corridor"))).alias("_b"))
        .select(*key, "_b.*")
    )
