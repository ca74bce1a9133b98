"""Routes and walks: length, location, dead reckoning, resampling, fusion, georeferencing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.ordered import (
    medians,
    following,
    frame_chunks,
    last_value,
    next_value,
    ordered_scan,
    previous,
    running_sum,
    whole_max,
    whole_min,
    whole_sum,
)

# Earth radius, metres per degree, motion gates, walks per mission.
EARTH_RADIUS_M = 6_371_000
METRES_PER_DEGREE_LNG, METRES_PER_DEGREE_LAT = 111_320, 110_540
MAX_YAW_STEP, MIN_FLOW, MIN_INLIERS, MIN_MATCHES = 0.28, 0.35, 10, 12
MAX_WALKS_PER_MISSION = 4


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lng2 - lng1) / 2), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def route_legs(route: DataFrame, by: Sequence[str], order: str = "idx", huge: bool | None = None) -> DataFrame:
    """One row per leg: its ends, length, distance at its end, and length and point count of the whole route."""
    here = F.struct("lat", "lng")
    legs = ordered_scan(route, by, [order], frame_chunks(order), huge, _p=previous(here)).where(F.col("_p").isNotNull())
    legs = legs.withColumn("length", haversine(F.col("_p.lat"), F.col("_p.lng"), F.col("lat"), F.col("lng")))
    walked = ordered_scan(
        legs, by, [order], frame_chunks(order), huge, end=running_sum(F.col("length")), total=whole_sum(F.col("length")), points=whole_sum(F.lit(1))
    )
    return walked.select(
        *by, order, F.col("_p.lat").alias("lat0"), F.col("_p.lng").alias("lng0"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"),
        "length", "end", "total", (F.col("points") + 1).alias("points"),
    )


def route_length(route: DataFrame, by: Sequence[str], order: str = "idx", huge: bool | None = None) -> DataFrame:
    here = F.struct("lat", "lng")
    legs = ordered_scan(route, by, [order], frame_chunks(order), huge, _p=previous(here))
    length = F.when(F.col("_p").isNotNull(), haversine(F.col("_p.lat"), F.col("_p.lng"), F.col("lat"), F.col("lng"))).otherwise(0.0)
    return legs.groupBy(*by).agg(F.sum(length).alias("length_m"), F.count(F.lit(1)).alias("points"))


def segment_index(fraction: Column, points: Column) -> Column:
    return F.least(F.greatest(F.lit(0), points - 2), F.floor(fraction * F.greatest(F.lit(1), points - 1)))


def playback_index(progress: Column, points: Column, direction: Column) -> Column:
    """Route point shown at a playback position; B→A walks run backwards."""
    share = F.when(direction == "B_TO_A", 1 - progress).otherwise(progress)
    return F.least(points - 1, F.floor(share * (points - 1) + 0.5))


def locate_on_route(
    df: DataFrame, route: DataFrame, by: Sequence[str], fraction: str, row_id: str, order: str = "idx", huge: bool | None = None
) -> DataFrame:
    """Position of each row at its fraction of the route length, plus the segment number.

    Legs, placed at the fraction where they end, and rows meet in one ordered pass.
    A fraction beyond the last leg gives the last point.
    """
    legs = route_legs(route, by, order, huge)
    leg = F.struct("lat0", "lng0", "lat1", "lng1", "length", "end", "total", "points")
    ends = F.when(F.col("total") > 0, F.col("end") / F.col("total")).otherwise(1.0)
    rows = df.select(*by, F.col(fraction).alias("_at"), F.lit(0).alias("_tag"), F.col(row_id).cast("long").alias("_id"), F.struct(*df.columns).alias("_row"))
    empty = F.lit(None).cast(rows.schema["_row"].dataType)
    stack = legs.select(*by, ends.alias("_at"), F.lit(1).alias("_tag"), F.col(order).cast("long").alias("_id"), empty.alias("_row"), leg.alias("_leg"))
    rows = rows.withColumn("_leg", F.lit(None).cast(stack.schema["_leg"].dataType))
    chunk = F.floor(F.col("_at") * 4096).cast("long")
    met = ordered_scan(
        stack.unionByName(rows), by, ["_at", "_tag", "_id"], chunk, huge, _next=next_value(F.col("_leg")), _last=last_value(F.col("_leg"))
    ).where(F.col("_tag") == 0)
    at = F.col(f"_row.{fraction}") * F.col("_next.total")
    part = F.when(F.col("_next.length") > 0, (at - (F.col("_next.end") - F.col("_next.length"))) / F.col("_next.length")).otherwise(0.0)
    on = lambda c: F.coalesce(F.col(f"_next.{c}0") + (F.col(f"_next.{c}1") - F.col(f"_next.{c}0")) * part, F.col(f"_last.{c}1"))
    return met.select(
        *[F.col(f"_row.{c}").alias(c) for c in df.columns],
        on("lat").alias("lat"),
        on("lng").alias("lng"),
        segment_index(F.col(f"_row.{fraction}"), F.coalesce("_next.points", "_last.points")).alias("segment_index"),
    )


def integrate_motion(pairs: DataFrame, directions: DataFrame, by: Sequence[str] = ("video_id",), huge: bool | None = None) -> DataFrame:
    """Dead reckoning from pairwise motion: turn, then one step ahead. B→A walks are reversed.

    ``pairs(by…, step ≥ 1, yaw_delta, flow, matches, inliers)``; the result starts with point 0.
    """
    seen = (F.col("matches") >= MIN_MATCHES) & (F.col("flow") >= MIN_FLOW) & (F.col("inliers") >= MIN_INLIERS)
    turn = F.when(seen, F.greatest(F.lit(-MAX_YAW_STEP), F.least(F.lit(MAX_YAW_STEP), F.col("yaw_delta")))).otherwise(0.0)
    turned = ordered_scan(
        pairs.select(*by, F.col("step").cast("long").alias("step"), seen.alias("_seen"), turn.alias("_turn")),
        by, ["step"], frame_chunks("step"), huge, _yaw=running_sum(F.col("_turn")), _n=whole_max(F.col("step")), _1=whole_min(F.col("step")),
    )
    walked = ordered_scan(
        turned, by, ["step"], frame_chunks("step"), huge,
        x=running_sum(F.when(F.col("_seen"), F.sin("_yaw")).otherwise(0.0)),
        y=running_sum(F.when(F.col("_seen"), F.cos("_yaw")).otherwise(0.0)),
    )
    here = F.struct("step", "x", "y")
    origin = F.struct(F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    points = walked.select(*by, "_n", F.inline(F.when(F.col("step") == F.col("_1"), F.array(origin, here)).otherwise(F.array(here))))
    backwards = F.col("direction") == "B_TO_A"
    return points.join(directions.select(*by, "direction"), list(by)).select(
        *by, F.when(backwards, F.col("_n") - F.col("step")).otherwise(F.col("step")).alias("idx"), "x", "y"
    )


def traversal_quality(pairs: DataFrame, by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Per walk: tracked share, median matches and inliers, mean pair quality."""
    seen = (F.col("matches") >= MIN_MATCHES) & (F.col("flow") >= MIN_FLOW) & (F.col("inliers") >= MIN_INLIERS)
    quality = F.when(F.col("matches") >= MIN_MATCHES, F.least(F.lit(1.0), F.col("inliers") / 45) * F.least(F.lit(1.0), F.col("matches") / 80)).otherwise(0.0)
    base = pairs.groupBy(*by).agg(
        (F.sum(seen.cast("long")) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("tracked_fraction"), F.avg(quality).alias("mean_pair_quality")
    )
    return base.join(medians(pairs, by, ("matches", "inliers")), list(by), "left")  # a walk without any value keeps its row


def mission_quality(per_video: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Mission means and medians over its walks (at most four rows per mission)."""
    return per_video.groupBy(mission).agg(
        F.count(F.lit(1)).alias("traversals_aligned"),
        F.bround(F.avg("tracked_fraction"), 3).alias("tracked_frame_fraction"),
        F.bround(F.percentile("median_matches", F.lit(0.5)), 1).alias("median_stable_matches"),
        F.bround(F.percentile("median_inliers", F.lit(0.5)), 1).alias("median_pose_inliers"),
        F.avg("mean_pair_quality").alias("mean_pair_quality"),
    )


def anchor(points: DataFrame, lengths: DataFrame, by: Sequence[str] = ("video_id",), idx: str = "idx", huge: bool | None = None) -> DataFrame:
    """Move the start to the origin, turn the end onto the forward axis, scale to the known length.

    ``lengths(by…, target_length)``. A walk whose end hardly moved gets its steps spread forward first.
    """
    here = F.struct(F.col(idx).alias("i"), "x", "y")
    ends = ordered_scan(points, by, [idx], frame_chunks(idx), huge, _a=whole_min(here), _b=whole_max(here), _n=whole_sum(F.lit(1)))
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    weak = F.hypot(dx, dy) < F.greatest(F.lit(2.0), F.col("_n") * 0.03)
    vy = F.when(weak, dy + F.col("_n") - 1).otherwise(dy)
    angle = F.atan2(dx, vy)
    turned = ends.withColumn("_weak", weak).withColumn("_c", F.cos(angle)).withColumn("_s", F.sin(angle)).withColumn("_forward", dx * F.sin(angle) + vy * F.cos(angle))
    px = F.col("x") - F.col("_a.x")
    py = F.col("y") - F.col("_a.y") + F.when(F.col("_weak"), F.col(idx)).otherwise(0)
    scale = F.col("target_length") / F.greatest(F.lit(1e-6), F.col("_forward"))
    return turned.join(lengths, list(by)).select(
        *by, idx, ((px * F.col("_c") - py * F.col("_s")) * scale).alias("x"), ((px * F.col("_s") + py * F.col("_c")) * scale).alias("y")
    )


def to_geo(points: DataFrame, missions: DataFrame, by: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Local lateral/forward metres to lat/lng along the start→end bearing.

    ``missions(by…, start_lat, start_lng, end_lat, end_lng)``.
    """
    mid = F.cos(F.radians((F.col("start_lat") + F.col("end_lat")) / 2))
    east = (F.col("end_lng") - F.col("start_lng")) * METRES_PER_DEGREE_LNG * mid
    north = (F.col("end_lat") - F.col("start_lat")) * METRES_PER_DEGREE_LAT
    bearing = F.atan2(east, north)
    e = F.col("y") * F.sin(bearing) + F.col("x") * F.cos(bearing)
    n = F.col("y") * F.cos(bearing) - F.col("x") * F.sin(bearing)
    joined = points.join(missions.select(*by, "start_lat", "start_lng", "end_lat", "end_lng"), list(by))
    return joined.select(
        *points.columns,
        (F.col("start_lat") + n / METRES_PER_DEGREE_LAT).alias("lat"),
        (F.col("start_lng") + e / (METRES_PER_DEGREE_LNG * mid)).alias("lng"),
    )


def resample(points: DataFrame, by: Sequence[str], n: int = 64, idx: str = "idx", huge: bool | None = None) -> DataFrame:
    """``n`` points at equal arc length; a line without length becomes a unit straight.

    Every leg emits the targets that fall on it. Target ranges of neighbouring legs share
    their boundary number, so none is lost or doubled, and no join is needed.
    """
    here = F.struct("x", "y")
    moved = ordered_scan(points, by, [idx], frame_chunks(idx), huge, _p=previous(here), _last=whole_max(F.col(idx)))
    step = F.when(F.col("_p").isNotNull(), F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y"))).otherwise(0.0)
    along = ordered_scan(
        moved.withColumn("_d", step), by, [idx], frame_chunks(idx), huge, _at=running_sum(F.col("_d")), _total=whole_sum(F.col("_d"))
    )
    # The leg's start is the very number stored at its predecessor, not a difference of sums.
    along = ordered_scan(along, by, [idx], frame_chunks(idx), huge, _start=previous(F.col("_at")))
    flat = F.col("_total") < 1e-6
    last = F.col(idx) == F.col("_last")
    number = lambda at: F.when(at >= F.col("_total"), n - 1).otherwise(F.ceil(at * (n - 1) / F.col("_total")))
    start = F.coalesce("_start", F.lit(0.0))
    first = F.when(flat, 0).otherwise(number(start)).cast("long")
    stop = F.when(last, n - 1).when(flat, -1).otherwise(number(F.col("_at")) - 1).cast("long")
    legs = along.withColumn("_from", first).withColumn("_to", stop).where((F.col("_from") <= F.col("_to")) & (last | F.col("_p").isNotNull()))
    placed = legs.withColumn("_i", F.explode(F.sequence("_from", "_to")))
    target = F.col("_i") * F.col("_total") / (n - 1)
    share = F.when(F.col("_d") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (target - start) / F.col("_d")))).otherwise(1.0)
    at = lambda c: F.coalesce(F.col(f"_p.{c}"), F.col(c)) + (F.col(c) - F.coalesce(F.col(f"_p.{c}"), F.col(c))) * share
    return placed.select(
        *by, F.col("_i").alias("idx"), F.when(flat, F.col("_i") / (n - 1)).otherwise(at("x")).alias("x"), F.when(flat, 0.0).otherwise(at("y")).alias("y")
    )


def abrupt_turns(points: DataFrame, by: Sequence[str], degrees: float = 50, idx: str = "idx", huge: bool | None = None) -> DataFrame:
    """Number of heading changes above ``degrees``; the change is taken the short way round."""
    moved = ordered_scan(points, by, [idx], frame_chunks(idx), huge, _p=previous(F.struct("x", "y"))).where(F.col("_p").isNotNull())
    headed = moved.withColumn("_h", F.atan2(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")))
    turned = ordered_scan(headed.select(*by, idx, "_h"), by, [idx], frame_chunks(idx), huge, _before=previous(F.col("_h")))
    change = F.col("_h") - F.col("_before")
    short = change - 2 * math.pi * F.floor((change + math.pi) / (2 * math.pi))
    return turned.groupBy(*by).agg(F.coalesce(F.sum((F.abs(short) > math.radians(degrees)).cast("long")), F.lit(0)).alias("abrupt_turns"))


def monotonic_evidence(keyframes: DataFrame, videos: DataFrame, huge: bool | None = None) -> DataFrame:
    """Does the route fraction never go back along any walk of the mission?"""
    ordered = ordered_scan(
        keyframes, ["video_id"], ["timestamp_ms", "keyframe_id"], F.floor(F.col("timestamp_ms") / 600_000).cast("long"), huge,
        _before=previous(F.col("route_fraction")),
    )
    joined = ordered.join(videos.select("video_id", "mission_id", "direction"), "video_id")
    forth = F.col("_before") <= F.col("route_fraction")
    back = F.col("_before") >= F.col("route_fraction")
    ok = F.coalesce(F.when(F.col("direction") == "B_TO_A", back).otherwise(forth), F.lit(True))
    return joined.groupBy("mission_id").agg(F.bool_and(ok).alias("monotonic"))


def fuse_traversals(points: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Median line and RMS spread per point number; a mission has at most four walks."""
    middle = points.groupBy(mission, "idx").agg(
        F.percentile("x", F.lit(0.5)).alias("_mx"), F.percentile("y", F.lit(0.5)).alias("_my")
    )
    spread = F.sqrt(F.avg(F.pow(F.col("x") - F.col("_mx"), 2) + F.pow(F.col("y") - F.col("_my"), 2)))
    return points.join(middle, [mission, "idx"]).groupBy(mission, "idx").agg(
        F.first("_mx").alias("x"), F.first("_my").alias("y"), spread.alias("spread")
    )


def traversal_pair_rmse(points: DataFrame, mission: str = "mission_id") -> DataFrame:
    """RMSE of every pair of walks of a mission.

    A mission holds at most four walks, which the job itself verifies; so each point
    number carries at most six pairs and no self-join is needed.
    """
    walks = points.groupBy(mission, "idx").agg(F.sort_array(F.collect_list(F.struct("video_id", "x", "y"))).alias("_w"))
    checked = walks.withColumn(
        "_w", F.when(F.size("_w") <= MAX_WALKS_PER_MISSION, F.col("_w")).otherwise(F.raise_error(F.lit("more than four walks in a mission")))
    )
    paired = F.flatten(
        F.transform(
            "_w",
            lambda a, i: F.transform(
                F.filter("_w", lambda b, j: j > i),
                lambda b: F.struct(
                    a["video_id"].alias("a"), b["video_id"].alias("b"), (F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)).alias("d2")
                ),
            ),
        )
    )
    return checked.select(mission, F.inline(paired)).groupBy(mission, "a", "b").agg(F.sqrt(F.avg("d2")).alias("rmse"))


def fused_route_metrics(points: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Length of the fused line (64 points) and its largest sideways deviation; both ends are anchored."""
    line = Window.partitionBy(mission).orderBy("idx")
    ends = points.groupBy(mission).agg(F.min_by("x", "idx").alias("_x0"), F.max_by("x", "idx").alias("_x1"), F.count(F.lit(1)).alias("_n"))
    stepped = points.withColumn("_d", F.hypot(F.col("x") - F.lag("x").over(line), F.col("y") - F.lag("y").over(line))).join(ends, mission)
    straight = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * F.col("idx") / F.greatest(F.lit(1), F.col("_n") - 1)
    return stepped.groupBy(mission).agg(
        F.bround(F.coalesce(F.sum("_d"), F.lit(0.0)), 2).alias("route_length_m"),
        F.bround(F.max(F.abs(F.col("x") - straight)), 3).alias("max_curve_deviation_m"),
        F.lit(0.0).alias("start_anchor_error_m"),
        F.lit(0.0).alias("end_anchor_error_m"),
    )


def segment_confidence(fused: DataFrame, quality: DataFrame, lengths: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Confidence and status of every segment between neighbouring fused points."""
    line = Window.partitionBy(mission).orderBy("idx")
    segments = fused.withColumn("_more", F.lead("idx").over(line)).where(F.col("_more").isNotNull())
    agreement = F.greatest(F.lit(0.0), 1 - F.col("spread") / F.greatest(F.lit(1.0), F.col("target_length") * 0.08))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.25 + 0.45 * F.col("mean_pair_quality") + 0.3 * agreement))
    scored = segments.join(quality.select(mission, "mean_pair_quality"), mission).join(lengths.select(mission, "target_length"), mission).withColumn("_c", raw)
    return scored.select(
        mission,
        F.col("idx").alias("segment"),
        F.bround("_c", 3).alias("confidence"),
        F.when(F.col("_c") >= 0.7, "secure").when(F.col("_c") >= 0.42, "uncertain").otherwise("not_reconstructed").alias("status"),
        F.bround("spread", 3).alias("spread_m"),
    )


def nearest_evidence(segments: DataFrame, keyframes: DataFrame, mission: str = "mission_id", k: int = 2, huge: bool | None = None) -> DataFrame:
    """The two keyframes nearest to each segment's route fraction.

    Equal fractions keep their first two keyframes; then the two distinct fractions
    before and after a target are enough, found in one ordered pass.
    """
    if k != 2:
        raise ValueError("two keyframes per segment")
    first = Window.partitionBy(mission, "route_fraction").orderBy("seq")
    pairs = (
        keyframes.withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= k)
        .groupBy(mission, "route_fraction")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "keyframe_id", "route_fraction"))).alias("_k"))
    )
    chunk = F.floor(F.col("route_fraction") * 1024).cast("long")
    linked = ordered_scan(pairs, [mission], ["route_fraction"], chunk, huge, _b=previous(F.col("_k")), _a=following(F.col("_k")))
    known = linked.select(mission, "route_fraction", F.lit(0).alias("_tag"), F.lit(-1).cast("long").alias("_id"), F.struct("_k", "_b", "_a").alias("_hit"))
    asked = segments.select(mission, F.col("fraction").alias("route_fraction"), F.lit(1).alias("_tag"), F.col("segment").cast("long").alias("_id"))
    stacked = known.unionByName(asked.withColumn("_hit", F.lit(None).cast(known.schema["_hit"].dataType)))
    met = ordered_scan(
        stacked, [mission], ["route_fraction", "_tag", "_id"], chunk, huge, _l=last_value(F.col("_hit")), _r=next_value(F.col("_hit"))
    ).where(F.col("_tag") == 1)
    none = F.array().cast(known.schema["_hit"].dataType["_k"].dataType)
    all_ = F.concat(*[F.coalesce(F.col(c), none) for c in ("_l._k", "_l._b", "_r._k", "_r._a")])
    ranked = F.slice(
        F.array_sort(
            F.transform(all_, lambda c: F.struct(F.abs(c["route_fraction"] - F.col("route_fraction")).alias("gap"), c["seq"].alias("seq"), c["keyframe_id"].alias("keyframe_id")))
        ),
        1,
        k,
    )
    return met.select(mission, F.col("_id").alias("segment"), F.posexplode(ranked).alias("_i", "_c")).select(
        mission, "segment", F.col("_c.keyframe_id").alias("keyframe_id"), (F.col("_i") + 1).alias("rank")
    )


def geojson_lines(points: DataFrame, by: Sequence[str], order: str = "idx", lng: str = "lng", lat: str = "lat") -> DataFrame:
    """One GeoJSON LineString feature per line; a line has the fixed number of resampled points."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), F.col(lng).alias("lng"), F.col(lat).alias("lat"))))
    pairs = F.transform(ordered, lambda p: F.array(p["lng"], p["lat"]))
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(*by).alias("properties"),
            F.struct(F.lit("LineString").alias("type"), F.col("_c").alias("coordinates")).alias("geometry"),
        )
    )
    return points.groupBy(*by).agg(pairs.alias("_c")).select(*by, feature.alias("feature"))
