"""Constraint sets of the stored record types, and a check that counts every broken rule in the pass that writes the records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fieldspark.functions.rules import in_range, length_between, one_of, optional, two_distinct

# Allowed words, patterns and limits of the record types.
DIRECTIONS = ("A_TO_B", "B_TO_A")
ORIENTATIONS = ("PORTRAIT", "LANDSCAPE")
CERTAINTIES = ("certain", "uncertain", "partially_occluded")
POLYGON_ORIGINS = ("manual", "model_proposal", "manual_corrected", "human_confirmed")
EDITS = ("new", "carried_unchanged", "carried_adjusted", "corrected")
FRAME_STATUSES = ("draft", "confirmed", "skipped")
LABEL_MODES = ("linear", "shuffle")
CORRIDORS = ("mitte", "rechts", "links")
TRAJECTORY_ORIGINS = ("model_proposal", "manual_edit", "manual")
NAME_PATTERN = "^[a-zA-Z0-9_-]+$"
HASH_PATTERN = "^[a-fA-F0-9]+$"
SHORTEST_INTERVAL_MS = 200
WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"


def matches(value: Column, pattern: str) -> Column:
    """The whole value fits a pattern; a line end after it does not pass."""
    return value.rlike(pattern) & ~value.contains("\n")


def _name(column: str) -> Column:
    return length_between(F.col(column), 1, 80) & matches(F.col(column), NAME_PATTERN)


def mission_rules() -> dict[str, Column]:
    """``name, notes``, and optional ``start``/``end`` (lat, lng) and ``route``, ``pauses``."""
    c = F.col
    place = lambda p: in_range(p["lat"], -90, 90) & in_range(p["lng"], -180, 180)
    return {
        "name_length": length_between(c("name"), 3, 120),
        "notes_length": length_between(c("notes"), 0, 5000),
        "start_range": optional(c("start"), place(c("start"))),
        "end_range": optional(c("end"), place(c("end"))),
        "route_range": optional(c("route"), F.forall("route", place)),
        "pause_order": optional(c("pauses"), F.forall("pauses", lambda p: (p["start_seconds"] >= 0) & (p["end_seconds"] >= p["start_seconds"]))),
    }


def video_rules() -> dict[str, Column]:
    return {
        "direction": one_of(F.col("direction"), DIRECTIONS),
        "orientation": one_of(F.col("orientation"), ORIENTATIONS),
        "terrain_length": optional(F.col("terrain_category"), length_between(F.col("terrain_category"), 1, 120)),
    }


def polygon_rules() -> dict[str, Column]:
    """``points array<array<double>>`` beside the plain fields."""
    c = F.col
    return {
        "id_pattern": _name("id"),
        "point_count": F.size("points").between(3, 500),
        "certainty": one_of(c("certainty"), CERTAINTIES),
        "origin": one_of(c("origin"), POLYGON_ORIGINS),
        "note_length": length_between(c("note"), 0, 500),
        "reason_length": length_between(c("uncertainty_reason"), 0, 120),
        "tracking_pattern": optional(c("tracking_id"), _name("tracking_id")),
        "carried_from": optional(c("carried_from_frame"), c("carried_from_frame") >= 0),
        "edit": one_of(c("edit"), EDITS),
    }


def annotation_rules() -> dict[str, Column]:
    """A frame's record with ``n_polygons`` and ``n_roi``, the sizes of its lists."""
    c = F.col
    return {
        "timestamp": c("timestamp_ms") >= 0,
        "hash_pattern": optional(c("source_frame_hash"), length_between(c("source_frame_hash"), 12, 128) & matches(c("source_frame_hash"), HASH_PATTERN)),
        "polygon_count": c("n_polygons").between(0, 120),
        "roi_count": c("n_roi").between(0, 20),
        "status": one_of(c("status"), FRAME_STATUSES),
        "annotator_length": length_between(c("annotator"), 1, 80),
        "notes_length": length_between(c("notes"), 0, 1000),
        "frame_width": optional(c("frame_width"), in_range(c("frame_width"), 1, 16384)),
        "frame_height": optional(c("frame_height"), in_range(c("frame_height"), 1, 16384)),
        "label_mode": one_of(c("label_mode"), LABEL_MODES),
    }


def roi_profile_rules() -> dict[str, Column]:
    c = F.col
    band = lambda name: optional(c(name), (c(name) > 0) & (c(name) < 1))
    room = F.coalesce(c("top_ignore_fraction"), F.lit(0.0)) + F.coalesce(c("bottom_ignore_fraction"), F.lit(0.0)) < 1
    return {"top_band": band("top_ignore_fraction"), "bottom_band": band("bottom_ignore_fraction"), "room_between": room, "note_length": length_between(c("note"), 0, 1000)}


def interval_rules() -> dict[str, Column]:
    c = F.col
    return {
        "start": c("start_ms") >= 0,
        "order": c("end_ms") > c("start_ms"),
        "too_short": c("end_ms") - c("start_ms") >= SHORTEST_INTERVAL_MS,
        "note_length": length_between(c("note"), 0, 500),
        "annotator_length": length_between(c("annotator"), 1, 80),
    }


def trajectory_rules() -> dict[str, Column]:
    """``points array<array<double>>``, normalised to the frame."""
    c = F.col
    return {
        "timestamp": c("timestamp_ms") >= 0,
        "point_count": F.size("points").between(2, 400),
        "normalised": F.forall("points", lambda p: F.forall(p, lambda v: v.between(0, 1))),
        "distinct_points": two_distinct(c("points"), lambda p: F.transform(p, lambda v: F.bround(v, 8))),
        "corridor": optional(c("corridor"), one_of(c("corridor"), CORRIDORS)),
        "origin": one_of(c("origin"), TRAJECTORY_ORIGINS),
        "note_length": length_between(c("note"), 0, 1000),
        "annotator_length": length_between(c("annotator"), 1, 80),
    }


RULES: dict[str, Callable[[], dict[str, Column]]] = {
    "mission": mission_rules,
    "video": video_rules,
    "polygon": polygon_rules,
    "annotation": annotation_rules,
    "roi_profile": roi_profile_rules,
    "interval": interval_rules,
    "trajectory": trajectory_rules,
}


def write_checked(records: DataFrame, kind: str, path: str) -> dict[str, int]:
    """Write records of one type below ``path``: good ones in ``valid=true``, the others in ``valid=false`` with the rules they broke.

    Returns how many records there were, how many were set aside, and how many broke each rule (null breaks a rule unless it
    is optional), all observed in the pass that writes. A record may break several rules.
    """
    rules = RULES[kind]()
    broken = {code: ~F.coalesce(ok, F.lit(False)) for code, ok in rules.items()}
    checked = records.withColumn("violations", F.array_compact(F.array(*[F.when(b, F.lit(code)) for code, b in broken.items()])))
    seen = Observation(f"{kind} records")
    count = lambda b: F.coalesce(F.sum(b.cast("long")), F.lit(0).cast("long"))
    has = lambda code: F.array_contains("violations", code)
    observed = checked.observe(seen, F.count(F.lit(1)).alias("records"), count(F.size("violations") > 0).alias("quarantined"), *[count(has(code)).alias(code) for code in rules])
    spark = records.sparkSession
    writers = spark.conf.get(WRITERS_CONF)
    spark.conf.set(WRITERS_CONF, "2")  # both folders are open at once, so the records are not sorted
    try:
        observed.withColumn("valid", F.size("violations") == 0).write.partitionBy("valid").parquet(path)
    finally:
        spark.conf.set(WRITERS_CONF, writers)
    return seen.get
