"""Validation rules and small column expressions shared by all record types."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The label ontology (layers, classes, mask values), certainty, origin and edit vocabularies.
CORE_VALUES = {"traversable": 1, "restricted": 4, "not_traversable": 2, "unknown": 3}
LAYER_CLASSES = {
    "core": ("traversable", "restricted", "not_traversable", "unknown"),
    "obstacle": ("tree", "shrub", "log", "rock", "ditch", "water", "barrier"),
    "zone": (
        "tall_grass", "leaves", "mud", "loose_gravel", "mixed_surface", "narrow_passage", "partial_occlusion", "shadow", "blur",
    ),
    "roi": ("roi_interest", "roi_ignore", "roi_uncertain"),
}
CLASS_LABELS = {
    "traversable": ("Befahrbarer Boden", "#55d96f"),
    "restricted": ("Eingeschränkt befahrbar", "#e4c264"),
    "not_traversable": ("Nicht befahrbar", "#e05b52"),
    "unknown": ("Nicht bewertbar / verdeckt", "#737c78"),
    "tree": ("Baum", "#2f7d4f"),
    "shrub": ("Busch / dichtes Gebüsch", "#4f9c5f"),
    "log": ("Großer Ast / Baumstamm", "#8a6a3d"),
    "rock": ("Stein", "#8f9499"),
    "ditch": ("Graben", "#5b4a7a"),
    "water": ("Wasser / Pfütze", "#3f7fbf"),
    "barrier": ("Zaun / Pfosten / harte Barriere", "#c94f8a"),
    "tall_grass": ("Hohes Gras", "#9bbf5a"),
    "leaves": ("Laub", "#bf8f4a"),
    "mud": ("Matsch", "#7a5c3d"),
    "loose_gravel": ("Loser Schotter", "#a8a49a"),
    "mixed_surface": ("Gemischter Untergrund", "#b0975f"),
    "narrow_passage": ("Engstelle", "#d98f3f"),
    "partial_occlusion": ("Teilverdeckung", "#6f7a86"),
    "shadow": ("Schatten", "#4a5158"),
    "blur": ("Unscharfer Bereich", "#6a6f74"),
    "roi_interest": ("Interessiert", "#67e6f1"),
    "roi_ignore": ("Nicht interessiert / ignorieren", "#3a4149"),
    "roi_uncertain": ("ROI unsicher", "#c9a94f"),
}
MASK_VALUES = (0, 1, 2, 3, 4)
CERTAINTY = ("certain", "uncertain", "partially_occluded")
ORIGINS = ("manual", "model_proposal", "manual_corrected", "human_confirmed")
EDITS = ("new", "carried_unchanged", "carried_adjusted", "corrected")
STATUSES = ("draft", "confirmed", "skipped")
PATH_POSITIVE = ("traversable",)
MIN_INTERVAL_MS = 200
# Wording of the band notes.
BAND_SIDES, BAND_NOTE = {"top": "Oberer", "bottom": "Unterer"}, ("Bildrand, ", " % ignoriert")

ALL_CLASSES = tuple(name for names in LAYER_CLASSES.values() for name in names)


def ontology(spark) -> DataFrame:
    """The class dimension (23 rows)."""
    rows = [
        (layer, name, CLASS_LABELS[name][0], CLASS_LABELS[name][1], CORE_VALUES.get(name))
        for layer, names in LAYER_CLASSES.items()
        for name in names
    ]
    return spark.createDataFrame(rows, "layer string, class_id string, label string, color string, mask_value int")


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split by rules (true = good): valid rows, and the rest with the codes they broke. Null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]))
    checked = df.withColumn("violations", broken)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def in_range(value: Column, low: float, high: float) -> Column:
    return value.between(low, high)


def length_between(value: Column, low: int, high: int) -> Column:
    return F.length(value).between(low, high)


def one_of(value: Column, allowed: Sequence[str]) -> Column:
    return value.isin(*allowed)


def optional(value: Column, ok: Column) -> Column:
    return value.isNull() | ok


def valid_rle(rle: Column, width: Column, height: Column, values: Sequence[int] = MASK_VALUES) -> Column:
    """Even length, known values, positive lengths, total equals the pixel count."""
    is_value = lambda i: i % 2 == 0
    lengths = F.filter(rle, lambda v, i: ~is_value(i))
    return (
        (F.size(rle) >= 2)
        & (F.size(rle) % 2 == 0)
        & F.forall(F.filter(rle, lambda v, i: is_value(i)), lambda v: v.isin(*values))
        & F.forall(lengths, lambda v: v > 0)
        & (F.aggregate(lengths, F.lit(0).cast("long"), lambda a, v: a + v) == width.cast("long") * height)
    )


def _rounded(point: Column) -> Column:
    return F.struct(F.bround(point["x"], 8).alias("x"), F.bround(point["y"], 8).alias("y"))


def _distinct_points(points: Column) -> Column:
    return F.size(F.array_distinct(F.transform(points, _rounded)))


def two_distinct(points: Column, rounded: Callable[[Column], Column]) -> Column:
    """Two points differ once ``rounded``: one that differs from the first tells, so no point is compared with all others."""
    first = F.get(points, F.lit(0))
    return F.exists(points, lambda p: ~p.eqNullSafe(first) & ~rounded(p).eqNullSafe(rounded(first)))


def _normalised(points: Column) -> Column:
    return F.forall(points, lambda p: p["x"].between(0, 1) & p["y"].between(0, 1))


def valid_polygon(polygon: Column, classes: Sequence[str] = ALL_CLASSES) -> Column:
    """Known class, 3-500 normalised points, at least three of them distinct."""
    points = polygon["points"]
    return polygon["class_id"].isin(*classes) & F.size(points).between(3, 500) & _normalised(points) & (_distinct_points(points) >= 3)


def valid_trajectory(points: Column) -> Column:
    """2-400 normalised points, at least two distinct."""
    return F.size(points).between(2, 400) & _normalised(points) & two_distinct(points, _rounded)


def layer_consistency(polygons: Column, roi: Column) -> Column:
    """ROI classes live in ``roi`` and nowhere else."""
    is_roi = lambda p: p["class_id"].isin(*LAYER_CLASSES["roi"])
    return F.forall(roi, is_roi) & ~F.exists(polygons, is_roi)


def bands_leave_room(top: Column, bottom: Column) -> Column:
    inside = lambda c: c.isNull() | ((c > 0) & (c < 1))
    return inside(top) & inside(bottom) & (F.coalesce(top, F.lit(0.0)) + F.coalesce(bottom, F.lit(0.0)) < 1)


def valid_interval(start: Column, end: Column, min_length: int = MIN_INTERVAL_MS) -> Column:
    return (start >= 0) & (end > start) & (end - start >= min_length)


def valid_pause(start: Column, end: Column) -> Column:
    return (start >= 0) & (end >= start)


def has_path_polygon(polygons: Column, positive: Sequence[str] = PATH_POSITIVE) -> Column:
    """Any polygon of a path class; a polygon without a class is from the time there was only one."""
    return F.exists(polygons, lambda p: F.coalesce(p["class_id"], F.lit("traversable")).isin(*positive))


def confirmed_path_frames(annotations: DataFrame, positive: Sequence[str] = PATH_POSITIVE) -> DataFrame:
    """Frames usable as path examples; the status test reaches the scan."""
    return annotations.where((F.col("status") == "confirmed") & has_path_polygon(F.col("polygons"), positive))


def status_rules(status: Column, has_label: Column) -> Column:
    """Confirmed needs a label, skipped must have none."""
    return ~((status == "confirmed") & ~has_label) & ~((status == "skipped") & has_label)


def frame_timestamp(frame_index: Column, fps: Column) -> Column:
    return F.rint(frame_index / fps * 1000).cast("long")


def frame_hash(video_hash: Column, frame_index: Column, fps: Column) -> Column:
    """Identity of a frame: sha-256 over ``videohash:frame:timestamp``."""
    stamp = frame_timestamp(frame_index, fps).cast("string")
    return F.sha2(F.concat_ws(":", video_hash, frame_index.cast("string"), stamp), 256)


def provenance_check(annotations: DataFrame, videos: DataFrame, by: Sequence[str] = ("mission_id", "video_id")) -> tuple[DataFrame, DataFrame]:
    """Does a label belong to the frame it claims? Time within one frame, same hash, frame and mask size in range."""
    joined = annotations.join(
        videos.select(*by, "sha256", "fps", "total_frames", F.col("width").alias("_w"), F.col("height").alias("_h")), list(by), "left"
    )
    expected = frame_timestamp(F.col("frame_index"), F.col("fps"))
    tolerance = F.greatest(F.lit(2), F.rint(1000 / F.col("fps")))
    rules = {
        "frame": (F.col("frame_index") >= 0) & (F.col("frame_index") < F.col("total_frames")),
        "timestamp": F.abs(F.col("timestamp_ms") - expected) <= tolerance,
        "hash": optional(
            F.col("source_frame_hash"),
            F.col("source_frame_hash") == frame_hash(F.col("sha256"), F.col("frame_index"), F.col("fps")),
        ),
    }
    if "mask_width" in annotations.columns:
        rules["mask_size"] = optional(
            F.col("mask_width"), (F.col("mask_width") == F.col("_w")) & (F.col("mask_height") == F.col("_h"))
        )
    valid, bad = validate(joined, rules)
    drop = ["sha256", "fps", "total_frames", "_w", "_h"]
    return valid.drop(*drop), bad.drop(*drop)


def integrity_check(files: DataFrame, videos: DataFrame, by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Stored against computed content hash."""
    actual = files.select(*by, F.sha2(F.col("content"), 256).alias("actual"))
    return videos.select(*by, F.col("sha256").alias("expected")).join(actual, list(by), "left").select(
        *by, F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("valid"), "expected", "actual"
    )


def apply_patch(base: DataFrame, patch: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Partial update: only columns named in the patch's ``set_fields`` change, also when set to null."""
    renamed = patch.select(*key, F.col("set_fields").alias("_set"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(renamed, list(key), "left")
    return joined.select(
        *[
            F.when(F.array_contains("_set", c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in base.columns
        ]
    )


def normalise_text(value: Column) -> Column:
    """Trimmed, blanks collapsed, empty becomes null."""
    return F.nullif(F.regexp_replace(F.trim(F.regexp_replace(value, r"\s+", " ")), r"\s+", " "), F.lit(""))


def search_history(annotations: DataFrame, videos: DataFrame, needle: str, status: str = "all", by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Case-insensitive search over video name, annotator and the 1-based frame number."""
    found = annotations.join(videos.select(*by, "original_name"), list(by), "left")
    if status != "all":
        found = found.where(F.col("status") == status)
    text = needle.strip().lower()
    if text:
        found = found.where(
            F.lower(F.coalesce("original_name", F.lit(""))).contains(text)
            | F.lower(F.col("annotator")).contains(text)
            | (F.col("frame_index") + 1).cast("string").contains(text)
        )
    return found


def bin_by(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """First label whose lower edge the value reaches; the last label is the rest."""
    result = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        result = F.when(value >= edge, label).otherwise(result)
    return result


def roi_band(kind: str, fraction: Column) -> Column:
    """Polygon of the ignored band at the top or bottom image edge."""
    top, bottom = (F.lit(0.0), fraction) if kind == "top" else (1.0 - fraction, F.lit(1.0))
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), y.alias("y"))
    percent = F.rint(fraction * 100).cast("int").cast("string")
    note = F.concat(F.lit(f"{BAND_SIDES[kind]} {BAND_NOTE[0]}"), percent, F.lit(BAND_NOTE[1]))
    return F.struct(
        F.lit(f"roi-{kind}").alias("id"),
        F.lit("roi_ignore").alias("class_id"),
        F.array(point(0, top), point(1, top), point(1, bottom), point(0, bottom)).alias("points"),
        F.lit("certain").alias("certainty"),
        F.lit("manual").alias("origin"),
        F.lit(False).alias("hard_negative"),
        note.alias("note"),
    )


def quality_flags(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    cut = (x1 <= 0.006) | (y1 <= 0.006) | (x2 >= 0.994) | (y2 >= 0.994)
    return F.array_compact(F.array(F.when(cut, F.lit("border_truncated"))))


def uncertain_frames(predictions: DataFrame) -> DataFrame:
    return predictions.where("uncertain")


def clock(ms: Column) -> Column:
    """m:ss, rounded to the second (half up)."""
    seconds = F.floor(ms / 1000 + 0.5)
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def slug(label: Column) -> Column:
    """Key of a self-made reason; labels that differ in spelling only may share it, see :func:`reason_keys`."""
    safe = F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]", "_")
    return F.concat(F.lit("custom_"), F.substring(F.regexp_replace(safe, r"^_+|_+$", ""), 1, 48))


def reason_keys(labels: DataFrame, label: str = "label", given: DataFrame | None = None) -> DataFrame:
    """``label, key`` of every distinct label; labels with one slug are told apart by a number, in label order.

    The number follows a sign that no slug holds, so no key of one slug is another slug. Keys in ``given(label, key)`` stay as
    they are, and further labels of their slugs are numbered after them.
    """
    named = labels.select(label).where(F.col(label).isNotNull()).distinct().withColumn("_slug", slug(F.col(label)))
    if given is None:
        fresh, used = named.withColumn("_used", F.lit(0)), None
    else:
        used = given.select(label, "key").where(F.col(label).isNotNull())
        ending = F.coalesce(F.regexp_extract("key", NUMBERED, 1).try_cast("int"), F.lit(1))
        highest = used.groupBy(F.regexp_replace("key", NUMBERED, "").alias("_slug")).agg(F.max(ending).alias("_used"))
        fresh = named.join(used, label, "left_anti").join(highest, "_slug", "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
    number = F.row_number().over(Window.partitionBy("_slug").orderBy(label)) + F.col("_used")
    keyed = fresh.withColumn("_n", number).select(label, F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", "_n")).alias("key"))
    return keyed if used is None else used.join(named.select(label), label, "left_semi").unionByName(keyed)


NUMBERED = "-([0-9]+)$"
