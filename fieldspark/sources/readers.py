"""Readers of the stored records. One JSON document per file, or JSON lines with ``lines=True``.

Schemas are explicit and defaults are filled on read. Where a reader returns two
tables, the second holds what could not be parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark import schemas

# Suggested ignore bands.
SUGGESTED_TOP, SUGGESTED_BOTTOM = 0.2, 0.1
CORRUPT = "_corrupt_record"


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    full = f"{schema}, {CORRUPT} string"
    return spark.read.schema(full).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def _split(raw: DataFrame, required: str) -> tuple[DataFrame, DataFrame]:
    """Parsed documents and the rest. Testing the required field as well keeps both tests in every pruned read."""
    unreadable = F.col(CORRUPT).isNotNull() | F.col(required).isNull()
    bad = raw.where(unreadable).select(F.input_file_name().alias("path"), CORRUPT)
    return raw.where(~unreadable).drop(CORRUPT), bad


def points(column: Column) -> Column:
    """[[x, y], …] to an array of structs."""
    return F.transform(column, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _polygons(column: str) -> Column:
    """Polygons with the defaults of the time before the field existed."""
    default = lambda p, name, value: F.coalesce(p[name], F.lit(value)).alias(name)
    return F.coalesce(
        F.transform(
            column,
            lambda p: F.struct(
                default(p, "id", "path-1"), default(p, "class_id", "traversable"), points(p["points"]).alias("points"), default(p, "certainty", "certain"),
                default(p, "origin", "manual"), default(p, "hard_negative", False), default(p, "note", ""), default(p, "uncertainty_reason", ""),
                p["tracking_id"].alias("tracking_id"), p["carried_from_frame"].alias("carried_from_frame"), default(p, "edit", "new"),
            ),
        ),
        F.array(),
    )


def read_missions(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Missions, newest first, and unreadable documents."""
    good, bad = _split(_json(spark, path if lines else f"{path}/*/mission.json", schemas.MISSION, lines), "id")
    filled = good.withColumn("notes", F.coalesce("notes", F.lit(""))).withColumn("pauses", F.coalesce("pauses", F.array()))
    return filled.orderBy(F.col("created_at").desc(), "id"), bad


def mission_videos(missions: DataFrame) -> DataFrame:
    """One row per video of a mission."""
    return missions.select(F.col("id").alias("mission_id"), F.col("name").alias("mission_name"), F.inline("videos")).withColumnRenamed("id", "video_id").withColumn(
        "fully_not_traversable", F.coalesce("fully_not_traversable", F.lit(False))
    )


def read_annotations(spark: SparkSession, path: str, video_id: str | None = None, geometry: bool = False, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Frame labels by video and frame. Geometry columns are only parsed when asked for."""
    source = path if lines else f"{path}/{video_id or '*'}/*.json"
    good, bad = _split(_json(spark, source, schemas.ANNOTATION, lines), "video_id")
    if video_id is not None:
        good = good.where(F.col("video_id") == video_id)
    required = good.where(F.col("video_id").isNotNull() & F.col("frame_index").isNotNull() & F.col("status").isNotNull())
    columns = ["schema_version", "mission_id", "video_id", "frame_index", "timestamp_ms", "source_frame_hash", "status", "annotator", "notes", "revision", "updated_at", "frame_size"]
    extra = [F.coalesce("label_mode", F.lit("linear")).alias("label_mode")]
    if geometry:
        extra += [_polygons("polygons").alias("polygons"), _polygons("roi").alias("roi"), F.col("mask")]
    return required.select(*columns, *extra), bad


def read_refinements(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Corrections, one row each, in their stored order (``pos``)."""
    good, _ = _split(_json(spark, path if lines else f"{path}/*/*.json", schemas.REFINEMENT, lines), "video_id")
    return good.select("mission_id", "video_id", "frame_index", F.posexplode("items").alias("pos", "item")).select(
        "mission_id", "video_id", "frame_index", "pos", "item.id", "item.kind", "item.action", "item.correct_value", "item.pixel_count",
        F.col("item.region_mask.width").alias("width"), F.col("item.region_mask.height").alias("height"), F.col("item.region_mask.rle").alias("rle"),
    )


def read_critical_flags(spark: SparkSession, path: str, video_id: str | None = None, lines: bool = False) -> DataFrame:
    good, _ = _split(_json(spark, path if lines else f"{path}/{video_id or '*'}/*.json", schemas.CRITICAL_FLAG, lines), "video_id")
    if video_id is not None:
        good = good.where(F.col("video_id") == video_id)
    return good.withColumn("note", F.coalesce("note", F.lit("")))


def read_off_path_intervals(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Interval lists: every element of a top-level array is a row."""
    good, _ = _split(_json(spark, path if lines else f"{path}/*.json", schemas.OFF_PATH_INTERVAL, lines), "video_id")
    return good


def read_trajectories(spark: SparkSession, path: str, video_id: str | None = None, lines: bool = False) -> DataFrame:
    """Planned lines; a file is a list or, in the old form, one object without id."""
    good, _ = _split(_json(spark, path if lines else f"{path}/{video_id or '*'}/*.json", schemas.TRAJECTORY, lines), "video_id")
    if video_id is not None:
        good = good.where(F.col("video_id") == video_id)
    return good.withColumn("id", F.coalesce("id", F.lit("legacy"))).withColumn("points", points(F.col("points")))


def read_roi_profiles(spark: SparkSession, path: str, videos: DataFrame, lines: bool = False) -> DataFrame:
    """One row per video: the saved profile, or the suggestion where none exists."""
    good, _ = _split(_json(spark, path if lines else f"{path}/*.json", schemas.ROI_PROFILE, lines), "video_id")
    profiles = good.select("video_id", "top_ignore_fraction", "bottom_ignore_fraction", F.col("note"), F.col("revision"), F.lit(True).alias("_saved"))
    saved = F.coalesce("_saved", F.lit(False))
    return videos.select("video_id").join(profiles, "video_id", "left").select(
        "video_id", "top_ignore_fraction", "bottom_ignore_fraction", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("revision", F.lit(0)).alias("revision"),
        F.when(~saved, F.lit(SUGGESTED_TOP)).alias("suggested_top"), F.when(~saved, F.lit(SUGGESTED_BOTTOM)).alias("suggested_bottom"),
    )


def read_model_runs(spark: SparkSession, path: str, pointers: DataFrame, lines: bool = False) -> DataFrame:
    """Run documents, newest first, the active one flagged."""
    from fieldspark.sources.writers import active_run

    good, _ = _split(_json(spark, path if lines else f"{path}/*/result.json", schemas.MODEL_RUN, lines), "run_id")
    current = active_run(pointers).select("run_id", F.lit(True).alias("active"))
    return good.join(F.broadcast(current), "run_id", "left").withColumn("active", F.coalesce("active", F.lit(False))).orderBy(F.col("created_at").desc(), "run_id")


def list_runs_with_metrics(model_runs: DataFrame) -> DataFrame:
    """Run history with the figures shown in a list."""
    return model_runs.select(
        "run_id", "created_at", "active", "accuracy", F.col("validation_metrics.iou").alias("iou"), F.col("validation_metrics.symmetric_score").alias("symmetric_score"), "runtime_seconds"
    )


def read_video_inventory(spark: SparkSession, path: str, pattern: str = r"([^/]+)/videos/([^/.]+)\.") -> DataFrame:
    """Video files with size. Only path and length are read, never the content.

    ``pattern`` captures mission and video id from the path; of several files of one
    video the first by path counts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    parsed = files.select(F.regexp_extract("path", pattern, 1).alias("mission_id"), F.regexp_extract("path", pattern, 2).alias("video_id"), "path", "length")
    return parsed.where(F.col("video_id") != "").groupBy("mission_id", "video_id").agg(F.min("path").alias("path"), F.min_by("length", "path").alias("size_bytes"))


def read_frame_results(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored per-frame results as rows, and the frame manifest (time, hash, mask size)."""
    good, _ = _split(_json(spark, path, schemas.FRAME_RESULT, lines), "video_id")
    rows = good.select("schema_version", "run_id", "mission_id", "video_id", F.inline("frames"))
    return rows, rows.select("mission_id", "video_id", "frame_index", "timestamp_ms", "source_frame_hash", F.col("mask.width").alias("mask_width"), F.col("mask.height").alias("mask_height"))


def _table(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    found = spark.read.parquet(path)
    missing = [c for c in columns if c not in found.columns]
    if missing:
        raise ValueError(f"table at {path} lacks {missing}")
    return found


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, ("video_id", "frame_index", "y", "x", "b", "g", "r"))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, ("video_id", "frame_index", "detection_id", "class_id", "confidence"))


def read_motions(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, ("video_id", "frame_index", "m"))


def read_pair_motions(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, ("video_id", "step", "yaw_delta", "flow", "matches", "inliers"))
