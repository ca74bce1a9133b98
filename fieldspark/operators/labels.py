"""Label side: frames, splits, statistics, tracks of labels, revisions, hard negatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import rules
from fieldspark.operators.ordered import (
    frame_chunks,
    next_value,
    ordered_scan,
    previous,
    row_index,
    whole_sum,
)

# Default uncertainty reasons.
DEFAULT_REASONS = (
    ("hohes_gras", "Hohes Gras / Bewuchs"),
    ("laub_teilverdeckt", "Laub oder teilweise verdeckt"),
    ("unebenheit_stufe", "Unebenheit oder Stufe"),
    ("engstelle", "Mögliche Engstelle"),
    ("sicht_unsicherheit", "Sicht oder Einschätzung unsicher"),
    ("sonstiges", "Sonstiges — siehe Notiz"),
)


def interval_ranges(intervals: DataFrame, videos: DataFrame, stride: int = 10, by: Sequence[str] = ("mission_id", "video_id")) -> DataFrame:
    """Each interval, clipped to the video, as its first and last frame number and the step between its frames."""
    joined = intervals.join(videos.select(*by, "fps", "total_frames"), list(by))
    frame = lambda ms: F.rint(F.col(ms) / 1000 * F.col("fps")).cast("long")
    bounded = joined.withColumn("_a", F.greatest(F.lit(0), frame("start_ms"))).withColumn(
        "_b", F.least(F.col("total_frames") - 1, frame("end_ms"))
    )
    return bounded.where(F.col("_a") <= F.col("_b")).select(
        *by, F.col("id").alias("interval_id"), "fps", "_a", "_b", F.lit(max(1, stride)).cast("long").alias("_step")
    )


def _frames_of(ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per frame of each range."""
    exploded = ranges.select(*columns, "fps", F.explode(F.sequence("_a", "_b", "_step")).alias("frame_index"))
    return exploded.withColumn("timestamp_ms", rules.frame_timestamp(F.col("frame_index"), F.col("fps")))


def intervals_to_frames(intervals: DataFrame, videos: DataFrame, stride: int = 10, by: Sequence[str] = ("mission_id", "video_id")) -> DataFrame:
    """Every ``stride``-th frame of each interval, clipped to the video, as fully negative frames."""
    names = [*by, "interval_id"]
    return _frames_of(interval_ranges(intervals, videos, stride, by), names).select(*names, "frame_index", "timestamp_ms")


def negative_ranges(intervals: DataFrame, videos: DataFrame, stride_interval: int = 10, stride_video: int = 15, by: Sequence[str] = ("mission_id", "video_id")) -> DataFrame:
    """The frames of :func:`hard_negatives` as ranges, one row per interval or video."""
    spans = interval_ranges(intervals, videos, stride_interval, by).withColumn("interval_id", F.col("interval_id").cast("string")).withColumn("origin", F.lit("interval"))
    whole = videos.where(F.col("fully_not_traversable") & (F.col("total_frames") > 0)).select(
        *by, F.lit(None).cast("string").alias("interval_id"), "fps", F.lit(0).cast("long").alias("_a"), (F.col("total_frames") - 1).cast("long").alias("_b"),
        F.lit(max(1, stride_video)).cast("long").alias("_step"), F.lit("video").alias("origin"),
    )
    return spans.unionByName(whole)


def hard_negatives(intervals: DataFrame, videos: DataFrame, stride_interval: int = 10, stride_video: int = 15, by: Sequence[str] = ("mission_id", "video_id")) -> DataFrame:
    """Interval frames plus strided frames of videos without any path."""
    ranges = negative_ranges(intervals, videos, stride_interval, stride_video, by)
    return _frames_of(ranges, [*by, "interval_id", "origin"]).select(*by, "interval_id", "frame_index", "timestamp_ms", "origin")


def hard_negative_totals(intervals: DataFrame, videos: DataFrame, stride_interval: int = 10, stride_video: int = 15, by: Sequence[str] = ("mission_id", "video_id")) -> DataFrame:
    """Number of :func:`hard_negatives` and sum of their frame numbers per video and origin, from the ranges: a video's frames are never listed."""
    ranges = negative_ranges(intervals, videos, stride_interval, stride_video, by)
    counted = ranges.withColumn("_n", F.expr("(_b - _a) div _step + 1"))
    total = F.expr("_n * _a + _step * (_n * (_n - 1) div 2)")
    return counted.groupBy(*by, "origin").agg(F.sum("_n").alias("frames"), F.sum(total).alias("frame_sum"))


def flag_conflicts(flags: DataFrame, annotations: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Flags on frames with confirmed polygons are rejected."""
    labelled = annotations.where((F.col("status") == "confirmed") & F.col("has_polygons")).select(*key).distinct()
    return flags.join(labelled, list(key), "left_anti"), flags.join(labelled, list(key), "left_semi")


def describe_classes(df: DataFrame, ontology: DataFrame, column: str = "class_id") -> DataFrame:
    """Add layer, label, colour and mask value; Spark broadcasts the ontology while it is as small as its 23 rows."""
    return df.join(ontology.withColumnRenamed("class_id", column), column, "left")


def inherit_video_label(frames: DataFrame, videos: DataFrame, by: Sequence[str], label: str = "terrain_category") -> DataFrame:
    """Frames carry the current category of their video, looked up at read time."""
    return frames.join(videos.select(*by, label), list(by))


def select_missions(counts: DataFrame, selection: Sequence[str] | None = None) -> DataFrame:
    """The named pair, or the two missions with most confirmed frames (earlier creation wins ties)."""
    if selection:
        wanted = [str(s) for s in selection]
        return counts.where(F.col("mission_id").cast("string").isin(*wanted) | F.col("name").isin(*wanted))
    return counts.orderBy(F.col("confirmed").desc(), "mission_id").limit(2)


def frame_split(df: DataFrame, by: Sequence[str] = ("video_id",), order: str = "frame_index", fold: int = 5, huge: bool | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Every fifth labelled frame of a video is validation; short videos give their last frame, single frames none.

    If that leaves no validation at all in a ``scope`` (the mission, or the whole table), its last training frame moves over.
    """
    by = [*scope, *(b for b in by if b not in scope)]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_scan(df, by, [order], frame_chunks(order), huge, _i=row_index(), _n=whole_sum(F.lit(1)))
    part = (
        F.when(F.col("_n") < fold, (F.col("_n") > 1) & (F.col("_i") == F.col("_n") - 1))
        .otherwise(F.col("_i") % fold == fold - 1)
    )
    tagged = ranked.withColumn("_val", part)
    # Without any validation frame every video has one frame: the last of them validates.
    figures = F.max("_n").alias("_most"), F.count(F.lit(1)).alias("_videos"), F.max(F.struct(*by)).alias("_last")
    fallback = sizes.groupBy(*scope).agg(*figures)
    moved = (F.col("_most") == 1) & (F.col("_videos") > 1) & (F.struct(*by) == F.col("_last"))
    return (
        (tagged.join(fallback, list(scope)) if scope else tagged.crossJoin(F.broadcast(fallback)))
        .withColumn("part", F.when(F.col("_val") | moved, "validation").otherwise("train"))
        .select(*df.columns, "part")
    )


def video_split(videos: DataFrame, label: str, order: Sequence[str] = ("mission_id", "video_id")) -> DataFrame:
    """Per class: three or more videos give validation and test from the end, two give validation, one only trains.

    Only the last two ranks matter, so the window is a top-2 that Spark prunes before
    the shuffle. The test part is dropped when it has fewer than two classes.
    """
    last = Window.partitionBy(label).orderBy(*[F.col(c).desc() for c in order])
    tail = videos.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= 2).select(*order, "_r")
    sizes = videos.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    test_classes = sizes.agg(F.sum((F.col("_n") >= 3).cast("long")).alias("_tests"))
    part = (
        F.when((F.col("_n") >= 3) & (F.col("_r") == 1), F.when(F.col("_tests") >= 2, "test").otherwise("unused"))
        .when((F.col("_n") >= 3) & (F.col("_r") == 2), "validation")
        .when((F.col("_n") == 2) & (F.col("_r") == 1), "validation")
        .otherwise("train")
    )
    return (
        videos.join(sizes, label)
        .join(tail, list(order), "left")
        .crossJoin(F.broadcast(test_classes))
        .withColumn("part", part)
        .select(*videos.columns, "part")
    )


def split_summary(split_frames: DataFrame, video: str = "video_id", label: str = "terrain_category") -> DataFrame:
    """Videos, frames and classes per part; videos are pre-aggregated before anything is collected."""
    per_video = split_frames.groupBy("part", label, video).agg(F.count(F.lit(1)).alias("_n"))
    per_class = per_video.groupBy("part", label).agg(F.count(F.lit(1)).alias("_v"), F.sum("_n").alias("_f"))
    return per_class.groupBy("part").agg(
        F.sum("_v").alias("videos"),
        F.sum("_f").alias("frames"),
        F.count(F.lit(1)).alias("classes"),
        F.array_join(F.sort_array(F.collect_list(F.col(label).cast("string"))), ",").alias("class_names"),
    )


def dataset_summary(annotations: DataFrame, refinements: DataFrame, flags: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Per mission and in total (null mission): confirmed frames, videos, refinements, flags."""
    per_video = annotations.groupBy(mission, "video_id").agg(F.count(F.lit(1)).alias("_n"))
    frames = per_video.groupBy(mission).agg(F.sum("_n").alias("confirmed_frames"), F.count(F.lit(1)).alias("videos"))
    fixes = refinements.groupBy(mission).agg(F.count(F.lit(1)).alias("refinements"))
    marks = flags.groupBy(mission).agg(F.count(F.lit(1)).alias("critical_flags"))
    names = ("confirmed_frames", "videos", "refinements", "critical_flags")
    merged = frames.join(fixes, mission, "full_outer").join(marks, mission, "full_outer")
    merged = merged.select(mission, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])
    return merged.rollup(mission).agg(
        *[F.sum(c).alias(c) for c in names], F.sum((F.col("confirmed_frames") > 0).cast("long")).alias("missions")
    )


def terrain_dataset_summary(videos: DataFrame, label: str = "terrain_category") -> DataFrame:
    """Videos and distinct missions per category; videos without one are counted under null."""
    per_mission = videos.groupBy(label, "mission_id").agg(F.count(F.lit(1)).alias("_v"))
    return per_mission.groupBy(label).agg(F.sum("_v").alias("videos"), F.count(F.lit(1)).alias("missions"))


def polygon_statistics(polygons: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts by class, layer, certainty and origin plus points and hard negatives, as rows (facet, value, n)."""
    facets = F.array(
        *[F.struct(F.lit(name).alias("facet"), F.col(name).alias("value"), F.lit(1).cast("long").alias("n")) for name in ("class_id", "layer", "certainty", "origin")],
        F.struct(F.lit("total").alias("facet"), F.lit("polygons").alias("value"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("total").alias("facet"), F.lit("points").alias("value"), F.col("point_count").cast("long").alias("n")),
        F.struct(F.lit("total").alias("facet"), F.lit("hard_negatives").alias("value"), F.col("hard_negative").cast("long").alias("n")),
    )
    return polygons.select(*by, F.inline(facets)).groupBy(*by, "facet", "value").agg(F.sum("n").alias("n"))


def statistics_maps(statistics: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same counts as one map per facet, the shape stored with a label."""
    entry = F.struct(F.col("value"), F.col("n"))
    maps = [
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("facet") == name, entry)))).alias(name)
        for name in ("class_id", "layer", "certainty", "origin", "total")
    ]
    return statistics.groupBy(*by).agg(*maps)


def status_counts(df: DataFrame, column: str, domain: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count per known value, zero where none occurs, plus the total."""
    known = F.array(*[F.lit(v) for v in domain])
    counted = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    sums = counted.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"),
        *[F.coalesce(F.sum(F.when(F.col(column) == v, F.col("_n"))), F.lit(0)).alias(f"_{i}") for i, v in enumerate(domain)],
    )
    pairs = F.array(
        *[F.struct(F.element_at(known, i + 1).alias("value"), F.col(f"_{i}").alias("n")) for i in range(len(domain))],
        F.struct(F.lit("total").alias("value"), F.col("_total").alias("n")),
    )
    return sums.select(*by, F.inline(pairs))


def label_tracks(polygons: DataFrame, labelled_frames: DataFrame, video: str = "video_id", huge: bool | None = None) -> DataFrame:
    """Sightings of labelled objects with class change and the frame in which the object is gone.

    ``polygons(video, tracking_id, frame_index, class_id, …)`` holds one row per sighting,
    ``labelled_frames(video, frame_index)`` every frame with any label.
    """
    seen = ordered_scan(
        polygons.where(F.col("tracking_id").isNotNull()), [video, "tracking_id"], ["frame_index"], frame_chunks(), huge, _before=previous(F.col("class_id"))
    )
    seen = seen.withColumn("class_change", F.when(F.col("_before") != F.col("class_id"), F.concat_ws(">", "_before", "class_id"))).drop("_before")
    ends = seen.groupBy(video, "tracking_id").agg(F.max("frame_index").alias("last_frame"))
    # The first labelled frame after the last sighting: tracks and frames share one ordered pass.
    marks = labelled_frames.select(video, "frame_index").distinct().select(
        video, F.col("frame_index").alias("_at"), F.lit(1).alias("_kind"), F.lit("").alias("tracking_id")
    )
    asked = ends.select(video, F.col("last_frame").alias("_at"), F.lit(2).alias("_kind"), F.col("tracking_id").cast("string").alias("tracking_id"))
    both = marks.unionByName(asked)
    ahead = ordered_scan(
        both, [video], ["_at", "_kind", "tracking_id"], frame_chunks("_at"), huge, ended_at=next_value(F.when(F.col("_kind") == 1, F.col("_at")))
    )
    gone = ahead.where(F.col("_kind") == 2).select(video, F.col("tracking_id").alias("_id"), "ended_at")
    return seen.join(gone, (seen[video] == gone[video]) & (seen["tracking_id"].cast("string") == gone["_id"]), "left").drop(gone[video]).drop("_id")


def label_track_summary(polygons: DataFrame, labelled_frames: DataFrame, video: str = "video_id") -> tuple[DataFrame, DataFrame]:
    """Per track and per video summaries of :func:`label_tracks`."""
    seen = label_tracks(polygons, labelled_frames, video)
    edit = lambda name: F.sum((F.col("edit") == name).cast("long"))
    tracks = seen.groupBy(video, "tracking_id").agg(
        F.min("frame_index").alias("first_frame"),
        F.max("frame_index").alias("last_frame"),
        F.max_by("class_id", "frame_index").alias("class_id"),
        F.count(F.lit(1)).alias("frame_count"),
        F.sum(F.col("class_change").isNotNull().cast("long")).alias("class_changes"),
        edit("carried_adjusted").alias("adjusted_count"),
        edit("corrected").alias("corrected_count"),
        F.max("ended_at").alias("ended_at_frame"),
    )
    totals = tracks.groupBy(video).agg(
        F.count(F.lit(1)).alias("tracks"),
        F.count("ended_at_frame").alias("ended_tracks"),
        F.sum("adjusted_count").alias("adjusted_polygons"),
        F.sum("corrected_count").alias("corrected_polygons"),
        F.sum("class_changes").alias("class_changes"),
    )
    frames = labelled_frames.select(video, "frame_index").distinct().groupBy(video).agg(F.count(F.lit(1)).alias("labelled_frames"))
    loose = polygons.groupBy(video).agg(F.sum(F.col("tracking_id").isNull().cast("long")).alias("untracked_polygons"))
    summary = frames.join(totals, video, "left").join(loose, video, "left")
    names = ("tracks", "labelled_frames", "untracked_polygons", "ended_tracks", "adjusted_polygons", "corrected_polygons", "class_changes")
    return tracks, summary.select(video, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def revisions(events: DataFrame, key: Sequence[str], order: str = "at") -> DataFrame:
    """Latest record per key from edit events.

    Deletes are tombstones (``deleted`` true): they restart the count and hide the key
    while they are last. Everything is a map-side combined aggregate: the last
    tombstone per key, then counts and extremes of the events after it.
    """
    kills = events.groupBy(*key).agg(F.max(F.when(F.col("deleted"), F.col(order))).alias("_killed"))
    alive = events.join(kills, list(key)).where(F.col("_killed").isNull() | (F.col(order) > F.col("_killed")))
    payload = [c for c in events.columns if c not in (*key, order, "deleted")]
    return (
        alive.groupBy(*key)
        .agg(
            F.max_by(F.struct(*payload), order).alias("_p"),
            F.count(F.lit(1)).alias("revision"),
            F.min(order).alias("created_at"),
            F.max(order).alias("updated_at"),
        )
        .select(*key, *[F.col(f"_p.{c}").alias(c) for c in payload], "revision", "created_at", "updated_at")
    )


def reason_ranking(annotations: DataFrame, defaults: DataFrame, reason: str = "uncertainty_reason") -> DataFrame:
    """Uncertainty reasons by use, defaults included with zero."""
    used = annotations.where(F.col(reason).isNotNull() & (F.col(reason) != "")).groupBy(F.col(reason).alias("value")).agg(F.count(F.lit(1)).alias("uses"))
    merged = used.join(defaults, "value", "full_outer").select(
        "value", F.coalesce("label", "value").alias("label"), F.coalesce("uses", F.lit(0)).cast("long").alias("uses")
    )
    return merged.orderBy(F.col("uses").desc(), F.lower("label"))


def labelling_kpis(summary: DataFrame, has_runs: bool = True) -> DataFrame:
    """Labelled frames, open errors, progress in percent, refinements from the total row of the dataset summary."""
    total = summary.where(F.col("mission_id").isNull())
    done, flags = F.col("confirmed_frames"), F.col("critical_flags")
    everything = F.greatest(done, (done + flags) if has_runs else F.lit(0))
    percent = F.when(everything > 0, F.floor(done / everything * 100 + 0.5)).otherwise(0)
    return total.select(done.alias("labelled"), flags.alias("open_errors"), percent.cast("long").alias("progress_percent"), "refinements")


def selection_progress(selection: DataFrame, annotations: DataFrame, key: Sequence[str]) -> DataFrame:
    """Share of the selected frames that are confirmed or skipped."""
    resolved = annotations.where(F.col("status").isin("confirmed", "skipped")).select(*key).distinct().withColumn("_done", F.lit(1))
    joined = selection.join(resolved, list(key), "left")
    return joined.agg(F.count(F.lit(1)).alias("selected"), F.count("_done").alias("resolved")).select(
        "selected", "resolved", F.bround(F.when(F.col("selected") > 0, F.col("resolved") / F.col("selected")).otherwise(0.0), 5).alias("progress")
    )


def review_range(flags: DataFrame, by: Sequence[str] = ("video_id",)) -> DataFrame:
    return flags.groupBy(*by).agg(F.min("frame_index").alias("first"), F.max("frame_index").alias("last"))


def flags_by_frame(flags: DataFrame, key: Sequence[str], order: str = "created_at") -> DataFrame:
    """One row per flagged frame: worst severity, distinct notes in order of appearance.

    Notes are first reduced to distinct ones per frame, so repeated notes never pile up.
    """
    notes = (
        flags.where(F.coalesce("note", F.lit("")) != "")
        .groupBy(*key, "note")
        .agg(F.min(order).alias("_first"))
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("_first", "note"))).alias("_notes"))
        .select(*key, F.array_join(F.transform("_notes", lambda n: n["note"]), " ").alias("note"))
    )
    worst = flags.groupBy(*key).agg(F.max("severity").alias("severity"), F.count(F.lit(1)).alias("flags"))
    return worst.join(notes, list(key), "left").withColumn("note", F.coalesce("note", F.lit("")))


def select_frames(videos: DataFrame, mode: str, stride: int = 15, count: int = 10, seed: int = 42, by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Frames to label: every ``stride``-th, ``count`` evenly spaced, or an equal share per video in hash order."""
    alive = videos.where(F.col("total_frames") > 0)
    if mode == "stride":
        return alive.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_frames") - 1, F.lit(max(1, stride)).cast("long"))).alias("frame_index"))
    if mode == "count":
        return _evenly(alive.withColumn("_want", F.lit(count).cast("long")), by)
    total = alive.agg(F.count(F.lit(1)).alias("_videos"))
    share = F.greatest(F.lit(1), F.floor(F.lit(count) / F.col("_videos") + 0.5))
    pool = _evenly(alive.crossJoin(F.broadcast(total)).withColumn("_want", share), by)
    return pool.withColumn("shuffle_key", F.xxhash64(F.lit(seed), *by, "frame_index"))


def _evenly(videos: DataFrame, by: Sequence[str]) -> DataFrame:
    wanted = F.greatest(F.lit(1).cast("long"), F.least("total_frames", "_want"))
    at = F.floor(F.col("_i") * (F.col("total_frames") - 1) / F.greatest(F.lit(1), F.col("_n") - 1) + 0.5)
    return (
        videos.withColumn("_n", wanted)
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .select(*by, F.when(F.col("_n") == 1, 0).otherwise(at).cast("long").alias("frame_index"))
        .distinct()
    )
