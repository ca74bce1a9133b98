"""Queries on detections, tracks and the survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import survey as S
from fieldspark.operators import tracking as K
from fieldspark.plans import bindings as B
from fieldspark.plans.bindings import RASTER, even, sql
from fieldspark.plans.catalog import query

IOU = """greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(1e-9, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
    - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"""


@query(
    "j15_candidate_matches",
    sql(
        f"""SELECT video_id, frame_index, class_id, detection_id, track, CAST(age AS INTEGER) AS age, round_even(0.65 * i + 0.35 * greatest(0, 1 - d / 0.22) - 0.025 * greatest(0, age - 1), 6) AS score FROM (
          SELECT a.video_id, a.frame_index, a.class_id, a.detection_id, b.detection_id AS track, a.frame_index - b.frame_index AS age, {IOU} AS i,
            sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) AS d
          FROM dets a JOIN dets b ON a.video_id = b.video_id AND a.class_id = b.class_id AND a.frame_index - b.frame_index BETWEEN 1 AND 2)
        WHERE (i >= 0.015 OR d <= 0.16) AND 0.65 * i + 0.35 * greatest(0, 1 - d / 0.22) - 0.025 * greatest(0, age - 1) >= 0.2""",
        "dets",
    ),
)
def j15(spark, sf):
    d = B.detections(spark, sf)
    return K.candidate_matches(d, d).withColumn("score", F.bround("score", 6))


KEPT_IOU = IOU.replace("a.", "d.").replace("b.", "k.")


@query(
    "d1_suppress_duplicates",
    sql(
        """SELECT video_id, frame_index, unnest(kept).id AS detection_id FROM walk JOIN (SELECT video_id, frame_index, max(r) AS r FROM ranked GROUP BY ALL) USING (video_id, frame_index, r)""",
        "dets",
        ranked="""SELECT video_id, frame_index // 8 AS frame_index, detection_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY video_id, frame_index // 8 ORDER BY confidence DESC, detection_id) AS r FROM dets""",
        walk=f"""SELECT DISTINCT video_id, frame_index, 0::BIGINT AS r, []::STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept FROM ranked
        UNION ALL SELECT w.video_id, w.frame_index, d.r, CASE WHEN len(list_filter(w.kept, lambda k: abs((d.x1 + d.x2) / 2 - (k.x1 + k.x2) / 2) < 0.2 AND {KEPT_IOU} > 0.04)) > 0 THEN w.kept
          ELSE list_append(w.kept, {{'id': d.detection_id, 'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2}}) END
        FROM walk w JOIN ranked d ON d.video_id = w.video_id AND d.frame_index = w.frame_index AND d.r = w.r + 1""",
    ),
)
def d1(spark, sf):
    # Whole seconds of a video are crowded frames here, so that duplicates occur.
    d = B.detections(spark, sf).withColumn("frame_index", F.expr("frame_index div 8"))
    return K.suppress_duplicates(d, gap=0.2, key=RASTER).select(*RASTER, "detection_id")


def tracked(spark, sf):
    d = B.detections(spark, sf)
    still = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.01, 0.0, 1.0, 0.0)])
    motions = d.select(*RASTER).distinct().withColumn("m", still)
    return K.track_detections(d, motions)


@query("d2_track_detections")
def d2(spark, sf):
    return tracked(spark, sf).select(*RASTER, "detection_id", "class_id", "track_id", "tracking_status")


TRACKED = """SELECT *, video_id || '-' || class_id || '-' || (detection_id % 5) AS track_id FROM dets"""
SUMMARY = """SELECT video_id, track_id, class_id, min(timestamp_ms) AS first_timestamp_ms, max(timestamp_ms) AS last_timestamp_ms, count(*) AS observation_count, round_even(max(confidence), 3) AS max_confidence,
    max({'c': confidence, 't': timestamp_ms, 'd': detection_id}).d AS representative_detection_id,
    CASE WHEN class_id IN ('tree', 'shrub') THEN CASE WHEN count(*) >= 3 THEN 'confirmed' ELSE 'tentative' END WHEN class_id = 'vegetation_cluster' THEN 'cluster' ELSE 'uncertain' END AS instance_status,
    class_id IN ('tree', 'shrub') AND count(*) >= 3 AS countable FROM td GROUP BY video_id, track_id, class_id"""


def grouped(spark, sf):
    return B.detections(spark, sf).withColumn("track_id", F.concat_ws("-", F.col("video_id").cast("string"), "class_id", (F.col("detection_id") % 5).cast("string")))


@query("a13_track_summary", sql("SELECT * FROM ts", "dets", td=TRACKED, ts=SUMMARY))
def a13(spark, sf):
    return K.track_summary(grouped(spark, sf))


@query("d3_finalise_tracks", sql("SELECT d.detection_id, d.track_id, t.instance_status, t.countable FROM td d JOIN ts t USING (video_id, track_id)", "dets", td=TRACKED, ts=SUMMARY))
def d3(spark, sf):
    t = grouped(spark, sf)
    return K.finalise_tracks(t, K.track_summary(t)).select("detection_id", "track_id", "instance_status", "countable")


QFRAMES = """SELECT video_id, frame_index, event_id % 4 AS detections, event_id % 50 AS motion_inliers, (event_id % 70) / 7.0::DOUBLE AS stability_px, ['available', 'uncertain', 'unavailable'][event_id % 3 + 1] AS corridor_status,
    ['likely_traversable', 'limited', 'not_traversable', 'unknown'][event_id % 4 + 1] AS overall_class, event_id % 20 AS source_hash, event_id % 6 AS mask_hash FROM frames"""
QVIDEO = """SELECT f.*, coalesce(t.tracks, 0) AS tracks, coalesce(t.confirmed_trees, 0) AS confirmed_trees, coalesce(t.confirmed_shrubs, 0) AS confirmed_shrubs, coalesce(t.average_track_length, 0) AS average_track_length, coalesce(t.short_track_fraction, 0) AS short_track_fraction FROM (
      SELECT video_id, count(*) AS analyzed_frames, CAST(sum(detections) AS BIGINT) AS raw_detections, round_even(count(*) FILTER (detections = 0) / count(*), 3) AS empty_frame_fraction,
        round_even(count(*) FILTER (corridor_status = 'available') / count(*), 4) AS corridor_available_fraction, round_even(count(*) FILTER (corridor_status = 'uncertain') / count(*), 4) AS corridor_uncertain_fraction,
        count(*) FILTER (overall_class = 'likely_traversable') AS frames_likely_traversable, count(*) FILTER (overall_class = 'limited') AS frames_limited, count(*) FILTER (overall_class = 'not_traversable') AS frames_not_traversable,
        count(*) FILTER (overall_class = 'unknown') AS frames_unknown, count(DISTINCT source_hash) AS unique_source_hash, count(DISTINCT mask_hash) AS unique_mask_hash, round_even(quantile_cont(motion_inliers, 0.5), 1) AS median_motion_inliers,
        round_even(quantile_cont(stability_px, 0.5), 2) AS median_stability_px, round_even(count(*) FILTER (b <> mask_hash) / greatest(1, count(*) - 1), 4) AS mask_transition_fraction
      FROM (SELECT *, lag(mask_hash) OVER (PARTITION BY video_id ORDER BY frame_index) AS b FROM qf) GROUP BY video_id) f
    LEFT JOIN (SELECT video_id, count(*) AS tracks, count(*) FILTER (countable AND class_id = 'tree') AS confirmed_trees, count(*) FILTER (countable AND class_id = 'shrub') AS confirmed_shrubs,
        round_even(avg(observation_count), 2) AS average_track_length, round_even(count(*) FILTER (observation_count <= 2) / count(*), 3) AS short_track_fraction FROM ts GROUP BY video_id) t USING (video_id)"""


def quality(spark, sf):
    e = F.col("event_id")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (e % len(names) + 1).cast("int"))
    frames = B.frames(spark, sf).select(
        *RASTER, (e % 4).alias("detections"), (e % 50).alias("motion_inliers"), ((e % 70) / F.lit(7.0)).alias("stability_px"), pick(("available", "uncertain", "unavailable")).alias("corridor_status"),
        pick(K.TERRAIN_CLASSES).alias("overall_class"), (e % 20).alias("source_hash"), (e % 6).alias("mask_hash"),
    )
    return K.video_quality_metrics(frames, K.track_summary(grouped(spark, sf)), huge=B.huge_videos(spark, sf))


@query("a12_video_quality_metrics", sql("SELECT * FROM qv", "dets", td=TRACKED, ts=SUMMARY, qf=QFRAMES, qv=QVIDEO))
def a12(spark, sf):
    return quality(spark, sf)


@query(
    "a12_mission_quality_metrics",
    sql(
        """SELECT video_id % 9 AS mission_id, CAST(sum(analyzed_frames) AS BIGINT) AS analyzed_frames, CAST(sum(raw_detections) AS BIGINT) AS raw_detections, CAST(sum(tracks) AS BIGINT) AS tracks, CAST(sum(confirmed_trees) AS BIGINT) AS confirmed_trees,
        CAST(sum(confirmed_shrubs) AS BIGINT) AS confirmed_shrubs, round_even(avg(empty_frame_fraction), 3) AS empty_frame_fraction, round_even(avg(mask_transition_fraction), 4) AS mask_transition_fraction,
        round_even(sum(corridor_available_fraction * analyzed_frames) / sum(analyzed_frames), 4) AS corridor_available_fraction, round_even(sum(corridor_uncertain_fraction * analyzed_frames) / sum(analyzed_frames), 4) AS corridor_uncertain_fraction,
        round_even(sum(unique_mask_hash) / sum(analyzed_frames), 4) AS mask_unique_fraction, bool_or(unique_mask_hash > 1) AS masks_vary, CAST(sum(frames_likely_traversable) AS BIGINT) AS frames_likely_traversable,
        CAST(sum(frames_limited) AS BIGINT) AS frames_limited, CAST(sum(frames_not_traversable) AS BIGINT) AS frames_not_traversable, CAST(sum(frames_unknown) AS BIGINT) AS frames_unknown FROM qv GROUP BY video_id % 9""",
        "dets",
        td=TRACKED,
        ts=SUMMARY,
        qf=QFRAMES,
        qv=QVIDEO,
    ),
)
def a12_mission(spark, sf):
    return K.mission_quality_metrics(quality(spark, sf).withColumn("mission_id", F.col("video_id") % 9))


KEY_VIDEOS = """SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 'A_TO_B' ELSE 'B_TO_A' END AS direction, 20.0::DOUBLE + n * 1.5::DOUBLE AS dur FROM (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id)"""
SPANS = """SELECT video_id, frame_index * 1.5::DOUBLE AS s0, frame_index * 1.5::DOUBLE + 1.5::DOUBLE AS s1, value AS sharpness, event_id FROM frames"""
KEYFRAMES = """SELECT *, CAST(video_id AS VARCHAR) || '-' || CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR) END AS keyframe_id FROM (
    SELECT c.video_id, c.seq, c.target, arg_max({'second': c.second, 'event_id': s.event_id, 'sharpness': s.sharpness}, {'a': s.sharpness, 'b': -c.k}) AS b FROM (
      SELECT video_id, seq, target, k, greatest(0, target + o) AS second FROM tg, (VALUES (0, -0.6::DOUBLE), (1, 0.0), (2, 0.6)) t(k, o)) c
    JOIN spans s ON s.video_id = c.video_id AND c.second >= s.s0 AND c.second < s.s1 GROUP BY ALL)"""


def _targets(interval: float, endpoints: bool) -> str:
    start = "0.0::DOUBLE" if endpoints else f"{interval / 2}::DOUBLE"
    base = f"SELECT video_id, dur, n, unnest(range(n)) AS seq, {start} + unnest(range(n)) * {interval}::DOUBLE AS target FROM (SELECT *, greatest(0, CAST(ceil((dur - {start}) / {interval}) AS BIGINT)) AS n FROM vids)"
    if not endpoints:
        return f"SELECT video_id, seq, target FROM ({base})"
    close = f"SELECT video_id, n, greatest(0, dur - 1) FROM (SELECT *, greatest(0, CAST(ceil((dur - {start}) / {interval}) AS BIGINT)) AS n FROM vids) WHERE n = 0 OR dur - 1 - ({start} + (n - 1) * {interval}::DOUBLE) > {interval / 2}"
    return f"SELECT video_id, seq, target FROM ({base}) UNION ALL {close}"


SURVEY = {"vids": KEY_VIDEOS, "spans": SPANS, "tg": _targets(6.0, True), "kf": KEYFRAMES}


def survey_videos(spark, sf):
    counted = B.frames(spark, sf).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("video_id", F.when(F.col("video_id") % 2 == 0, "A_TO_B").otherwise("B_TO_A").alias("direction"), (20.0 + F.col("n") * 1.5).alias("duration_seconds"))


def survey_frames(spark, sf):
    s = F.col("frame_index") * F.lit(1.5)
    return B.frames(spark, sf).select("video_id", s.alias("second_start"), (s + 1.5).alias("second_end"), F.col("value").alias("sharpness"), "event_id")


def survey_keyframes(spark, sf, interval=6.0, samples=3, endpoints=True):
    return S.keyframes(survey_videos(spark, sf), survey_frames(spark, sf), interval, samples, endpoints)


@query("t5_sharpest_candidate", sql("SELECT video_id, seq, round_even(b.second, 3) AS second, b.event_id AS event_id FROM kf", "frames", **SURVEY))
def t5(spark, sf):
    found = S.sharpest_candidate(S.targets(survey_videos(spark, sf), 6.0, True), survey_frames(spark, sf))
    return found.select("video_id", F.col("seq").cast("long").alias("seq"), F.bround("second", 3).alias("second"), "event_id")


@query(
    "m14_keyframes",
    sql(
        """SELECT keyframe_id, round_even(b.second, 3) AS timestamp_seconds, round_even(CASE WHEN direction = 'A_TO_B' THEN least(1, greatest(0, b.second / dur)) ELSE 1 - least(1, greatest(0, b.second / dur)) END, 5) AS route_fraction
        FROM kf JOIN vids USING (video_id)""",
        "frames",
        **SURVEY,
    ),
)
def m14(spark, sf):
    return survey_keyframes(spark, sf).select("keyframe_id", "timestamp_seconds", "route_fraction")


RATED = """SELECT video_id, video_id // 4 AS mission_id, keyframe_id, seq, b.event_id % 12 AS segment_index, (b.event_id % 97) / 200.0::DOUBLE AS vr, (b.event_id % 89) / 300.0::DOUBLE AS gr, (b.event_id % 83) / 250.0::DOUBLE AS er, b.sharpness AS sharpness FROM kf"""
OBS = f"""SELECT mission_id, video_id, keyframe_id, seq, segment_index, 'vegetation' AS category, {even('least(0.88, 0.42::DOUBLE + vr)', 2)} AS confidence FROM rated WHERE vr >= 0.12
    UNION ALL SELECT mission_id, video_id, keyframe_id, seq, segment_index, 'tree_species', 0.1 FROM rated WHERE vr >= 0.12
    UNION ALL SELECT mission_id, video_id, keyframe_id, seq, segment_index, 'ground', {even('least(0.76, 0.35::DOUBLE + gr)', 2)} FROM rated WHERE gr >= 0.12
    UNION ALL SELECT mission_id, video_id, keyframe_id, seq, segment_index, 'obstacle_candidate', 0.3 FROM rated WHERE er >= 0.16"""
MERGED = """SELECT mission_id, category, segment_index, max(confidence) AS confidence, count(*) AS raw_detection_count, min({'c': -confidence, 'v': video_id, 's': seq, 'k': keyframe_id}).k AS representative,
    (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT unnest(list(o.video_id)) AS v)) AS source_videos, array_to_string(list(keyframe_id ORDER BY video_id, seq)[1:4], ',') AS evidence FROM obs o GROUP BY mission_id, category, segment_index"""
SURVEY2 = SURVEY | {"rated": RATED, "obs": OBS, "merged": MERGED.replace("(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT unnest(list(o.video_id)) AS v))", "array_to_string(list_sort(list_distinct(list(o.video_id))), ',')")}


def rated(spark, sf):
    e = F.col("event_id")
    part = lambda n, d: (e % n) / F.lit(float(d))
    return survey_keyframes(spark, sf).select(
        "video_id", F.expr("video_id div 4").alias("mission_id"), "keyframe_id", F.col("seq").cast("long").alias("seq"), (e % 12).alias("segment_index"),
        part(97, 200).alias("vegetation_ratio"), part(89, 300).alias("ground_ratio_lower"), part(83, 250).alias("edge_ratio_lower"), "sharpness",
    )


@query("u2_observations", sql("SELECT keyframe_id, category, confidence FROM obs", "frames", **SURVEY2))
def u2(spark, sf):
    return S.observations(rated(spark, sf)).select("keyframe_id", "category", "confidence")


def merged(spark, sf):
    return S.merge_observations(S.observations(rated(spark, sf)), ["mission_id", "category", "segment_index"], ["video_id", "seq"])


@query("a9_merge_observations", sql("SELECT * FROM merged", "frames", **SURVEY2))
def a9(spark, sf):
    return merged(spark, sf)


@query(
    "a10_survey_wrapup",
    sql(
        """SELECT mission_id, t.topic, CASE t.topic WHEN 'vegetation' THEN CASE WHEN bool_or(category = 'vegetation') THEN 'observed' ELSE 'not_observed' END WHEN 'ground' THEN CASE WHEN bool_or(category = 'ground') THEN 'candidate_observed' ELSE 'not_observed' END
          WHEN 'obstacles' THEN CASE WHEN bool_or(category = 'obstacle_candidate') THEN 'manual_review_candidates' ELSE 'none_detected' END WHEN 'tree_species' THEN 'unclear' WHEN 'drivability' THEN 'manual_review_required' ELSE 'not_reliably_assessed' END AS status
        FROM merged, (VALUES ('vegetation'), ('tree_species'), ('shrub_groups'), ('regeneration'), ('ground'), ('obstacles'), ('drivability')) t(topic) GROUP BY mission_id, t.topic""",
        "frames",
        **SURVEY2,
    ),
)
def a10(spark, sf):
    return S.survey_wrapup(merged(spark, sf))


@query(
    "a11_survey_metrics",
    sql(
        """SELECT v.mission_id, v.n AS traversals, round_even(v.sec, 2) AS media_duration_seconds, round_even((100 + v.mission_id) * v.n, 2) AS walked_total_m, round_even((100 + v.mission_id) * v.n / v.sec, 3) AS mean_speed_mps, k.n AS keyframes, coalesce(o.n, 0) AS raw_observations,
          coalesce(m.n, 0) AS merged_observations, 0 AS unassigned_keyframes, 0 AS without_evidence, round_even(k.sh, 2) AS mean_sharpness
        FROM (SELECT video_id // 4 AS mission_id, count(*) AS n, sum(dur) AS sec FROM vids GROUP BY ALL) v JOIN (SELECT mission_id, count(*) AS n, avg(sharpness) AS sh FROM rated GROUP BY ALL) k USING (mission_id)
        LEFT JOIN (SELECT mission_id, count(*) AS n FROM obs GROUP BY ALL) o USING (mission_id) LEFT JOIN (SELECT mission_id, count(*) AS n FROM merged GROUP BY ALL) m USING (mission_id)""",
        "frames",
        **SURVEY2,
    ),
)
def a11(spark, sf):
    mission = F.expr("video_id div 4")
    videos = survey_videos(spark, sf).withColumn("mission_id", mission)
    routes = videos.select("mission_id").distinct().withColumn("length_m", 100.0 + F.col("mission_id"))
    return S.survey_metrics(videos, rated(spark, sf), S.observations(rated(spark, sf)), merged(spark, sf), routes)


CONFIGS = " UNION ALL ".join(
    f"SELECT mission_id, {i} AS position, '{name}' AS name, count(*) AS keyframes, {even('sum(CAST(round(value * 100) AS BIGINT)) / 100 / count(*)', 2)} AS mean_sharpness FROM (SELECT video_id // 4 AS mission_id, value FROM frames WHERE frame_index % {4 - i} = 0) GROUP BY ALL"
    for i, (name, *_rest) in enumerate(S.CONFIGURATIONS)
)


@query(
    "m15_compare_configs",
    sql(
        """SELECT mission_id, CAST(position AS INTEGER) AS position, name, keyframes, mean_sharpness, CASE WHEN position = 0 OR (position = 1 AND ok1) OR (position = 2 AND ok2) THEN 'accepted' ELSE 'rejected' END AS decision FROM (
          SELECT c.*, b.keyframes > a.keyframes OR b.mean_sharpness > a.mean_sharpness AS ok1,
            CASE WHEN b.keyframes > a.keyframes OR b.mean_sharpness > a.mean_sharpness THEN d.keyframes > b.keyframes OR d.mean_sharpness > b.mean_sharpness ELSE d.keyframes > a.keyframes OR d.mean_sharpness > a.mean_sharpness END AS ok2
          FROM cf c JOIN cf a ON a.mission_id = c.mission_id AND a.position = 0 JOIN cf b ON b.mission_id = c.mission_id AND b.position = 1 JOIN cf d ON d.mission_id = c.mission_id AND d.position = 2)""",
        "frames",
        cf=CONFIGS,
    ),
)
def m15(spark, sf):
    f = B.frames(spark, sf).withColumn("mission_id", F.expr("video_id div 4"))
    runs = None
    for i, (name, *_rest) in enumerate(S.CONFIGURATIONS):
        part = f.where(F.col("frame_index") % (4 - i) == 0).groupBy("mission_id").agg(F.count(F.lit(1)).alias("keyframes"), F.bround(F.sum(F.rint(F.col("value") * 100).cast("long")) / 100 / F.count(F.lit(1)), 2).alias("mean_sharpness"))
        part = part.select("mission_id", F.lit(i).alias("position"), F.lit(name).alias("name"), "keyframes", "mean_sharpness")
        runs = part if runs is None else runs.unionByName(part)
    return S.compare_configs(runs, ["mission_id"])
