"""Queries on stored records and streams: the tables make a round trip through files in the shared folder."""

from __future__ import annotations

import math
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators import kernel as N
from fieldspark.operators import runs as R
from fieldspark.plans import analysis as A
from fieldspark.plans import bindings as B
from fieldspark.plans.bindings import HEIGHT, RASTER, WIDTH, sql, table
from fieldspark.plans.catalog import query
from fieldspark.plans.q_masks import METRICS, clean_sql
from fieldspark.plans.q_pixels import GRADE
from fieldspark.session import run_dir
from fieldspark.sources import readers as S
from fieldspark.sources import snapshots as V
from fieldspark.sources import writers as W
from fieldspark.streaming import jobs as X


def stored(df: DataFrame, name: str) -> str:
    """Write one JSON document per line (column ``value``) and return the folder."""
    path = run_dir(df.sparkSession, name)
    df.select("value").write.text(path)
    return path


def text(column: str):
    return F.col(column).cast("string")


@query(
    "s1_read_missions",
    sql("SELECT CAST(video_id % 9 AS VARCHAR) AS mission_id, count(*) AS videos, CAST(sum(total_frames) AS BIGINT) AS frames FROM videos WHERE video_id % 10 <> 0 GROUP BY ALL", "videos"),
)
def s1(spark, sf):
    v = B.videos(spark, sf)
    video = F.struct(text("video_id").alias("id"), "direction", "terrain_category", "fully_not_traversable", "original_name", F.col("total_frames").alias("size_bytes"), "sha256")
    doc = F.to_json(F.struct(text("mission_id").alias("id"), F.lit("mission").alias("name"), F.array(video).alias("videos")))
    broken = F.when(F.col("video_id") % 10 == 0, F.substring(doc, 1, 40)).otherwise(doc)
    missions, _ = S.read_missions(spark, stored(v.select(broken.alias("value")), "missions"), lines=True)
    return S.mission_videos(missions).groupBy("mission_id").agg(F.count(F.lit(1)).alias("videos"), F.sum("size_bytes").alias("frames"))


@query("s2_read_annotations", sql("SELECT mission_id, CAST(video_id AS VARCHAR) AS video_id, frame_index, status, CASE WHEN frame_index % 3 = 0 THEN 'shuffle' ELSE 'linear' END AS label_mode, n_poly AS polygons FROM ann", "ann"))
def s2(spark, sf):
    a = B.annotations(spark, sf)
    polygon = F.struct(F.col("class_id"), F.array(F.array(F.lit(0.1), F.lit(0.2)), F.array(F.lit(0.8), F.lit(0.2)), F.array(F.lit(0.5), F.lit(0.9))).alias("points"))
    mode = F.when(F.col("frame_index") % 3 == 0, "shuffle")
    doc = F.to_json(F.struct("mission_id", text("video_id").alias("video_id"), "frame_index", "status", "annotator", mode.alias("label_mode"), F.array_repeat(polygon, F.col("n_poly")).alias("polygons")))
    good, _ = S.read_annotations(spark, stored(a.select(doc.alias("value")), "annotations"), geometry=True, lines=True)
    return good.select("mission_id", "video_id", "frame_index", "status", "label_mode", F.size("polygons").alias("polygons"))


@query(
    "s3_read_refinements",
    sql("SELECT CAST(video_id AS VARCHAR) AS video_id, frame_index, CAST(k AS INTEGER) AS pos, CAST(k % 2 AS INTEGER) AS correct_value, CAST(sum(CASE WHEN y >= k THEN v ELSE 0 END) AS BIGINT) AS pixels FROM mp, range(3) t(k) GROUP BY ALL", "mp"),
)
def s3(spark, sf):
    rle = [R.to_rle(B.mask_p(spark, sf).where(F.col("y") >= k), B.raster_frames(spark, sf), RASTER).withColumn("k", F.lit(k)) for k in range(3)]
    item = F.struct(F.lit("invented_path").alias("kind"), (F.col("k") % 2).alias("correct_value"), F.struct(F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.col("rle")).alias("region_mask"))
    frames = rle[0].unionByName(rle[1]).unionByName(rle[2]).groupBy(*RASTER).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", item.alias("i")))), lambda e: e["i"]).alias("items"))
    doc = F.to_json(F.struct(text("video_id").alias("video_id"), "frame_index", "items"))
    found = S.read_refinements(spark, stored(frames.select(doc.alias("value")), "refinements"), lines=True)
    runs = R.decode_rle(found, "rle", "width", ["video_id", "frame_index", "pos", "correct_value"])
    area = runs.groupBy("video_id", "frame_index", "pos", "correct_value").agg(F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("pixels"))
    keys = ["video_id", "frame_index", "pos", "correct_value"]
    return found.select(*keys).join(area, keys, "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)))


@query("s4_read_critical_flags", sql("SELECT CAST(video_id AS VARCHAR) AS video_id, frame_index, CAST(1 + event_id % 5 AS INTEGER) AS severity, CASE WHEN event_id % 2 = 0 THEN 'seen' ELSE '' END AS note FROM frames WHERE event_type = 'error'", "frames"))
def s4(spark, sf):
    e = F.col("event_id")
    flags = B.frames(spark, sf).where(F.col("event_type") == "error")
    doc = F.to_json(F.struct(text("video_id").alias("video_id"), "frame_index", "timestamp_ms", (1 + e % 5).alias("severity"), F.when(e % 2 == 0, "seen").alias("note")))
    return S.read_critical_flags(spark, stored(flags.select(doc.alias("value")), "flags"), lines=True).select("video_id", "frame_index", "severity", "note")


@query("s5_read_off_path_intervals", sql("SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(id AS VARCHAR) AS id, start_ms, end_ms FROM intervals", "intervals"))
def s5(spark, sf):
    spans = B.intervals(spark, sf)
    one = F.struct(text("id").alias("id"), text("video_id").alias("video_id"), "start_ms", "end_ms")
    lists = spans.groupBy("video_id", F.expr("id div 2000").alias("_part")).agg(F.to_json(F.collect_list(one)).alias("value"))
    return S.read_off_path_intervals(spark, stored(lists, "intervals"), lines=True).select("video_id", "id", "start_ms", "end_ms")


@query("s6_read_trajectories", sql("SELECT CAST(video_id AS VARCHAR) AS video_id, frame_index, CASE WHEN event_id % 4 = 0 THEN 'legacy' ELSE 't' || event_id END AS id, round_even(value / 500, 6) AS first_x, CAST(2 AS INTEGER) AS points FROM frames WHERE event_type = 'view'", "frames"))
def s6(spark, sf):
    f = B.frames(spark, sf).where(F.col("event_type") == "view")
    e = F.col("event_id")
    row = F.struct(
        F.when(e % 4 != 0, F.concat(F.lit("t"), text("event_id"))).alias("id"), text("video_id").alias("video_id"), "frame_index",
        F.array(F.array(F.col("value") / 500, F.lit(1.0)), F.array(F.lit(0.5), F.lit(0.5))).alias("points"),
    )
    doc = F.when(e % 4 == 0, F.to_json(row)).otherwise(F.to_json(F.array(row)))
    found = S.read_trajectories(spark, stored(f.select(doc.alias("value")), "trajectories"), lines=True)
    return found.select("video_id", "frame_index", "id", F.bround(F.col("points")[0]["x"], 6).alias("first_x"), F.size("points").alias("points"))


@query("s7_read_roi_profiles", sql("SELECT CAST(video_id AS VARCHAR) AS video_id, CASE WHEN video_id % 3 = 0 THEN 0.25 END AS top_ignore_fraction, CASE WHEN video_id % 3 <> 0 THEN 0.2 END AS suggested_top, CASE WHEN video_id % 3 <> 0 THEN 0.1 END AS suggested_bottom, CAST(CASE WHEN video_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS revision FROM videos", "videos"))
def s7(spark, sf):
    v = B.walks(spark, sf).select(text("video_id").alias("video_id"), (F.col("video_id") % 3).alias("_k"))
    doc = F.to_json(F.struct("video_id", F.lit(0.25).alias("top_ignore_fraction"), F.lit(2).alias("revision")))
    path = stored(v.where("_k = 0").select(doc.alias("value")), "profiles")
    return S.read_roi_profiles(spark, path, v, lines=True).select("video_id", "top_ignore_fraction", "suggested_top", "suggested_bottom", "revision")


RUNS = "SELECT 'run-' || user_id AS run_id, round_even(avg(value) / 500, 6) AS accuracy, user_id = (SELECT max(user_id) FROM events) AS active FROM events GROUP BY user_id"


def model_runs(spark, sf):
    """One run document per user of the event table; the last one is active."""
    e = table(spark, sf, "events").groupBy("user_id").agg((F.avg("value") / 500).alias("accuracy"), F.max("event_id").alias("_at"))
    doc = F.to_json(F.struct(F.concat(F.lit("run-"), text("user_id")).alias("run_id"), F.lit("global").alias("scope"), F.timestamp_seconds("_at").alias("created_at"), "accuracy"))
    path = stored(e.select(doc.alias("value")), "model-runs")
    pointers = run_dir(spark, "pointers")
    last = table(spark, sf, "events").agg(F.max("user_id")).first()[0]
    W.set_active_run(spark, pointers, "run-0")
    W.set_active_run(spark, pointers, f"run-{last}")
    return S.read_model_runs(spark, path, spark.read.parquet(pointers), lines=True)


@query("s8_read_model_runs", RUNS)
def s8(spark, sf):
    return model_runs(spark, sf).select("run_id", F.bround("accuracy", 6).alias("accuracy"), "active")


@query("m13_list_runs_with_metrics", RUNS)
def m13(spark, sf):
    return S.list_runs_with_metrics(model_runs(spark, sf)).select("run_id", F.bround("accuracy", 6).alias("accuracy"), "active")


@query("s9_read_video_inventory", sql("SELECT CAST(mission_id AS VARCHAR) AS mission_id, true AS has_bytes FROM videos GROUP BY mission_id", "videos"))
def s9(spark, sf):
    path = run_dir(spark, "media")
    B.videos(spark, sf).select("mission_id", "sha256").repartition("mission_id").write.partitionBy("mission_id").parquet(path)
    found = S.read_video_inventory(spark, path, r"mission_id=([^/]+)/(part-[0-9]+)")
    return found.groupBy("mission_id").agg(F.bool_and(F.col("size_bytes") > 0).alias("has_bytes"))


def frame_documents(spark, sf):
    one = F.struct("frame_index", "timestamp_ms", F.md5(text("event_id")).alias("source_frame_hash"), F.struct(F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")).alias("mask"))
    chunks = B.frames(spark, sf).groupBy("video_id", F.expr("frame_index div 100").alias("_c")).agg(F.collect_list(one).alias("frames"))
    doc = F.to_json(F.struct(F.lit("1.1").alias("schema_version"), F.lit("r1").alias("run_id"), text("video_id").alias("video_id"), "frames"))
    return stored(chunks.select(doc.alias("value")), "frame-results")


@query("s10_read_frame_results", sql("SELECT CAST(video_id AS VARCHAR) AS video_id, frame_index, timestamp_ms, md5(CAST(event_id AS VARCHAR)) AS source_frame_hash, CAST(64 AS INTEGER) AS mask_width FROM frames", "frames"))
def s10(spark, sf):
    _, manifest = S.read_frame_results(spark, frame_documents(spark, sf), lines=True)
    return manifest.select("video_id", "frame_index", "timestamp_ms", "source_frame_hash", "mask_width")


@query("s11_read_pixels", sql("SELECT video_id, frame_index, CAST(sum(b) AS BIGINT) AS b, CAST(sum(g) AS BIGINT) AS g, CAST(sum(r) AS BIGINT) AS r FROM rgb GROUP BY ALL", "rgb"))
def s11(spark, sf):
    path = run_dir(spark, "pixels")
    B.rgb(spark, sf).repartition(*RASTER).write.parquet(path)
    return S.read_pixels(spark, path).groupBy(*RASTER).agg(*[F.sum(c).cast("long").alias(c) for c in "bgr"])


@query("s11_read_motions", sql("SELECT video_id, frame_index, event_id % 5 / 100.0::DOUBLE AS dx FROM frames", "frames"))
def s11_motions(spark, sf):
    path, dx = run_dir(spark, "motions"), F.col("event_id") % 5 / F.lit(100.0)
    one, zero = F.lit(1.0), F.lit(0.0)
    B.frames(spark, sf).select("video_id", "frame_index", F.array(one, zero, dx, zero, one, zero).alias("m")).write.parquet(path)
    return S.read_motions(spark, path).select("video_id", "frame_index", F.col("m")[2].alias("dx"))


@query(
    "s11_read_pair_motions",
    sql("SELECT video_id, count(*) AS steps, CAST(sum(event_id % 40) AS BIGINT) AS matches, CAST(sum(event_id % 30) AS BIGINT) AS inliers, round_even(max(value / 10), 6) AS flow FROM frames WHERE frame_index > 0 GROUP BY video_id", "frames"),
)
def s11_pairs(spark, sf):
    path, e = run_dir(spark, "pair-motions"), F.col("event_id")
    pairs = B.frames(spark, sf).where("frame_index > 0").select(
        "video_id", F.col("frame_index").alias("step"), (e % 9 - 4).cast("double").alias("yaw_delta"), (F.col("value") / 10).alias("flow"), (e % 40).cast("int").alias("matches"), (e % 30).cast("int").alias("inliers")
    )
    pairs.write.parquet(path)
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return S.read_pair_motions(spark, path).groupBy("video_id").agg(F.count(F.lit(1)).alias("steps"), total("matches"), total("inliers"), F.bround(F.max("flow"), 6).alias("flow"))


@query("s11_read_detections", sql("SELECT video_id, class_id, count(*) AS n FROM dets GROUP BY ALL", "dets"))
def s11_dets(spark, sf):
    path = run_dir(spark, "detections")
    B.detections(spark, sf).write.parquet(path)
    return S.read_detections(spark, path).groupBy("video_id", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query("k1_write_run", sql("SELECT CASE WHEN event_id % 2 = 0 THEN 'run-a' ELSE 'run-b' END AS run_id, count(*) AS frames FROM frames GROUP BY ALL", "frames"))
def k1(spark, sf):
    path, f = run_dir(spark, "runs"), B.frames(spark, sf)
    W.write_run(f.where(F.col("event_id") % 2 == 0), path, "run-a")
    W.write_run(f.where(F.col("event_id") % 2 == 1), path, "run-b")
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("frames"))


@query("k2_active_run", "SELECT 'run-' || max(user_id) AS run_id FROM events")
def k2(spark, sf):
    path = run_dir(spark, "active")
    for name in table(spark, sf, "events").agg(F.array(F.min("user_id"), F.max("user_id"))).first()[0]:
        W.set_active_run(spark, path, f"run-{name}")
    return W.active_run(spark.read.parquet(path))


@query("k3_resume_write", sql("SELECT video_id, frame_index, round_even(value * 2, 6) AS score FROM frames", "frames"))
def k3(spark, sf):
    path, f = run_dir(spark, "resume"), B.frames(spark, sf).select(*RASTER, "value")
    score = lambda df: df.withColumn("score", F.bround(F.col("value") * 2, 6))
    W.resume_write(f.where(F.col("frame_index") < 20), score, path, "r1", "1.1", RASTER)
    W.resume_write(f, score, path, "r1", "1.1", RASTER)
    return V.read(spark, path).select(*RASTER, "score")


@query("k4_reuse_results", sql("SELECT video_id, frame_index, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'reuse' ELSE 'todo' END AS verdict FROM frames", "frames"))
def k4(spark, sf):
    e = F.col("event_id")
    results = B.frames(spark, sf).select(*RASTER, F.when(e % 3 == 0, "r1").otherwise("r0").alias("run_id"), F.when(e % 2 == 0, "1.1").otherwise("1.0").alias("schema_version"))
    reusable, todo = W.reuse_results(B.frames(spark, sf).select(*RASTER), results, "r1", "1.1", RASTER)
    return reusable.select(*RASTER, F.lit("reuse").alias("verdict")).unionByName(todo.select(*RASTER, F.lit("todo").alias("verdict")))


@query("k5_write_geojson_lines", sql("SELECT count(*) AS features FROM (SELECT DISTINCT video_id, frame_index // 64 FROM frames)", "frames"))
def k5_write(spark, sf):
    path = run_dir(spark, "geojson")
    points = B.frames(spark, sf).select("video_id", F.expr("frame_index div 64").alias("part"), F.col("frame_index").alias("idx"), F.col("value").alias("lng"), (F.col("value") / 2).alias("lat"))
    W.write_geojson_lines(points, path, ["video_id", "part"])
    parsed = spark.read.schema("type string, geometry struct<type:string,coordinates:array<array<double>>>").json(path)
    return parsed.where("type = 'Feature' AND geometry.type = 'LineString'").agg(F.count(F.lit(1)).alias("features"))


def one_file(rows: DataFrame) -> DataFrame:
    """``rows`` for one task to write; a shuffle, so that many tasks read and filter what they come from."""
    return rows.repartition(1)


def as_stream(df: DataFrame, name: str, order: str | None = None, batches: int = 1) -> DataFrame:
    """The table as a file stream; with ``order``, of as many micro-batches as ``batches``, each with the next equal part of the range of that column."""
    spark, path = df.sparkSession, run_dir(df.sparkSession, name)
    if order is None:
        df.write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)
    whole = run_dir(spark, f"{name}-whole")
    df.write.parquet(whole)
    table_ = spark.read.schema(df.schema).parquet(whole)
    low, high = table_.agg(F.min(order), F.max(order)).first()
    for k in range(batches):
        part = F.least(F.floor((F.col(order) - (low or 0)) * batches / ((high or 0) - (low or 0) + 1)), F.lit(batches - 1))
        one_file(table_.where(part == k)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query_) -> None:
    query_.awaitTermination()


def _pixel_model() -> N.Model:
    """A small model of the score image with parameters from a rule, so that SQL can hold them as numbers."""
    k = 4
    return N.Model(np.array([0.02]), np.array([0.15]), np.array([[0.9 + 0.3 * j for j in range(k)]]), np.arange(k) / 5 - 1.2, np.array([0.9, 0.5, -0.4, 0.3, -0.2]))


PIXEL_THRESHOLD = 0.25


def _pixel_score() -> str:
    m = _pixel_model()
    num = lambda v: f"{float(v)!r}::DOUBLE"
    terms = [f"{num(m.weights[j])} * {num(math.sqrt(0.5))} * cos((s - {num(m.mean[0])}) / {num(m.scale[0])} * {num(m.projection[0, j])} + {num(m.phase[j])})" for j in range(4)]
    return " + ".join(terms) + f" + {num(m.weights[4])}"


def pixel_lines(batch: DataFrame) -> DataFrame:
    return batch.select(*RASTER, F.inline("lines")).select(*RASTER, "y", F.posexplode("s").alias("x", "v")).select(*RASTER, "y", "x", F.array("v").alias("features"))


@query(
    "x1_stream_score",
    sql(
        f"""SELECT f.video_id, f.frame_index, round_even(f.area / 1024, 5) AS path_fraction, g.safe, g.good, g.poor, g.risky, g.problem, c.iou, c.symmetric_score FROM (SELECT video_id, frame_index, sum(v) AS area FROM cleaned GROUP BY ALL) f
        JOIN (SELECT video_id, frame_index, count(*) FILTER (v = 1) AS safe, count(*) FILTER (v = 2) AS good, count(*) FILTER (v = 3) AS poor, count(*) FILTER (v = 4) AS risky, count(*) FILTER (v = 5) AS problem FROM graded GROUP BY ALL) g USING (video_id, frame_index)
        JOIN (SELECT video_id, frame_index, {METRICS} FROM cc) c USING (video_id, frame_index)""",
        "mt",
        sc=f"SELECT video_id, frame_index, y, x, {_pixel_score()} AS s FROM pix",
        ms=f"SELECT g.video_id, g.frame_index, g.y, g.x, CASE WHEN p.s >= {PIXEL_THRESHOLD} THEN 1 ELSE 0 END AS v FROM grid g LEFT JOIN sc p USING (video_id, frame_index, y, x)",
        **clean_sql("ms"),
        marg=f"SELECT video_id, frame_index, y, x, (s - {PIXEL_THRESHOLD}) / {1 - PIXEL_THRESHOLD} AS m FROM sc",
        **GRADE,
        cc="""SELECT t.video_id, t.frame_index, CAST(sum(t.v * p.v) AS BIGINT) AS tp, CAST(sum((1 - t.v) * (1 - p.v)) AS BIGINT) AS tn, CAST(sum((1 - t.v) * p.v) AS BIGINT) AS fp, CAST(sum(t.v * (1 - p.v)) AS BIGINT) AS fn
        FROM mt t JOIN cleaned p USING (video_id, frame_index, y, x) GROUP BY ALL""",
    ),
)
def x1(spark, sf):
    """A model stored as a run scores a stream of frames in several micro-batches."""
    models, out, mark = run_dir(spark, "path-models"), run_dir(spark, "analysis"), run_dir(spark, "checkpoint")
    A.store_model(spark, _pixel_model(), PIXEL_THRESHOLD, models, "path-1")
    rows = B.lines(spark, sf).groupBy(*RASTER).agg(F.sort_array(F.collect_list(F.struct("y", "s"))).alias("lines"))
    stream, truth = as_stream(rows, "frames", "frame_index", 3), B.mask_t(spark, sf)
    finish(A.stream_analysis(stream, models, "path-1", pixel_lines, truth, B.raster_frames(spark, sf), WIDTH, HEIGHT, out, mark, RASTER, True))
    length = (F.col("x1") - F.col("x0")).cast("long")
    names = ("safe", "good", "poor", "risky", "problem")
    graded = spark.read.parquet(f"{out}/grades/batch=*").groupBy(*RASTER).agg(*[F.sum(F.when(F.col("value") == k, length).otherwise(0)).alias(n) for k, n in enumerate(names, 1)])
    frames = spark.read.parquet(f"{out}/frames/batch=*")
    return frames.join(graded, list(RASTER), "left").select(*RASTER, "path_fraction", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names], "iou", "symmetric_score")


def tracked_frames(spark, sf):
    d = B.detections(spark, sf)
    still = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.01, 0.0, 1.0, 0.0)])
    one = F.struct(text("detection_id").alias("detection_id"), "class_id", F.array("x1", "y1", "x2", "y2").alias("box"))
    return d.groupBy(*RASTER).agg(F.sort_array(F.collect_list(one)).alias("dets")).withColumns({"m": still, "event_time": F.timestamp_millis(F.col("frame_index") * 40)})


@query("x2_stream_tracks")
def x2(spark, sf):
    out, side = run_dir(spark, "tracks"), run_dir(spark, "late-tracks")
    stream = X.stream_tracks(as_stream(tracked_frames(spark, sf), "tracked", "frame_index", 3))
    finish(X.write_split(stream, F.col("tracking_status") == "late", out, side, run_dir(spark, "checkpoint"), True))
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


@query("x3_stream_corridor_state")
def x3(spark, sf):
    drive = R.clean_mask(B.mask_blob(spark, sf), WIDTH, HEIGHT, RASTER)
    still = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.5, 0.0, 1.0, 0.0)])
    found = drive.groupBy(*RASTER).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("runs"))
    none = F.array().cast("array<struct<y:int,x0:int,x1:int>>")
    every = B.raster_frames(spark, sf).select(*RASTER).join(found, list(RASTER), "left").withColumn("runs", F.coalesce(F.col("runs").cast("array<struct<y:int,x0:int,x1:int>>"), none))
    rows = every.withColumns(
        {"m": still, "inliers": F.lit(40), "visibility": F.lit(0.9), "ground_confidence": F.lit(0.8), "event_time": F.timestamp_millis(F.col("frame_index") * 40)}
    )
    out, side = run_dir(spark, "corridors"), run_dir(spark, "late-corridors")
    stream = X.stream_corridor_state(as_stream(rows, "drive", "frame_index", 3), WIDTH, HEIGHT)
    finish(X.write_split(stream, F.col("status") == "late", out, side, run_dir(spark, "checkpoint"), True))
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*").select(*RASTER, "status", "stable_frames", "stability_px", "confidence")


@query(
    "x4_stream_interval_alerts",
    sql("SELECT f.video_id, f.frame_index, i.id AS interval_id FROM frames f JOIN intervals i ON f.video_id = i.video_id AND f.timestamp_ms >= i.start_ms AND f.timestamp_ms < i.start_ms + (i.end_ms - i.start_ms) * 200", "intervals"),
)
def x4(spark, sf):
    spans = B.intervals(spark, sf).withColumn("end_ms", F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * 200)
    static = run_dir(spark, "spans")
    spans.write.parquet(static)
    stream = as_stream(B.frames(spark, sf).select(*RASTER, "timestamp_ms"), "alert-frames")
    out = run_dir(spark, "alerts")
    spans = spark.read.parquet(static)
    alerts = X.stream_interval_alerts(stream, spans, levels=X.interval_levels(spans)).select(*RASTER, "interval_id")
    finish(X.write_stream(alerts, out, run_dir(spark, "checkpoint"), True))
    return spark.read.parquet(out)


@query(
    "w20_throughput",
    """SELECT user_id AS job, processed, total, round_even(processed / total, 5) AS progress, CAST(round_even(CAST(CAST((processed - 5) / greatest(0.001, el) AS VARCHAR) AS DECIMAL(30, 20)), 3) AS DOUBLE) AS rate,
      round_even((total - processed) / greatest(0.001, (processed - 5) / greatest(0.001, el)), 1) AS eta_seconds FROM (
      SELECT user_id, max(event_id) + 10 AS processed, 2 * (max(event_id) + 10) + 7 AS total, arg_max(value, event_id) + 1 AS el FROM events GROUP BY user_id)""",
)
def w20(spark, sf):
    done = F.col("event_id") + 10
    progress = table(spark, sf, "events").select(F.col("user_id").alias("job"), done.alias("processed"), F.lit(5).alias("start"), (2 * done + 7).alias("total"), (F.col("value") + 1).alias("elapsed_seconds"))
    return X.throughput(progress)
