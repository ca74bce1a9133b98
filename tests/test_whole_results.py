"""Rows that must not get lost or mixed up: nulls, missing partners, long ids, small missions, older schemas."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import rules
from fieldspark.operators import labels as L
from fieldspark.operators import routes as W
from fieldspark.operators import terrain as T
from fieldspark.operators import tracking as K
from fieldspark.plans import training
from fieldspark.sources import snapshots, writers
from fieldspark.streaming import jobs

STILL = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def detections(spark, rows):
    return spark.createDataFrame(
        [(v, f, i, c, 0.9, 0.1, 0.1, 0.3, 0.3, f * 40) for v, f, i, c in rows],
        "video_id string, frame_index long, detection_id long, class_id string, confidence double, x1 double, y1 double, x2 double, y2 double, timestamp_ms long",
    )


def test_tracks_of_long_ids_unknown_classes_and_missing_motions(spark):
    d = detections(spark, [("abcdefgh-1", 0, 1, "tree"), ("abcdefgh-1", 1, 2, "tree"), ("abcdefgh-2", 0, 3, "tree"), ("abcdefgh-2", 5, 4, "rock")])
    motions = spark.createDataFrame([("abcdefgh-1", 0, STILL)], "video_id string, frame_index long, m array<double>")
    got = {r["detection_id"]: r["track_id"] for r in K.track_detections(d, motions).collect()}
    assert got == {1: "abcdefgh-1-T-001", 2: "abcdefgh-1-T-001", 3: "abcdefgh-2-T-001", 4: "abcdefgh-2-rock-001"}


def test_walks_and_videos_without_medians_stay(spark):
    pairs = spark.createDataFrame([("a", 1, 5.0, 40, 30), ("b", 1, 5.0, None, None)], "video_id string, step long, flow double, matches int, inliers int")
    assert {r["video_id"]: r["median_matches"] for r in W.traversal_quality(pairs).collect()} == {"a": 40.0, "b": None}
    frames = spark.createDataFrame(
        [("a", 0, 1, 3, 0.5, "available", "limited", "h", "m"), ("b", 0, 0, None, None, "uncertain", "unknown", None, "m")],
        "video_id string, frame_index long, detections long, motion_inliers int, stability_px double, corridor_status string, overall_class string, source_hash string, mask_hash string",
    )
    tracks = spark.createDataFrame([], "video_id string, observation_count long, countable boolean, class_id string")
    assert {r["video_id"] for r in K.video_quality_metrics(frames, tracks).collect()} == {"a", "b"}


def test_single_frames_validate_per_mission(spark):
    rows = [("A", "v1", 0), ("A", "v2", 0)] + [("B", "v3", f) for f in range(5)]
    df = spark.createDataFrame(rows, "mission_id string, video_id string, frame_index long")
    part = {(r["video_id"], r["frame_index"]): r["part"] for r in L.frame_split(df, scope=["mission_id"]).collect()}
    assert part["v2", 0] == "validation" and part["v1", 0] == "train" and part["v3", 4] == "validation"


def test_frames_without_drive_runs_are_unavailable(spark):
    drive = spark.createDataFrame([(0, y, 4, 60) for y in range(40)], "frame_index long, y int, x0 int, x1 int")
    confidence = spark.createDataFrame([(0, 0.9, 0.9), (1, 0.9, 0.9)], "frame_index long, visibility double, ground_confidence double")
    got = {r["frame_index"]: r["status"] for r in T.centreline(drive, confidence, 64, 40, key=["frame_index"]).collect()}
    assert got[1] == "unavailable" and got[0] != "unavailable"


def test_resumed_run_of_a_new_schema_replaces_the_old_rows(spark, tmp_path):
    frames = spark.range(6).select(F.col("id").alias("frame_index"))
    score = lambda df: df.withColumn("s", F.lit(1))
    out = str(tmp_path / "results")
    assert writers.resume_write(frames, score, out, "r1", "1.0", ["frame_index"]) == 6
    assert writers.resume_write(frames, score, out, "r2", "1.0", ["frame_index"]) == 6
    assert writers.resume_write(frames, score, out, "r1", "1.1", ["frame_index"]) == 6
    rows = snapshots.read(spark, out).select("run_id", "schema_version", "frame_index").collect()
    assert len(rows) == 12 and {tuple(r)[:2] for r in rows} == {("r1", "1.1"), ("r2", "1.0")}


def test_reasons_that_differ_in_spelling_get_their_own_keys(spark):
    df = spark.createDataFrame([("Hohes Gras",), ("hohes gras!",), ("hohes gras",), ("Spur",), (None,)], "label string")
    got = {r["label"]: r["key"] for r in rules.reason_keys(df).collect()}
    assert len(set(got.values())) == 4 and got["Spur"] == "custom_spur" and got["Hohes Gras"] == "custom_hohes_gras"


def test_shared_folder_is_required_on_a_cluster():
    from fieldspark import session

    class Context:
        master = "spark://host:7077"

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    assert not Session.conf


def test_late_corridor_frames_are_reported(spark, tmp_path):
    schema = "video_id long, frame_index long, event_time timestamp, runs array<struct<y:int,x0:int,x1:int>>, m array<double>, inliers int, visibility double, ground_confidence double"
    one = lambda f: (1, f, datetime.datetime(2024, 1, 1, 0, 0, f), [(y, 4, 60) for y in range(40)], STILL, 40, 0.9, 0.9)
    source = str(tmp_path / "in")
    spark.createDataFrame([one(0), one(3)], schema).coalesce(1).write.parquet(source)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.write_stream(jobs.stream_corridor_state(stream, 64, 40), out, state, True).awaitTermination()

    run()
    spark.createDataFrame([one(1), one(4)], schema).coalesce(1).write.mode("append").parquet(source)
    run()  # a stop and a restart in between
    got = {r["frame_index"]: (r["status"], r["stable_frames"]) for r in spark.read.parquet(out).collect()}
    assert got[1] == ("late", 0) and got[4][1] == 3 and len(got) == 4


def test_sweep_covers_the_grid_before_it_repeats():
    grid = training.sweep_configurations(128)
    axes = [tuple(g[a] for a in ("width", "random_features", "samples", "ridge_lambda")) for g in grid]
    assert len(set(axes[:54])) == 54 and axes[54:108] == axes[:54] and [a[0] for a in axes[:4]] == [160, 192, 224, 160]
    assert [g["seed"] for g in grid[:3]] == [42, 59, 76]


def test_greedy_matching_takes_the_best_pair_first():
    score = np.array([[0.9, 0.8], [0.9, 0.1]])
    assert K.assign(score, score > 0.2, np.array([0, 1])) == {1: 0, 0: 1}
    frame = pd.DataFrame({"d": [[0.0, 0.0, 0.1, 0.1]]})
    overlap, distance = K.box_pairs(np.array(frame["d"].tolist()), np.array([[0.0, 0.0, 0.1, 0.1], [0.5, 0.0, 0.6, 0.1]]))
    assert overlap.round(6).tolist() == [[1.0, 0.0]] and distance.round(6).tolist() == [[0.0, 0.5]]
