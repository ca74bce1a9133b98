from pyspark.sql import functions as F

from fieldspark.functions import rules as P
from fieldspark.operators import kernel as N
from fieldspark.operators import labels as L
from fieldspark.operators import registry as G
from fieldspark.operators import routes as W
from fieldspark.operators import tracking as K
from fieldspark.session import run_dir
from fieldspark.streaming import jobs as X


def parts(spark, sizes):
    rows = [(v, i) for v, n in sizes.items() for i in range(n)]
    df = L.frame_split(spark.createDataFrame(rows, "video_id string, frame_index long"))
    got = {r["part"]: r["n"] for r in df.groupBy("part").agg(F.count("*").alias("n")).collect()}
    return got.get("train", 0), got.get("validation", 0)


def test_frame_split(spark):
    assert parts(spark, {"a": 20}) == (16, 4)
    assert parts(spark, {"a": 3, "b": 3}) == (4, 2)
    assert parts(spark, {"a": 1}) == (1, 0)
    assert parts(spark, {"a": 1, "b": 1}) == (1, 1)


def test_video_split(spark):
    rows = [("m", f"v{i}", c) for c in ("gravel", "forest") for i in range(3)]
    rows = [(m, f"{c}-{v}", c) for m, v, c in rows]
    df = L.video_split(spark.createDataFrame(rows, "mission_id string, video_id string, terrain_category string"), "terrain_category")
    got = sorted((r["terrain_category"], r["part"]) for r in df.collect())
    assert got == [(c, p) for c in ("forest", "gravel") for p in ("test", "train", "validation")]


def test_interval_frames(spark):
    spans = spark.createDataFrame([("m", "v", "i", 500, 1500)], "mission_id string, video_id string, id string, start_ms long, end_ms long")
    videos = spark.createDataFrame([("m", "v", 10.0, 100)], "mission_id string, video_id string, fps double, total_frames long")
    assert [r["frame_index"] for r in L.intervals_to_frames(spans, videos, 2).orderBy("frame_index").collect()] == [5, 7, 9, 11, 13, 15]


def test_interval_rule(spark):
    df = spark.createDataFrame([(1000, 1000), (1000, 1100), (1000, 1200)], "a long, b long")
    assert [r[0] for r in df.select(P.valid_interval(F.col("a"), F.col("b"))).collect()] == [False, False, True]


def test_label_tracks(spark):
    rows = [("v", "t", 0, "traversable", "new"), ("v", "t", 1, "restricted", "corrected"), ("v", "u", 2, "traversable", "new"), ("v", None, 2, "tree", "new")]
    seen = spark.createDataFrame(rows, "video_id string, tracking_id string, frame_index long, class_id string, edit string")
    tracks, totals = L.label_track_summary(seen, seen.select("video_id", "frame_index"))
    by = {r["tracking_id"]: r for r in tracks.collect()}
    assert by["t"]["ended_at_frame"] == 2 and by["u"]["ended_at_frame"] is None and by["t"]["class_changes"] == 1
    total = totals.first()
    assert total["untracked_polygons"] == 1 and total["tracks"] == 2


def test_patch_distinguishes_absent_from_null(spark):
    base = spark.createDataFrame([(1, "gravel", False)], "id int, category string, flag boolean")
    patch = spark.createDataFrame([(1, None, True, ["flag"])], "id int, category string, flag boolean, set_fields array<string>")
    row = P.apply_patch(base, patch, ["id"], ["category", "flag"]).first()
    assert row["category"] == "gravel" and row["flag"]


def test_registry_keeps_hand_work(spark):
    schema = "run_id string, mission_id string, video_id string, mission_name string, original_name string, source_path string, size_bytes long, terrain_category string"
    found = spark.createDataFrame([("m/a", "m", "a", "M", "a.mp4", "/a", 5, None), ("m/b", "m", "b", "M", "b.mp4", "", 0, None)], schema)
    first, changes = G.upsert_runs(found.where("false").withColumns({"status": F.lit(""), "note": F.lit(""), "discovered_at": F.lit("0"), "updated_at": F.lit("0")}), found, F.lit("1"))
    assert {r["change"] for r in changes.collect()} == {"added"}
    edited = first.withColumn("status", F.lit("labeled")).withColumn("note", F.lit("mine"))
    second, changes = G.upsert_runs(edited, found.where("video_id = 'a'"), F.lit("2"))
    row = second.first()
    assert second.count() == 1 and (row["status"], row["note"], row["discovered_at"]) == ("labeled", "mine", "1")
    assert sorted(r["change"] for r in changes.collect()) == ["kept", "removed"]


def test_route(spark):
    path = [("r", 0, 48.0, 8.0), ("r", 1, 48.0, 8.1), ("r", 2, 48.1, 8.1)]
    route = spark.createDataFrame(path, "route_id string, idx long, lat double, lng double")
    asked = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 1.0)], "route_id string, id long, fraction double")
    for huge in (False, True):
        got = {r["id"]: r for r in W.locate_on_route(asked, route, ["route_id"], "fraction", "id", huge=huge).collect()}
        assert got[1]["lng"] > 8.05 + 0.005 and abs(got[2]["lat"] - 48.1) < 1e-9
    line = spark.createDataFrame([("r", 0, 48.0, 8.0), ("r", 1, 48.1, 8.0)], route.schema)
    assert abs(W.route_length(line, ["route_id"]).first()["length_m"] - 11119) < 120
    same = spark.createDataFrame([("r", i, 48.0, 8.0) for i in range(3)], route.schema)
    assert W.route_length(same, ["route_id"]).first()["length_m"] == 0
    assert W.locate_on_route(asked, same, ["route_id"], "fraction", "id").count() == 2


def test_anchor_and_resample(spark):
    pts = spark.createDataFrame([("v", 0, 3.0, 4.0), ("v", 1, -8.0, 2.0), ("v", 2, 1.0, -6.0)], "video_id string, idx long, x double, y double")
    length = spark.createDataFrame([("v", 250.0)], "video_id string, target_length double")
    for huge in (False, True):
        end = W.anchor(pts, length, huge=huge).where("idx = 2").first()
        assert abs(end["x"]) < 1e-6 and abs(end["y"] - 250) < 1e-6
        bent = W.resample(pts, ["video_id"], 40, huge=huge).orderBy("idx").collect()
        assert len(bent) == 40 and (bent[0]["x"], bent[-1]["y"]) == (3.0, -6.0)


def boxes(spark, rows):
    return spark.createDataFrame(rows, "video_id string, frame_index long, detection_id string, class_id string, confidence double, x1 double, y1 double, x2 double, y2 double, timestamp_ms long")


def moves(spark, n, shift=0.0):
    return spark.createDataFrame([("video", i, [1.0, 0.0, shift, 0.0, 1.0, 0.0]) for i in range(n)], "video_id string, frame_index long, m array<double>")


def test_track_is_reacquired_after_a_gap(spark):
    rows = [("video", 0, "d0", "tree", 0.7, 0.2, 0.2, 0.3, 0.8, 0), ("video", 2, "d2", "tree", 0.9, 0.4, 0.2, 0.5, 0.8, 500), ("video", 3, "d3", "tree", 0.8, 0.5, 0.2, 0.6, 0.8, 750)]
    tracked = K.track_detections(boxes(spark, rows), moves(spark, 4, 0.1))
    got = {r["detection_id"]: r for r in tracked.collect()}
    assert {r["track_id"] for r in got.values()} == {"video-T-001"}
    assert [got[d]["tracking_status"] for d in ("d0", "d2", "d3")] == ["new", "reacquired", "continued"]
    row = K.track_summary(tracked).first()
    assert row["instance_status"] == "confirmed" and row["representative_detection_id"] == "d2"


def test_long_gap_starts_a_new_track(spark):
    rows = [("video", 0, "a", "tree", 0.7, 0.2, 0.2, 0.3, 0.8, 0), ("video", 3, "b", "tree", 0.7, 0.2, 0.2, 0.3, 0.8, 750)]
    for chunk in (2048, 2):
        tracked = K.track_detections(boxes(spark, rows), moves(spark, 4), chunk=chunk)
        assert sorted(r["track_id"] for r in tracked.collect()) == ["video-T-001", "video-T-002"]


def test_iou(spark):
    df = spark.range(1)
    box = lambda *v: [F.lit(float(c)) for c in v]
    row = df.select(K.iou(box(0, 0, 1, 1), box(0, 0, 1, 1)).alias("a"), K.iou(box(0, 0, 0.2, 0.2), box(0.5, 0.5, 1, 1)).alias("b")).first()
    assert abs(row["a"] - 1) < 1e-9 and row["b"] == 0


def test_duplicates_match_brute_force(spark):
    rows = [("v", 0, f"d{i}", "tree", 0.9 - i / 10, 0.2 + x, 0.2, 0.4 + x, 0.8, 0) for i, x in enumerate((0, 0.01, 0.3, 0.02))]
    kept = K.suppress_duplicates(boxes(spark, rows), key=("video_id", "frame_index"))
    assert sorted(r["detection_id"] for r in kept.collect()) == ["d0", "d2"]


def test_sampling_quota(spark):
    rows = [(0, y, x, 1 if x < 3 else 0) for y in range(5) for x in range(10)] + [(1, y, x, 0) for y in range(5) for x in range(10)]
    df = spark.createDataFrame(rows, "frame_index long, y int, x int, label int")
    count = lambda d: {(r["frame_index"], r["label"]): r["n"] for r in d.groupBy("frame_index", "label").agg(F.count("*").alias("n")).collect()}
    assert count(N.balanced_sample(df, "label", 5, key=("frame_index",))) == {(0, 0): 5, (0, 1): 5, (1, 0): 5}
    assert count(N.balanced_sample(df, "label", 5, keep_all_negative=False, key=("frame_index",))) == {(0, 0): 5, (0, 1): 5}


def test_totals_of_hard_negatives_are_those_of_their_frames(spark):
    """Counted without listing the frames: one video here has more of them than could be listed."""
    videos = spark.createDataFrame([(0, 10.0, 100, False), (1, 25.0, 31, True), (2, 10.0, 0, True), (3, 10.0, 1, True)], "video_id long, fps double, total_frames long, fully_not_traversable boolean")
    spans = spark.createDataFrame([(0, 1, 460, 1540), (0, 2, 0, 99_999), (1, 3, 1200, 1300), (0, 4, 20_000, 30_000)], "video_id long, id long, start_ms long, end_ms long")
    listed = L.hard_negatives(spans, videos, 3, 4, ["video_id"]).groupBy("video_id", "origin").agg(F.count(F.lit(1)).alias("frames"), F.sum("frame_index").alias("frame_sum"))
    totals = L.hard_negative_totals(spans, videos, 3, 4, ["video_id"])
    assert totals.columns == listed.columns and sorted(map(tuple, totals.collect())) == sorted(map(tuple, listed.collect())) and totals.count() == 4
    long_video = videos.where("video_id = 1").withColumn("total_frames", F.lit(15_000_000_001).cast("long"))
    assert tuple(L.hard_negative_totals(spans, long_video, 3, 15, ["video_id"]).where("origin = 'video'").first()) == (1, "video", 1_000_000_001, 15 * (10**9 * (10**9 + 1) // 2))
