import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import kernel as N
from fieldspark.operators import metrics as M
from fieldspark.operators import pixels as X
from fieldspark.session import run_dir
from fieldspark.sources import readers as S
from fieldspark.sources import writers as W


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - x[:, 1] ** 2 > -0.5).astype(int)
    return x, y, spark.createDataFrame([([float(v) for v in row], int(t)) for row, t in zip(x, y)], "features array<double>, label int")


def test_fit_equals_numpy_and_is_reproducible(samples):
    x, y, df = samples
    model = N.fit_rff_ridge(df, "label", 5, 32, 0.08, 42)
    projection, phase = N.draw_projection(5, 32, 42)
    hidden = np.sqrt(2 / 32) * np.cos((x - x.mean(0)) / x.std(0) @ projection + phase)
    design = np.column_stack([hidden, np.ones(len(x))])
    want = np.linalg.solve(design.T @ design + 0.08 * np.eye(33), design.T @ (2 * y - 1.0))
    assert np.allclose(model.weights, want, atol=1e-6)
    assert np.allclose(model.weights, N.fit_rff_ridge(df.repartition(7), "label", 5, 32, 0.08, 42).weights, atol=1e-8)
    scores = [r["score"] for r in N.score(df, model).collect()]
    assert np.allclose(sorted(scores), sorted(design @ want), atol=1e-6)
    hits = [(r["score"] >= 0) == (r["label"] == 1) for r in N.score(df, model, keep=["label"]).collect()]
    assert np.isclose(np.mean(hits), np.mean((design @ want >= 0) == (y == 1)))


def test_threshold_on_separated_scores(spark):
    rows = [(f, y, x, 3.0 if 4 <= x < 12 else -3.0, 1 if 4 <= x < 12 else 0) for f in range(2) for y in range(16) for x in range(16)]
    df = spark.createDataFrame(rows, "frame_index long, y int, x int, score double, label int")
    best = M.choose_threshold(M.threshold_table(df, None, M.threshold_candidates(df), 16, 16, key=("frame_index",))).first()
    assert best["symmetric_penalty_points"] == 0 and -3 < best["t"] <= 3


def test_feature_contract():
    assert len(X.FEATURES) == 22 and X.FEATURES[-X.POSITIONAL :] == ("px", "py", "px2", "py2", "centre_distance", "green_y", "saturation_y", "value_y")


def test_box_mean_mirrors_the_border(spark):
    grid = np.random.default_rng(2).random((6, 8))
    df = spark.createDataFrame([(0, y, x, float(grid[y, x])) for y in range(6) for x in range(8)], "frame_index long, y int, x int, v double")
    padded = np.pad(grid, 1, mode="reflect")
    want = np.array([[padded[y : y + 3, x : x + 3].mean() for x in range(8)] for y in range(6)])
    got = np.zeros((6, 8))
    for r in X.box_mean(df, {"v": "m"}, 3, 8, 6, ("frame_index",)).collect():
        got[r["y"], r["x"]] = r["m"]
    assert np.allclose(got, want)


def test_readers_on_single_documents(spark):
    root = run_dir(spark, "docs")
    os.makedirs(f"{root}/trajectories/v1")
    os.makedirs(f"{root}/missions/a")
    os.makedirs(f"{root}/missions/b")
    one = {"mission_id": "m", "video_id": "v1", "frame_index": 3, "points": [[0, 1], [0.5, 0.5]]}
    json.dump(one, open(f"{root}/trajectories/v1/000000003.json", "w"))
    json.dump([{**one, "id": "t1"}, {**one, "id": "t2"}], open(f"{root}/trajectories/v1/000000004.json", "w"), indent=2)
    assert sorted(r["id"] for r in S.read_trajectories(spark, f"{root}/trajectories").collect()) == ["legacy", "t1", "t2"]
    json.dump({"id": "a", "name": "walk", "videos": [{"id": "v1"}]}, open(f"{root}/missions/a/mission.json", "w"), indent=2)
    open(f"{root}/missions/b/mission.json", "w").write('{"id": "b", ')
    good, bad = S.read_missions(spark, f"{root}/missions")
    assert [r["id"] for r in good.collect()] == ["a"] and bad.count() == 1


def test_run_ids_are_used_once_and_resume_skips_done(spark):
    path, df = run_dir(spark, "runs"), spark.range(5)
    W.write_run(df, path, "r1")
    with pytest.raises(ValueError):
        W.write_run(df, path, "r1")
    frames, out = spark.range(10).withColumnRenamed("id", "frame_index"), run_dir(spark, "out")
    score = lambda d: d.withColumn("s", F.col("frame_index") * 2)
    assert W.resume_write(frames.limit(4), score, out, "r1", "1.1", ["frame_index"]) == 4
    assert W.resume_write(frames, score, out, "r1", "1.1", ["frame_index"]) == 6
    assert W.resume_write(frames, score, out, "r1", "1.2", ["frame_index"]) == 10


@pytest.mark.skipif("FIELDSPARK_RECORDS" not in os.environ, reason="no stored records given")
def test_counts_on_stored_records(spark):
    """Folder of mission folders with labels, flags, intervals and corrections."""
    from fieldspark.functions.rules import confirmed_path_frames

    root = os.environ["FIELDSPARK_RECORDS"]
    missions, _ = S.read_missions(spark, root)
    assert (missions.count(), S.mission_videos(missions).count()) == (4, 13)
    labels, _ = S.read_annotations(spark, f"{root}/*/ground_truth", geometry=True)
    assert {r["status"]: r["count"] for r in labels.groupBy("status").count().collect()} == {"confirmed": 271, "draft": 2, "skipped": 6}
    assert confirmed_path_frames(labels).count() == 269
    assert S.read_critical_flags(spark, f"{root}/*/critical_flags").count() == 33
    assert S.read_off_path_intervals(spark, f"{root}/*/off_path_intervals").count() == 5
    fixes = S.read_refinements(spark, f"{root}/*/path_refinements")
    assert fixes.count() == 5 and fixes.select("kind").distinct().count() == 1
    lines = S.read_trajectories(spark, f"{root}/*/trajectories")
    # Two files in the old single-object form, and one list entry that was saved under that id.
    assert lines.count() == 9 and lines.where("id = 'legacy'").count() == 3
