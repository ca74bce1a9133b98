"""Sampling, shared fits, the sweep and training with hard negatives, against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import kernel as N
from fieldspark.operators import pixels as X
from fieldspark.operators import runs as R
from fieldspark.plans import analysis, training
from fieldspark.session import run_dir

KEY = ["video_id", "frame_index"]
WIDTH, HEIGHT, D = 12, 9, 3


@pytest.fixture(scope="module")
def labelled(spark):
    """Frames with three features, a wandering path, one frame without path and one without anything else."""
    rng, rows = np.random.default_rng(5), []
    for v in range(4):
        for f in range(6):
            for y in range(HEIGHT):
                for x in range(WIDTH):
                    path = 0 if (v, f) == (1, 2) else 1 if (v, f) == (2, 3) else int(abs(x - 4 - f % 3) < 3)
                    rows.append((v, f, y, x, path, [float(a) for a in rng.normal(path * 0.8, 1.0, D)]))
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[k] for k in order], "video_id long, frame_index long, y int, x int, label int, features array<double>").repartition(5)


def drawn_by_window(df, n, seed, keep_all_negative):
    rows = df.withColumn("_d", F.xxhash64(F.lit(seed), *KEY, "y", "x")).collect()
    out = set()
    for frame in {(r["video_id"], r["frame_index"]) for r in rows}:
        own = sorted(((r["_d"], r["y"], r["x"], r["label"]) for r in rows if (r["video_id"], r["frame_index"]) == frame))
        positive = sum(r[3] for r in own)
        negative = len(own) - positive
        quota = min(n, negative) if positive == 0 and keep_all_negative else min(n, positive, negative)
        for label in (0, 1):
            out |= {(*frame, y, x) for _, y, x, _ in [r for r in own if r[3] == label][:quota]}
    return out


@pytest.mark.parametrize("keep_all_negative", [True, False])
def test_samples_of_several_sizes(spark, labelled, keep_all_negative, monkeypatch):
    rows = N.balanced_samples(labelled, "label", [4, 25, 500], 7, keep_all_negative, KEY).collect()
    for n in (4, 25, 500):
        got = [(r["video_id"], r["frame_index"], r["y"], r["x"]) for r in rows if n in r["sizes"]]
        assert len(got) == len(set(got)) and set(got) == drawn_by_window(labelled, n, 7, keep_all_negative)
    one = N.balanced_sample(labelled, "label", 25, 7, keep_all_negative, KEY)
    assert one.columns == labelled.columns and {(r["video_id"], r["frame_index"], r["y"], r["x"]) for r in one.collect()} == drawn_by_window(labelled, 25, 7, keep_all_negative)
    assert N.balanced_sample(labelled.where("false"), "label", 5, key=KEY).collect() == []


def fitted(x, label, features, ridge, seed):
    mean, scale = x.mean(0), x.std(0)
    projection, phase = N.draw_projection(x.shape[1], features, seed)
    design = np.column_stack([math.sqrt(2 / features) * np.cos((x - mean) / scale @ projection + phase), np.ones(len(x))])
    weights = np.linalg.solve(design.T @ design + ridge * np.eye(features + 1), design.T @ (label * 2.0 - 1))
    return lambda z: np.column_stack([math.sqrt(2 / features) * np.cos((z - mean) / scale @ projection + phase), np.ones(len(z))]) @ weights


def counts_at(scores, truth, frames, t):
    total = np.zeros(4, int)
    for f in np.unique(frames):
        grid, true = scores[frames == f].reshape(HEIGHT, WIDTH), truth[frames == f].reshape(HEIGHT, WIDTH).astype(bool)
        mask = R.dense_clean(grid >= t)
        total += [(true & mask).sum(), (~true & ~mask).sum(), (~true & mask).sum(), (true & ~mask).sum()]
    return total


def penalty(c):
    tp, tn, fp, fn = c
    return round(100 * 0.5 * (fn / max(1, tp + fn) + fp / max(1, tn + fp)), 2)


def table(rows):
    rows = sorted(rows, key=lambda r: (r["video_id"], r["frame_index"], r["y"], r["x"]))
    return np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["video_id"] * 100 + r["frame_index"] for r in rows])


def test_the_sweep_equals_single_fits(spark, labelled):
    parts = labelled.select(*KEY).distinct().withColumn("part", F.when(F.col("frame_index") == 5, "validation").otherwise("train"))
    grid = {"width": (WIDTH,), "random_features": (6, 9), "samples": (5, 20), "ridge_lambda": (0.03, 0.5)}
    rows, best = training.sweep({WIDTH: (labelled, parts, WIDTH, HEIGHT)}, grid, 11, D, key=KEY)
    assert len(rows) == 8 and [(r["ridge_lambda"], r["samples"], r["random_features"]) for r in rows[:3]] == [(0.03, 5, 6), (0.03, 5, 9), (0.03, 20, 6)]
    held, truth, frames = table(labelled.where("frame_index = 5").collect())
    train = labelled.where("frame_index < 5")
    scores = []
    for r in rows:
        x, label, _ = table(N.balanced_sample(train, "label", r["samples"], 11, True, KEY).collect())
        values = fitted(x, label, r["random_features"], r["ridge_lambda"], 11)(held)
        cuts = sorted({float(np.quantile(values, p)) for p in training.M.threshold_steps()})
        penalties = [penalty(counts_at(values, truth, frames, t - 1e-9)) for t in cuts]
        assert abs(r["symmetric_score"] - (100 - min(penalties))) < 0.011
        scores.append(r["symmetric_score"])
    assert best["candidate"] == int(np.argmax(scores))


def test_the_grid_has_all_points_and_really_other_inputs(spark):
    assert math.prod(len(v) for v in training.SWEEP.values()) == 54
    assert [training.input_size(w, (64, 16)) for w in training.SWEEP["width"]] == [(160, 48), (192, 48), (224, 56)]
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (6, 10)).astype(float)
    pixels = spark.createDataFrame([(0, 0, y, x, float(image[y, x])) for y in range(6) for x in range(10)], "video_id long, frame_index long, y int, x int, b double")
    small = np.zeros((3, 5))
    for r in X.resize_area(pixels, ("b",), (10, 6), (5, 3), KEY).collect():
        small[r["y"], r["x"]] = r["b"]
    assert (small == np.rint(image.reshape(3, 2, 5, 2).mean(axis=(1, 3)))).all()
    assert np.allclose(X.area_weights(4, 6).sum(1), 1) and np.allclose(X.area_weights(4, 6)[1], [0.5, 0.5, 0, 0])


def test_training_with_hard_negatives_is_stored(spark, labelled):
    frames = labelled.select(*KEY).distinct().withColumn("mission_id", F.col("video_id") % 2)
    negatives, confirmed = frames.where("video_id = 3"), frames.where("video_id < 3")
    with pytest.raises(ValueError):
        training.split_with_negatives(frames, negatives, key=KEY)
    parts = training.split_with_negatives(confirmed, negatives, key=KEY).persist()
    assert {(r["video_id"], r["negative"]) for r in parts.collect()} == {(0, False), (1, False), (2, False), (3, True)} and parts.count() == 24
    assert {(r["video_id"], r["frame_index"]) for r in parts.where("part = 'validation'").collect()} == {(v, 4) for v in range(4)}
    truth = R.encode_runs(labelled.withColumn("value", F.col("label")).where("label = 1"), "value", KEY)
    data = training.with_negatives(labelled.drop("label"), truth, parts, KEY).persist()
    assert data.where("video_id = 3").agg(F.sum("label")).first()[0] == 0 and data.where("video_id = 0").agg(F.sum("label")).first()[0] > 0
    path = run_dir(spark, "runs")
    run = training.train_and_store(data, parts, WIDTH, HEIGHT, path, "r1", KEY, d=D, random_features=8, samples=20)
    name, model, threshold = analysis.load_model(spark, path)
    assert name == "r1" and threshold == run.threshold and np.array_equal(model.weights, run.model.weights) and np.array_equal(model.projection, run.model.projection)
    x, label, _ = table(N.balanced_sample(data.join(parts.where("part = 'train'").select(*KEY), KEY), "label", 20, 42, True, KEY).collect())
    score = fitted(x, label, 8, 0.08, 42)
    for part, metrics in (("train", run.train_metrics), ("validation", run.validation_metrics)):
        held, true, of = table(data.join(parts.where(F.col("part") == part).select(*KEY), KEY).collect())
        assert [metrics[c] for c in ("tp", "tn", "fp", "fn")] == counts_at(score(held), true, of, threshold - 1e-9).tolist()
    stored = {(r["part"], r["name"]): r["value"] for r in spark.read.parquet(f"{path}/figures").collect()}
    assert stored["validation", "tp"] == run.validation_metrics["tp"] and stored["sizes", "train_frames"] == 20
    with pytest.raises(ValueError, match="exists"):
        training.train_and_store(data, parts, WIDTH, HEIGHT, path, "r1", KEY, d=D, random_features=8, samples=20)


def test_a_task_of_the_sampler_holds_few_rows_however_many_frames(spark, monkeypatch):
    """Nearly all rows of these frames can be drawn, so dropping the others does not bound what a task holds."""
    data = spark.range(6000).selectExpr("id div 60 AS frame_index", "int(id % 60 div 10) AS y", "int(id % 10) AS x", "int(id % 2) AS label").coalesce(1)
    want = sorted(map(str, N.balanced_samples(data, "label", [5, 28], 3, True, ("frame_index",)).collect()))
    original = N._frame_order

    def watched(held, names):
        assert held.num_rows <= 1000
        return original(held, names)

    monkeypatch.setattr(N, "SAMPLER_ROWS", 500)
    monkeypatch.setattr(N, "_frame_order", watched)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sorted(map(str, N.balanced_samples(data, "label", [5, 28], 3, True, ("frame_index",)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == 100 * 56


def test_resampled_frames_are_the_resampled_input_with_one_shuffle_of_source_pixels(spark):
    rng = np.random.default_rng(5)
    pixels = [(f, y, x, *map(float, rng.integers(0, 256, 3))) for f in range(4) for y in range(3) for x in range(7)]
    pixels = spark.createDataFrame(pixels, "frame_index long, y int, x int, b double, g double, r double")
    truth = spark.createDataFrame([(0, 0, 1, 4, 1), (0, 2, 0, 7, 1), (1, 1, 5, 6, 1), (3, 0, 0, 2, 1), (3, 0, 3, 7, 1)], "frame_index long, y int, x0 int, x1 int, value int")
    parts = spark.createDataFrame([(0, "train"), (1, "validation"), (3, "train")], "frame_index long, part string")
    source = training.source_frames(pixels, truth, parts, ("frame_index",))
    made, width, height = training.resampled_frames(source, (7, 3), 30, ("frame_index",))
    old, *size = training.resampled_input(pixels, truth, (7, 3), 30, ("frame_index",))
    want = old.join(parts, "frame_index").select(*made.columns)
    assert [width, height] == size == [30, 48]
    got = sorted(map(tuple, made.collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) == 3 * 30 * 48 and {r[4] for r in got} == {0, 1}
    assert made._jdf.queryExecution().sparkPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_scores_are_cleaned_once_for_all_thresholds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    grid = np.round(np.kron(rng.normal(0, 1, (2, 3, 5)), np.ones((3, 3)))[:, :, :14] + rng.normal(0, 0.2, (2, 9, 14)), 1)
    grid[0, :3, :4] = -np.inf
    cleaned = R.dense_clean(grid)
    for t in (-1.0, -0.3, 0.0, 0.1):
        assert (cleaned >= t).any() and all(((c >= t) == R.dense_clean(g >= t)).all() for c, g in zip(cleaned, grid, strict=True))
    rows = [(f, y, x, [float(v) for v in grid[:, y, x]], int(rng.integers(0, 2))) for f in (0,) for y in range(9) for x in range(14) if y > 2 or x > 3]
    df = spark.createDataFrame(rows, "frame_index long, y int, x int, scores array<double>, label int")
    truth = np.zeros((9, 14), bool)
    for _, y, x, _, label in rows:
        truth[y, x] = label == 1
    limits = [[-0.3, 0.1], [0.0, 0.2, 0.8]]
    grid[1, :3, :4] = -np.inf
    got = {(r["model"], r["t"]): (r["tp"], r["tn"], r["fp"], r["fn"]) for r in training.M.cleaned_counts_of(df, limits, 14, 9, True, ("frame_index",)).collect()}
    masks = {(k, t): R.dense_clean(grid[k] >= t) for k, own in enumerate(limits) for t in own}
    assert got == {c: ((truth & m).sum(), (~truth & ~m).sum(), (~truth & m).sum(), (truth & ~m).sum()) for c, m in masks.items()}


def test_frames_are_dealt_by_the_pixels_they_grow_to(spark):
    pixels = spark.range(40 * 15).selectExpr("id div 15 as frame_index", "cast(id % 15 div 5 as int) as y", "cast(id % 5 as int) as x", *(f"cast((id * 7) % 200 as double) as {c}" for c in "bgr"))
    frames = pixels.withColumn("label", F.lit(1)).withColumn("part", F.lit("train"))
    made, _, width, height, finish = training.resampled_pixels(frames, (5, 3), 12, ("frame_index",), 7)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert made.rdd.getNumPartitions() == 7 and plan.count("Exchange hashpartitioning(frame_index") == 1
    whole = training.resampled_frames(frames, (5, 3), 12, ("frame_index",))[0]
    some = finish(made.where("x = 3 and y % 2 = 0")).collect()
    assert len(some) == 40 * height // 2 and set(map(str, some)) <= set(map(str, whole.collect()))


def test_no_batch_size_is_added_up_for_every_row(spark):
    from fieldspark.session import BATCH_BYTES, batches_by_rows

    before = spark.conf.get(BATCH_BYTES)
    with batches_by_rows(spark):
        assert int(spark.conf.get(BATCH_BYTES)) == 2**31 - 1
    assert spark.conf.get(BATCH_BYTES) == before
