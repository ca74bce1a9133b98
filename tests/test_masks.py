import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import rules as P
from fieldspark.operators import corridor as C
from fieldspark.operators import metrics as M
from fieldspark.operators import runs as R
from fieldspark.operators import terrain as T

KEY = ("frame_index",)


def frames(spark, width, height, names=(0,)):
    return spark.createDataFrame([(n, width, height) for n in names], "frame_index long, width int, height int")


def test_symmetric_metrics(spark):
    rows = [(1, 50, 100, 0, 50), (2, 100, 50, 50, 0), (3, 100, 100, 0, 0)]
    got = M.symmetric_metrics(spark.createDataFrame(rows, "id int, tp long, tn long, fp long, fn long")).orderBy("id").collect()
    assert [r["symmetric_penalty_points"] for r in got] == [25.0, 25.0, 0.0] and got[2]["symmetric_score"] == 100.0


def test_wire_form_round_trip(spark, mask_runs, dense):
    grid = [[0, 0, 1], [1, 0, 1]]
    rle = R.to_rle(mask_runs({0: grid}), frames(spark, 3, 2), KEY)
    assert rle.first()["rle"] == [0, 2, 1, 2, 0, 1, 1, 1]
    back = R.decode_rle(rle.withColumn("w", F.lit(3)), "rle", "w", KEY)
    assert dense(back, 3, 2)[0].tolist() == grid
    full = R.to_rle(mask_runs({0: np.ones((4, 4), int).tolist()}), frames(spark, 4, 4), KEY)
    assert full.first()["rle"] == [1, 16]


def test_rle_rule(spark):
    df = spark.createDataFrame([([0, 1],), ([0, 4],), ([0, 2, 7, 2],), ([0, 2, 1],)], "rle array<int>")
    assert [r[0] for r in df.select(P.valid_rle(F.col("rle"), F.lit(2), F.lit(2))).collect()] == [False, True, False, False]


def test_comparison_and_refinement(spark, mask_runs, dense):
    truth, seen = mask_runs({0: [[1, 1], [0, 0]]}), mask_runs({0: [[1, 0], [1, 0]]})
    assert dense(R.comparison_mask(truth, seen, KEY), 2, 2)[0].tolist() == [[1, 2], [3, 0]]
    empty = truth.where("false")
    region = mask_runs({0: [[0, 0], [1, 0]]}).withColumn("pos", F.lit(0))
    assert dense(R.apply_refinements(empty, region, KEY), 2, 2)[0].tolist() == [[0, 0], [1, 0]]


def test_triangle_is_filled(spark, dense):
    p = "array(struct(0.2D as x, 0.8D as y), struct(0.5D as x, 0.2D as y), struct(0.8D as x, 0.8D as y))"
    poly = spark.range(1).select(F.col("id").alias("frame_index"), F.lit(0).alias("polygon_id"), F.lit("traversable").alias("class_id"), F.expr(p).alias("points"))
    mask = dense(R.rasterize(poly, 100, 60, ["traversable"], KEY), 100, 60)[0]
    assert mask[35, 50] == 1 and mask[2, 2] == 0


def test_morphology_against_dense(spark, mask_runs, dense):
    rng = np.random.default_rng(5)
    grids = {i: (rng.random((14, 23)) < 0.8).astype(int) for i in range(3)}
    runs = mask_runs({k: v.tolist() for k, v in grids.items()})
    for op, kx, ky in (("dilate", 3, 5), ("erode", 3, 3), ("open", 3, 3), ("close", 7, 5)):
        want = {k: R.dense_filter(v.astype(bool), op, kx, ky).astype(int).tolist() for k, v in grids.items()}
        for result in (R.morph(runs, op, kx, ky, 23, 14, KEY), R.morph_chain(runs, ((op, kx, ky),), 23, 14, KEY)):
            got = dense(result, 23, 14)
            assert {k: got.get(k, np.zeros((14, 23), int)).tolist() for k in want} == want


def test_noise_is_cleaned_and_blocks_stay(spark, mask_runs, dense):
    noise, block = np.zeros((20, 20), int), np.zeros((20, 20), int)
    noise[3, 4] = noise[9, 15] = 1
    block[5:15, 5:15] = 1
    got = dense(R.clean_mask(mask_runs({0: noise.tolist(), 1: block.tolist()}), 20, 20, KEY), 20, 20)
    assert 0 not in got and got[1].sum() == 100


def test_components_join_diagonals(spark, mask_runs):
    grid = [[1, 0, 0, 1], [0, 1, 0, 0], [1, 0, 0, 1]]
    eight = R.components(mask_runs({0: grid}), 8, KEY)
    four = R.components(mask_runs({0: grid}), 4, KEY)
    assert eight.select("component").distinct().count() == 3 and four.select("component").distinct().count() == 5


RUNS = "frame_index long, y int, x0 int, x1 int, value int"


def corridor_of(spark, strips, graded=False, **kw):
    """Corridors of one 160 x 120 frame; ``strips`` are ``(first line, end line, x0, x1, value)``."""
    runs = spark.createDataFrame([(0, y, x0, x1, value) for first, end, x0, x1, value in strips for y in range(first, end)], RUNS)
    rows = C.evaluate_corridors(runs, frames(spark, 160, 120), 160, 120, graded, key=KEY, **kw)
    return {r["corridor"]: r for r in rows.collect()}


def test_corridors(spark):
    narrow = corridor_of(spark, [(0, 120, 20, 141, 1)])
    assert [narrow[c]["status"] for c in ("mitte", "rechts", "links")] == ["free", "blocked", "blocked"]
    wide = corridor_of(spark, [(0, 120, 0, 160, 1)])
    assert {r["status"] for r in wide.values()} == {"free"}
    assert corridor_of(spark, [(0, 120, 0, 54, 1), (0, 120, 107, 160, 1)])["mitte"]["status"] == "blocked"


def test_graded_corridors(spark):
    soft = corridor_of(spark, [(0, 120, 0, 160, 3)], True)["mitte"]
    assert soft["status"] == "uncertain" and soft["blocked"] == 0
    seen = corridor_of(spark, [(0, 50, 0, 160, 2), (75, 120, 0, 160, 2)], True)["mitte"]
    assert seen["status"] == "free" and seen["undecided"] >= 20
    with pytest.raises(ValueError):
        corridor_of(spark, [(0, 120, 0, 160, 1)], ground=0)


def test_grades_partition(spark, mask_runs, dense):
    size = 40
    score = np.full((size, size), -2.0)
    score[10:30, 10:30] = 0.4
    score[15:25, 15:25] = 0.9
    rows = [(0, y, x, float(score[y, x])) for y in range(size) for x in range(size)]
    scores = spark.createDataFrame(rows, "frame_index long, y int, x int, score double")
    inside = mask_runs({0: (score > 0).astype(int).tolist()})
    grade = dense(T.grade(scores, inside, 0.0, size, size, KEY), size, size)[0]
    assert set(np.unique(grade[10:30, 10:30])) <= {1, 2, 3} and grade[20, 20] == 1
    outside = grade.copy()
    outside[10:30, 10:30] = 0
    assert set(np.unique(outside)) <= {0, 4, 5} and (outside == 5).any()
    assert grade[0, 0] == 5 or grade[0, 0] == 0


def test_coverage_is_a_partition(spark, mask_runs):
    grid = np.random.default_rng(1).integers(0, 4, (30, 40))
    roi = R.roi_runs(frames(spark, 40, 30), KEY)
    shares = [r["fraction"] for r in T.class_coverage(mask_runs({0: grid.tolist()}), roi, KEY).collect()]
    assert len(shares) == 4 and abs(sum(shares) - 1) < 5e-4


def test_centreline_follows_the_road(spark, mask_runs):
    grid = np.zeros((120, 160), int)
    grid[:, 10:151] = 1
    conf = spark.createDataFrame([(0, 0.95, 0.9)], "frame_index long, visibility double, ground_confidence double")
    row = T.centreline(mask_runs({0: grid.tolist()}), conf, 160, 120, key=KEY).first()
    assert row["status"] == "available" and all(abs(p["x"] - 0.5) < 0.05 for p in row["centreline"])


def test_evidence_has_no_row_twice(spark):
    rows = [(i, v, 100 - 100 * v) for i, v in enumerate([0.9, 0.1, 0.5, 0.8, 0.2, 0.7])]
    df = spark.createDataFrame(rows, "frame_index int, iou double, symmetric_penalty_points double")
    picked = M.pick_evidence(df, "iou", KEY).collect()
    assert sorted(r["iou"] for r in picked if r["kind"] == "worst") == [0.1, 0.2, 0.5]
    assert sorted(r["iou"] for r in picked if r["kind"] == "best") == [0.8, 0.9]
    assert M.pick_evidence(df.limit(2), "iou", KEY).count() == 2


def test_cells_of_runs_are_not_broadcast(spark):
    """Runs are few and small, their cells are not: they go through a shuffle, both sides to as many tasks as the pixels need."""
    from fieldspark.operators import pixels as X

    pixels = spark.createDataFrame([(f, y, x) for f in range(3) for y in range(4) for x in range(6)], "frame_index long, y int, x int")
    spans = {(0, 1, 2, 5), (0, 3, 0, 6), (2, 0, 0, 1), (2, 0, 4, 6)}
    marks = spark.createDataFrame([(*s, 1) for s in spans], "frame_index long, y int, x0 int, x1 int, value int")
    frames = spark.createDataFrame([(f, 1 << 16, 16) for f in range(30)], "frame_index long, width int, height int")
    tasks = X.tasks_for(frames)
    assert tasks == 30 * (1 << 20) // X.PIXELS_PER_TASK and X.tasks_for(frames.limit(0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = X.vertical_gradient(pixels.withColumn("gray", pixels["x"] * 10.0).repartition(tasks, "frame_index"), ["frame_index"], True)
    for some, n in ((pixels, None), (dealt, tasks)):
        got = X.flag_pixels(some, marks, "hit", ["frame_index"], n)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and (n is None or plan.count(f", {n}), ") == plan.count("Exchange hashpartitioning") == 3)
        rows = got.collect()
        assert len(rows) == 72 and all(r["hit"] == any(r["frame_index"] == f and r["y"] == y and a <= r["x"] < b for f, y, a, b in spans) for r in rows)
