"""Connected areas, dense grades, and the analysis stream against the batch operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldspark.operators import kernel as N
from fieldspark.operators import runs as R
from fieldspark.operators import terrain as T
from fieldspark.plans import analysis as A
from fieldspark.session import run_dir


def flooded(mask, reach):
    """Component of every pixel by flooding, numbered in raster order."""
    out = np.zeros(mask.shape, int)
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if reach or not (dy and dx)]
    for y, x in zip(*np.nonzero(mask)):
        if not out[y, x]:
            todo, out[y, x] = [(y, x)], out.max() + 1
            while todo:
                cy, cx = todo.pop()
                for dy, dx in steps:
                    ny, nx = cy + dy, cx + dx
                    if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not out[ny, nx]:
                        out[ny, nx] = out[y, x]
                        todo.append((ny, nx))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 14), st.integers(1, 20), st.sampled_from([0, 1]), st.floats(0.2, 0.8))
def test_components_are_those_of_a_flood(seed, height, width, reach, share):
    mask = np.random.default_rng(seed).random((height, width)) < share
    y, x0, x1 = R.dense_runs(mask)
    want = flooded(mask, reach)
    assert R.label_runs(y, x0, x1, reach).tolist() == [want[a, b] for a, b in zip(y, x0)]


def test_a_snake_is_one_component():
    mask = np.zeros((400, 9), bool)
    mask[::2] = True
    mask[1::4, 8] = mask[3::4, 0] = True
    y, x0, x1 = R.dense_runs(mask[:399])
    assert set(R.label_runs(y, x0, x1, 0).tolist()) == {1}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_value_runs(seed):
    values = np.random.default_rng(seed).integers(0, 3, (5, 8))
    back = np.zeros_like(values)
    rows = list(zip(*R.dense_value_runs(values)))
    for y, a, b, v in rows:
        back[y, a:b] = v
    assert (back == values).all() and all(a[0] != b[0] or a[2] < b[1] or a[3] != b[3] for a, b in zip(rows, rows[1:]))


def test_grades_keep_to_known_pixels(spark):
    scores = spark.createDataFrame([(1, y, x, 0.9 if x < 4 else 0.1 if x < 8 else -0.9) for y in range(12) for x in range(14)] + [(2, 0, 0, 0.9)], "frame_index long, y int, x int, score double")
    mask = spark.createDataFrame([(1, y, 0, 4) for y in range(12)] + [(3, 0, 0, 2)], "frame_index long, y int, x0 int, x1 int")
    got = {(r["frame_index"], r["y"], r["x0"], r["x1"]): r["value"] for r in T.grade(scores, mask, 0.0, 14, 12, ["frame_index"]).collect()}
    assert got[1, 5, 0, 4] == 1 and got[1, 5, 4, 7] == 4 and got[1, 5, 7, 14] == 5 and {k for k in got if k[0] != 1} == {(2, 0, 0, 1)}


WIDTH, HEIGHT, KEY = 24, 18, ["video_id", "frame_index"]


def pictures(spark, count):
    rng = np.random.default_rng(4)
    rows = []
    for f in range(count):
        wave = np.sin(np.arange(WIDTH) / 4 + f / 3)[None, :] + rng.normal(0, 0.3, (HEIGHT, WIDTH))
        rows += [(1, f, y, [float(v) for v in wave[y]]) for y in range(HEIGHT)]
    lines = spark.createDataFrame(rows, "video_id long, frame_index long, y int, s array<double>")
    return lines.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("y", "s"))).alias("lines"))


def pixels(batch):
    lines = batch.select(*KEY, F.inline("lines"))
    return lines.select(*KEY, "y", F.posexplode("s").alias("x", "v")).select(*KEY, "y", "x", F.array("v").alias("features"))


def test_the_stream_equals_the_batch_operators_over_a_restart(spark):
    model = N.Model(np.array([0.1]), np.array([0.5]), np.array([[1.0, 1.4, 2.0]]), np.array([-1.0, 0.2, 0.5]), np.array([0.8, 0.4, -0.3, 0.1]))
    folder, source, out, mark = (run_dir(spark, n) for n in ("models", "in", "out", "mark"))
    with pytest.raises(Exception, match="active|PATH_NOT_FOUND"):
        A.load_model(spark, folder)
    A.store_model(spark, model, 0.3, folder, "one")
    every = pictures(spark, 7).persist()
    truth = R.encode_runs(pixels(every).withColumn("value", F.when(F.col("x") > 6, 1)), "value", KEY)
    annotated = every.where("frame_index <> 2").select(*KEY)

    def run(*parts):
        for low, high in parts:
            every.where(F.col("frame_index").between(low, high)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(source)
        A.stream_analysis(stream, folder, "one", pixels, truth, annotated, WIDTH, HEIGHT, out, mark, KEY, True).awaitTermination()

    run((0, 1), (2, 3))
    run((4, 6))
    scores = N.score(pixels(every), model)
    masks = N.predict_mask(scores, 0.3, WIDTH, HEIGHT, KEY)
    batch = A.analyse(pixels(every), every, truth, annotated, model, 0.3, WIDTH, HEIGHT, KEY)
    plain = lambda df: sorted(map(repr, df.drop("run_id").collect()))
    read = lambda name: spark.read.parquet(f"{out}/{name}/batch=*")
    assert plain(read("masks")) == plain(masks) and plain(read("grades")) == plain(T.grade(scores, masks, 0.3, WIDTH, HEIGHT, KEY))
    assert plain(read("frames").select(batch["frames"].columns)) == plain(batch["frames"]) and read("frames").count() == 7
    assert {r["frame_index"] for r in read("frames").where("iou IS NULL").collect()} == {2} and read("masks").select("run_id").distinct().first()[0] == "one"
    A.store_model(spark, model, 0.4, folder, "two")
    with pytest.raises(ValueError, match="two"):
        run()
