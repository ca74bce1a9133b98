import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldspark.operators import joins as J
from fieldspark.operators import ordered as O


def _rows(spark, n=300):
    rng = random.Random(7)
    rows = [(k, i, rng.choice([None, rng.randint(-9, 9)]), rng.randint(0, 99)) for k in range(3) for i in range(n if k == 0 else 17)]
    return spark.createDataFrame(rows, "k int, i long, v int, w int")


def test_chunked_equals_single_window(spark):
    df = _rows(spark)
    specs = dict(
        idx=O.row_index(), total=O.running_sum(F.col("v")), before=O.max_before(F.col("w")), last=O.last_value(F.col("v")), nxt=O.next_value(F.col("v")),
        prev=O.previous(F.col("v")), foll=O.following(F.col("v")), whole=O.whole_sum(F.col("w")), top=O.whole_max(F.struct("i", "w")), low=O.whole_min(F.col("w")),
    )
    plain = O.ordered_scan(df, ["k"], ["i"], O.frame_chunks("i", 10), False, **specs)
    cut = O.ordered_scan(df, ["k"], ["i"], O.frame_chunks("i", 10), True, **specs)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


LEVELS = [0.0, 0.12, 0.3333, 0.5, 0.88, 1.0]


def test_quantiles_by_radix_selection(spark):
    rng = np.random.default_rng(2)
    groups = {
        0: rng.normal(0, 1, 3001), 1: rng.integers(-3, 4, 500) * 0.5, 2: np.array([7.25]), 3: np.array([-0.0, 0.0, -1e-310, 1e-310, 5e-324]),
        4: np.concatenate([rng.normal(0, 1e300, 40), rng.normal(0, 1e-300, 40), [-1e308, 1e308]]), 5: 1.0 + np.arange(9) * 2.0**-52, 6: np.full(1000, -2.5),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [(k, None) for k in (0, 2, 9)]
    df = spark.createDataFrame(rows, "k int, w double").repartition(5)
    got = {(r["k"], r["probability"]): r["w"] for r in O.exact_quantiles(df, ["k"], "w", LEVELS).collect()}
    assert got.keys() == {(k, p) for k in groups for p in LEVELS}
    for (k, p), v in got.items():
        ordered = np.sort(groups[k])
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert v == low + (high - low) * (at - math.floor(at))
    every = [v for _, v in rows if v is not None]
    for r in O.exact_quantiles(df, [], "w", [0.12, 0.5, 0.88]).collect():
        assert abs(r["w"] - np.quantile(every, r["probability"])) < 1e-9
    assert O.exact_quantiles(df.where("false"), ["k"], "w", LEVELS).collect() == [] and O.exact_quantiles(df.where("w IS NULL"), [], "w", [0.5]).collect() == []


def test_no_job_and_no_sort_of_values_for_quantiles(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.rand(1).alias("w"))
    group = "quantile-plan"
    spark.sparkContext.setJobGroup(group, "")
    plan = O.exact_quantiles(df, ["k"], "w", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group) and "percentile" not in plan
    spark.sparkContext.setJobGroup("tests", "")


def test_medians_of_several_columns(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 4, None), ("a", 2, 7.0), ("b", None, None), ("c", None, 3.0)], "v string, x int, y double")
    assert {tuple(r) for r in O.medians(df, ["v"], ("x", "y")).collect()} == {("a", 2.0, 6.0), ("c", None, 3.0)}


def test_balanced_chunks_split_a_hot_range(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") % 50).alias("t"))
    sizes = df.groupBy(O.balanced_chunks(df, "t", rows=500, pieces=64).alias("c")).count().collect()
    assert len(sizes) > 10 and sum(r["count"] for r in sizes) == 20_000


def test_asof_and_nearest_against_brute_force(spark):
    rng = random.Random(3)
    left = [(rng.randint(0, 1), rng.randint(0, 400), i) for i in range(120)]
    right = [(rng.randint(0, 1), rng.randint(0, 400), i) for i in range(40)]
    l_df = spark.createDataFrame(left, "v int, t long, id long")
    r_df = spark.createDataFrame(right, "v int, t long, id long")
    for huge in (False, True):
        got = {r["id"]: r["right_id"] for r in J.asof_join(l_df, r_df, ["v"], "t", 30, ["id"], huge).collect()}
        near = {r["id"]: r["right_id"] for r in J.nearest_join(l_df, r_df, ["v"], "t", ["id"], 30, huge).collect()}
        for v, t, i in left:
            back = [(rt, -ri) for rv, rt, ri in right if rv == v and rt <= t and t - rt <= 30]
            assert got[i] == (-max(back)[1] if back else None)
            both = [(abs(rt - t), rt, ri) for rv, rt, ri in right if rv == v and abs(rt - t) <= 30]
            assert near[i] == (min(both)[2] if both else None)


def test_touching_intervals_do_not_overlap(spark):
    df = spark.createDataFrame([("a", 1, 1000, 3000), ("a", 2, 3000, 4000), ("b", 3, 1000, 3000), ("b", 4, 2000, 4000)], "video_id string, id int, start_ms long, end_ms long")
    assert [r["id"] for r in J.overlapping_intervals(df, ["video_id"], "start_ms", "end_ms", "id").collect()] == [4]


def test_quantiles_of_every_entry_of_an_array(spark, monkeypatch):
    rng = np.random.default_rng(4)
    columns = [
        rng.normal(0, 1, 3001), rng.integers(-3, 4, 3001) * 0.5, np.full(3001, 7.25), 1.0 + (np.arange(3001) % 9) * 2.0**-52,
        np.concatenate([rng.normal(0, 1e300, 1500), rng.normal(0, 1e-300, 1499), [-1e308, 1e308]]),
    ]
    rows = [([float(v) for v in r],) for r in zip(*columns, strict=True)] + [(None,)]
    df = spark.createDataFrame(rows, "s array<double>").repartition(5)
    want = []
    for ordered in map(np.sort, columns):
        at = [p * (len(ordered) - 1) for p in LEVELS]
        want.append([float(ordered[math.floor(a)] + (ordered[math.ceil(a)] - ordered[math.floor(a)]) * (a - math.floor(a))) for a in at])
    assert O.array_quantiles(df, "s", 5, LEVELS) == want
    passes = []
    monkeypatch.setattr(O, "_count_parts", lambda *a, count=O._count_parts: passes.append(count(*a)) or passes[-1])
    monkeypatch.setattr(O, "PARTS", 32)
    assert O.array_quantiles(df, "s", 5, LEVELS) == want
    assert all(t.num_rows <= 5 * 32 for t in passes)
    assert O.array_quantiles(df.where("s IS NULL"), "s", 2, LEVELS) == [[], []]
