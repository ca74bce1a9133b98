"""Versions of stored tables, and intervals as blocks."""

import random

import pytest
from pyspark.sql import functions as F

from fieldspark.session import run_dir
from fieldspark.sources import snapshots, writers
from fieldspark.streaming import jobs

KEY = ["frame_index"]


def test_a_reader_sees_one_version_or_the_next(spark):
    path, frames = run_dir(spark, "table"), spark.range(8).withColumnRenamed("id", "frame_index")
    assert snapshots.latest(spark, path) == (0, []) and snapshots.read(spark, path) is None
    score = lambda v: lambda d: d.withColumn("s", F.col("frame_index") * v)
    assert writers.resume_write(frames.where("frame_index < 5"), score(1), path, "r", "1.0", KEY) == 5
    assert writers.resume_write(frames, score(1), path, "r", "1.0", KEY) == 3
    assert writers.resume_write(frames, score(1), path, "r", "1.0", KEY) == 0 and snapshots.latest(spark, path)[0] == 2

    def watched(d):
        # while the new rows are being made the old ones are what a reader finds
        seen.append(sorted(map(tuple, snapshots.read(spark, path).collect())))
        return score(10)(d)

    seen = []
    old = sorted(map(tuple, snapshots.read(spark, path).collect()))
    assert writers.resume_write(frames, watched, path, "r", "2.0", KEY) == 8
    new = snapshots.read(spark, path)
    assert seen == [old] and len(old) == 8 and new.columns == ["frame_index", "s", "run_id", "schema_version"]
    assert {r["schema_version"] for r in new.collect()} == {"2.0"} and new.count() == 8
    assert sorted(map(tuple, snapshots.read(spark, path, 2).collect())) == old  # an older version can still be read


def test_of_two_writers_one_gets_a_conflict(spark):
    path, frames = run_dir(spark, "table"), spark.range(3).withColumnRenamed("id", "frame_index")

    def overtaken(d):
        writers.resume_write(frames, lambda x: x, path, "other", "1.0", KEY)
        return d

    with pytest.raises(snapshots.Conflict):
        writers.resume_write(frames, overtaken, path, "mine", "1.0", KEY)
    assert {r["run_id"] for r in snapshots.read(spark, path).collect()} == {"other"}
    assert writers.resume_write(frames, lambda x: x, path, "mine", "1.0", KEY) == 3
    assert snapshots.read(spark, path).groupBy("run_id").count().count() == 2


def test_an_interrupted_write_leaves_nothing(spark):
    path, frames = run_dir(spark, "table"), spark.range(3).withColumnRenamed("id", "frame_index")
    with pytest.raises(Exception, match="no such"):
        writers.resume_write(frames, lambda d: d.withColumn("x", F.raise_error(F.lit("no such thing")).cast("int")), path, "r", "1.0", KEY)
    assert snapshots.latest(spark, path) == (0, [])


def test_intervals_as_blocks(spark):
    rng = random.Random(5)
    day, year = 86_400_000, 365 * 86_400_000
    spans = [(k, *sorted((rng.randrange(2 * year), rng.randrange(2 * year)))) for k in range(30)] + [(40 + k, s, s + rng.randrange(1, 5 * day)) for k, s in enumerate(rng.randrange(year) for _ in range(40))]
    spans += [(90, 0, 1), (91, 1023, 1025), (92, 5, 5), (93, 9, 3), (94, 0, 20 * year), (95, -5000, 5000)]
    table = spark.createDataFrame(spans, "id long, start_ms long, end_ms long")
    blocks = {r["id"]: r["b"] for r in table.where("start_ms < end_ms").select("id", jobs.interval_blocks(F.col("start_ms"), F.col("end_ms")).alias("b")).collect()}
    assert max(len(b) for k, b in blocks.items() if k < 90) <= 30 * jobs.LEVELS and len(blocks[94]) <= 60
    width = lambda level: 1 << (jobs.FINEST_BITS + jobs.FAN_BITS * level)
    for k, start, end in spans:
        if start < end:
            pieces = sorted((b["block"] * width(b["level"]), (b["block"] + 1) * width(b["level"])) for b in blocks[k])
            assert pieces[0][0] <= start < pieces[0][0] + 1024 and end <= pieces[-1][1] < end + 1024 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    moments = [(m, "v") for m in [0, 1, 4, 1023, 1024, 1025, -1, -5000] + [rng.randrange(2 * year) for _ in range(300)] + [s for _, s, _ in spans] + [e for _, _, e in spans]]
    frames = spark.createDataFrame(moments, "timestamp_ms long, video_id string")
    got = jobs.stream_interval_alerts(frames, table.withColumn("video_id", F.lit("v"))).select("timestamp_ms", "interval_id").collect()
    assert sorted(map(tuple, got)) == sorted((m, k) for m, _ in moments for k, s, e in spans if s <= m < e)
