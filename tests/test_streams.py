"""Streams: results over several micro-batches and restarts, late rows, state that ends."""

import datetime
import random


from pyspark.sql import functions as F

from fieldspark.operators import tracking as K
from fieldspark.session import run_dir
from fieldspark.streaming import jobs

from .test_tracking import DETECTION, video

STILL = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
BEGIN = datetime.datetime(2024, 1, 1)
FRAMES = "video_id string, frame_index long, event_time timestamp, m array<double>, dets array<struct<detection_id:string,class_id:string,box:array<double>>>"


def frame(name, number, second, *dets):
    return name, number, BEGIN + datetime.timedelta(seconds=second), STILL, [(d, "tree", [x, 0.2, x + 0.1, 0.8]) for d, x in dets]


class Stream:
    """A folder of frames that a restarted query reads on."""

    def __init__(self, spark, **options):
        self.spark, self.options = spark, options
        self.source, self.out, self.side, self.mark = (run_dir(spark, n) for n in ("in", "out", "side", "mark"))

    def feed(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, FRAMES).coalesce(1).write.mode("append").parquet(self.source)
        stream = jobs.stream_tracks(self.spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(self.source), **self.options)
        query = jobs.write_split(stream, F.col("tracking_status") == "late", self.out, self.side, self.mark, True)
        query.awaitTermination()
        return query

    def rows(self, where):
        return {r["detection_id"]: (r["root"], r["tracking_status"]) for r in self.spark.read.parquet(where).collect()}


def test_tracks_go_on_after_a_restart_and_late_frames_go_to_the_side(spark):
    s = Stream(spark)
    s.feed([frame("v", 1, 1, ("b", 0.21)), frame("v", 0, 0, ("a", 0.2))])
    s.feed([frame("v", 2, 2, ("c", 0.22)), frame("v", 0, 0, ("old", 0.2))])
    got = s.rows(s.out)
    assert {got[d][0] for d in "abc"} == {"a"} and got["c"][1] == "continued" and s.rows(s.side) == {"old": (None, "late")}


def test_state_ends_with_the_watermark(spark):
    s = Stream(spark, delay="10 seconds", idle_ms=20_000)
    s.feed([frame("v", 0, 0, ("a", 0.2)), frame("w", 0, 1, ("b", 0.2))], [frame("w", 1, 300, ("c", 0.2))])
    query = s.feed([frame("v", 1, 2, ("late", 0.2)), frame("v", 2, 310, ("new", 0.2)), frame("w", 2, 320, ("d", 0.2))])
    assert s.rows(s.side) == {"late": (None, "late")}
    assert s.rows(s.out) == {"a": ("a", "new"), "b": ("b", "new"), "c": ("b", "continued"), "new": ("new", "new"), "d": ("b", "continued")}
    query = s.feed([("x", 0, BEGIN + datetime.timedelta(seconds=900), STILL, [])])
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    again = s.feed([("x", 1, BEGIN + datetime.timedelta(seconds=2000), STILL, [])], [("x", 2, BEGIN + datetime.timedelta(seconds=2001), STILL, [])])
    ended = [p["stateOperators"][0] for p in again.recentProgress if p["stateOperators"]][-1]
    alone = Stream(spark, delay="10 seconds", idle_ms=20_000).feed([("x", 2, BEGIN + datetime.timedelta(seconds=2001), STILL, [])])
    only_x = [p["stateOperators"][0]["numRowsTotal"] for p in alone.recentProgress if p["stateOperators"]][-1]
    assert sizes and ended["numRowsTotal"] == only_x  # v and w hold nothing any more


def test_stream_equals_the_batch_tracker(spark):
    rng = random.Random(3)
    rows, motions = video("a", 90, rng, 1 / 32)
    other, more = video("b", 40, rng, 1 / 32)
    tracked = K.track_detections(spark.createDataFrame(rows + other, DETECTION), spark.createDataFrame(motions + more, "video_id string, frame_index long, m array<double>"), chunk=16)
    firsts = {}
    want = {r["detection_id"]: (r["track_id"], r["tracking_status"]) for r in tracked.collect()}
    for d, (track, status) in want.items():
        if status == "new":
            firsts[track] = d
    moves = {(v, f): m for v, f, m in motions + more}
    frames = {}
    for r in rows + other:
        frames.setdefault((r[0], r[1]), []).append((r[2], r[3], list(r[5:9])))
    every = sorted(frames.keys() | moves.keys(), key=lambda k: k[1])
    fed = [(v, f, BEGIN + datetime.timedelta(seconds=f), moves.get((v, f), STILL), sorted(frames.get((v, f), []))) for v, f in every]
    s = Stream(spark)
    s.feed(fed[:40], fed[40:75])
    s.feed(fed[75:])
    assert s.rows(s.out) == {d: (firsts[t], status) for d, (t, status) in want.items()} and s.rows(s.side) == {}


def test_a_batch_is_one_file_and_its_table_is_read_by_many_tasks(spark):
    from fieldspark.plans import q_files

    rows = spark.range(0, 1000, 1, 4).withColumnRenamed("id", "frame_index")
    some = q_files.one_file(rows.where("frame_index % 2 = 0"))
    assert "Exchange SinglePartition" in some._jdf.queryExecution().executedPlan().toString()
    stream = q_files.as_stream(rows, "numbers", "frame_index", 3)
    seen = []
    query = stream.writeStream.foreachBatch(lambda batch, k: seen.append(sorted(r["frame_index"] for r in batch.collect()))).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [len(s) for s in seen] == [334, 333, 333] and sum(seen, []) == list(range(1000))


def test_an_interval_of_hours_has_few_rows_and_frames_look_into_its_levels_only(spark):
    rng = random.Random(11)
    spans = [(k, s, s + n) for k, (s, n) in enumerate((rng.randrange(-(10**9), 10**9), rng.choice([1, 900, 1024, 40_000, rng.randrange(1, 20_000_000)])) for _ in range(200))]
    spans += [(900, 7, 7), (901, 9, 2), (902, 0, 1 << 45), (903, 0, 16 << 10), (904, 1, (16 << 10) + 1)]
    table = spark.createDataFrame([("v", *s) for s in spans], "video_id string, id long, start_ms long, end_ms long")
    some = table.where("id not in (902)")
    levels = jobs.interval_levels(some)
    assert set(levels) <= {0, 1, 2, 3, 4} and jobs.interval_levels(table.limit(0)) == []
    rows = some.where("start_ms < end_ms").select(F.size(jobs.interval_blocks(*jobs.rounded(F.col("start_ms"), F.col("end_ms")))).alias("n"))
    assert rows.agg(F.max("n")).first()[0] <= 17
    moments = sorted({rng.randrange(-(10**9), 10**9) for _ in range(500)} | {m + d for _, s, e in spans for m in (s, e) for d in (-1, 0, 1)})
    frames = spark.createDataFrame([("v", m) for m in moments], "video_id string, timestamp_ms long")
    for part, given in ((some, levels), (table, None)):
        ids = {r["id"] for r in part.collect()}
        want = sorted((m, k) for m in moments for k, s, e in spans if s <= m < e and k in ids)
        got = jobs.stream_interval_alerts(frames, part, levels=given).select("timestamp_ms", "interval_id").collect()
        assert sorted(map(tuple, got)) == want
    assert jobs.stream_interval_alerts(frames, table.limit(0), levels=[]).count() == 0
