"""Streams: scoring, tracking, corridor state and interval alerts."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldspark.operators.terrain import CENTRELINE_SCHEMA, MIN_MOTION_INLIERS, NEAR_FIELD_WIDTH_M, NO_LINE, REQUIRED_WIDTH_M, trace_centreline
from fieldspark.operators.tracking import advance

LATENESS = "10 minutes"
IDLE_MS = 3_600_000  # event time after which a quiet video is over


def stream_score(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Score arriving frames and store each micro-batch under its own number.

    A batch repeated after a failure overwrites its own folder, so every frame is stored
    exactly once; the checkpoint replaces hand-kept chunks.
    """

    def store(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(os.path.join(path, f"batch={number}"))

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_tables(stream: DataFrame, make: Callable[[DataFrame], dict[str, DataFrame]], path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Store several tables of each micro-batch under its number, as :func:`stream_score` does for one. The batch is kept while they are made."""

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, rows in make(batch).items():
            rows.write.mode("overwrite").parquet(os.path.join(path, name, f"batch={number}"))
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


LEVELS, FAN_BITS, FINEST_BITS = 8, 4, 10  # blocks of about a second, then 16 times longer at each level, up to about nine years


def interval_blocks(start: Column, end: Column) -> Column:
    """An interval of milliseconds as few blocks: on each level those that the next one's longer blocks cannot cover.

    At most 30 blocks of a level (15 at either end), so their number grows with the logarithm of the length; beyond the longest level one more for
    every such block. The blocks cover the interval and at most a second more at its ends.
    """
    low, high = F.shiftright(start, FINEST_BITS), F.shiftright(end - 1, FINEST_BITS) + 1
    none = F.array().cast("array<bigint>")
    up = lambda k: F.shiftright(low + ((1 << FAN_BITS * k) - 1), FAN_BITS * k)  # noqa: E731 - first whole block of a level
    down = lambda k: F.shiftright(high, FAN_BITS * k)  # noqa: E731 - and the end of the last one
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    named = lambda level: lambda block: F.struct(F.lit(level).alias("level"), block.alias("block"))
    parts = []
    for k in range(LEVELS):
        ends = F.concat(span(up(k), F.shiftleft(up(k + 1), FAN_BITS)), span(F.shiftleft(down(k + 1), FAN_BITS), down(k)))
        longest = (up(k + 1) >= down(k + 1)) if k < LEVELS - 1 else F.lit(True)
        parts.append(F.transform(F.when(longest, span(up(k), down(k))).otherwise(ends), named(k)))
    return F.concat(*parts)


def rounded(start: Column, end: Column) -> tuple[Column, Column]:
    """The ends of an interval, moved out to the blocks of the longest level whose blocks are no longer than it.

    So :func:`interval_blocks` gives at most 17 of them, and they cover at most three times its length (a second more for those below one).
    """
    level = F.floor((F.length(F.bin(end - start)) - 1 - FINEST_BITS) / FAN_BITS)
    bits = (FINEST_BITS + FAN_BITS * F.least(F.greatest(level, F.lit(0)), F.lit(LEVELS - 1))).cast("int")
    return tuple(F.call_function("shiftleft", block, bits) for block in (F.call_function("shiftright", start, bits), F.call_function("shiftright", end - 1, bits) + 1))


def moment_blocks(ms: Column, levels: Sequence[int] = range(LEVELS)) -> Column:
    """The block of every level that a moment lies in."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(ms, FINEST_BITS + FAN_BITS * k).alias("block")) for k in levels])


def _spans(intervals: DataFrame) -> DataFrame:
    spans = intervals.where("start_ms < end_ms").withColumns({c: F.col(c).cast("long") for c in ("start_ms", "end_ms")})
    return spans.select("*", F.inline(interval_blocks(*rounded(F.col("start_ms"), F.col("end_ms")))))


def interval_levels(intervals: DataFrame) -> list[int]:
    """The levels, at most ``LEVELS``, that blocks of the intervals lie on."""
    return sorted(r["level"] for r in _spans(intervals).select("level").distinct().collect())


def stream_interval_alerts(stream: DataFrame, intervals: DataFrame, by: Sequence[str] = ("video_id",), levels: Sequence[int] | None = None) -> DataFrame:
    """Frames inside an off-path interval: stream-static join on video and block, then the exact range test.

    An interval has a few rows whatever its length (:func:`rounded`); a frame looks into one block of each level and meets
    an interval in one of them only. ``levels``: those of a table of intervals that stays as it is (:func:`interval_levels`); all where it may change.
    """
    spans = _spans(intervals).select(*by, F.col("id").alias("interval_id"), "start_ms", "end_ms", "level", "block")
    blocks = moment_blocks(F.col("timestamp_ms").cast("long"), range(LEVELS) if levels is None else levels or [0])
    near = stream.select("*", F.inline(blocks)).join(spans, [*by, "level", "block"]).drop("level", "block")
    return near.where((F.col("timestamp_ms") >= F.col("start_ms")) & (F.col("timestamp_ms") < F.col("end_ms")))


def with_lateness(stream: DataFrame, column: str = "event_time", delay: str = LATENESS) -> DataFrame:
    """Watermark for media arriving late."""
    return stream.withWatermark(column, delay)


class EndingState(StatefulProcessor):
    """State per video that ends once the watermark is ``idle_ms`` past the video's latest row.

    ``fold(state, row)`` takes the rows in frame order and gives the new state and output rows; ``late(row)`` gives the output of
    a row that comes too late: at or before the last frame, or before the watermark for a video without state.
    """

    def __init__(self, columns: list[str], start: dict, fold: Callable, late: Callable, idle_ms: int):
        self.columns, self.start, self.fold, self.late, self.idle_ms = columns, start, fold, late, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "last long, expires long, state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        payload = [part[part["clock_at"].isna()] for part in rows]
        group = pd.concat(payload).sort_values("frame_index", kind="stable")  # bounded by the trigger
        watermark, out = timerValues.getCurrentWatermarkInMs(), []
        known = self.kept.exists()
        last, expires, state = self.kept.get() if known else (None, None, None)
        state, latest = json.loads(state) if known else self.start, expires
        for row in group.itertuples(index=False):
            if (last is not None and row.frame_index <= last) or (not known and row.time_ms < watermark):
                out += self.late(row)
                continue
            state, made = self.fold(state, row)
            out += made
            last, known = int(row.frame_index), True
            latest = max(latest or 0, int(row.time_ms) + self.idle_ms)
        if last is not None:
            if latest != expires:
                if expires is not None:
                    self.handle.deleteTimer(expires)
                self.handle.registerTimer(latest)
            self.kept.update((last, latest, json.dumps(state)))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.kept.clear()
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


def _with_ending_state(stream: DataFrame, output: T.StructType, start: dict, fold: Callable, late: Callable, video: str, delay: str, idle_ms: int) -> DataFrame:
    """Run :class:`EndingState` over ``stream`` with its column ``event_time``.

    Spark drops rows behind the watermark before a stateful operator. So that they can be reported, a row goes in twice: as a
    payload without event time, and as a clock that moves the watermark and may be dropped.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = [c for c in stream.columns if c != "event_time"]
    large = [c for c in columns if isinstance(stream.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    time = F.unix_millis("event_time").alias("time_ms")
    payload = F.struct(F.lit(None).cast("timestamp").alias("clock_at"), time, *columns)
    clock = F.struct(F.col("event_time").alias("clock_at"), time, *[F.lit(None).cast(stream.schema[c].dataType).alias(c) if c in large else c for c in columns])
    both = with_lateness(stream.select(F.inline(F.array(payload, clock))), "clock_at", delay)
    processor = EndingState([f.name for f in output.fields], start, fold, late, idle_ms)
    return both.groupBy(video).transformWithStateInPandas(processor, output, "Append", "EventTime")


def stream_tracks(stream: DataFrame, size: tuple[float, float] = (1.0, 1.0), video: str = "video_id", delay: str = LATENESS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Tracker with state per video: the open tracks, at most two frames old.

    Input rows are frames ``(video, frame_index, event_time, m, dets array<struct<detection_id,class_id,box>>)``. A frame at or
    before the last processed one, or behind the watermark of a video whose state has ended, comes out as 'late' for a side table.
    The state of a video ends ``idle_ms`` after its latest event time, by the watermark; a later frame begins new tracks.
    """
    key_type = stream.schema[video].dataType
    output = T.StructType(
        [T.StructField(video, key_type), T.StructField("frame_index", T.LongType()), T.StructField("detection_id", T.StringType()),
         T.StructField("root", T.StringType()), T.StructField("tracking_status", T.StringType())]
    )

    def found(row) -> list:
        return list(row.dets) if row.dets is not None else []

    def fold(state: dict, row) -> tuple[dict, list[tuple]]:
        open_tracks = dict(state)
        made = [(row.frame_index, d["detection_id"], root, status) for d, root, status in advance(open_tracks, int(row.frame_index), row.m, found(row), size)]
        return {n: {"class_id": t["class_id"], "box": [float(v) for v in t["box"]], "last": int(t["last"])} for n, t in open_tracks.items()}, made

    def late(row) -> list[tuple]:
        return [(row.frame_index, d["detection_id"], None, "late") for d in found(row)]

    return _with_ending_state(stream, output, {}, fold, late, video, delay, idle_ms)


def stream_corridor_state(
    stream: DataFrame, width: int, height: int, vehicle: float = REQUIRED_WIDTH_M, near_field: float = NEAR_FIELD_WIDTH_M, video: str = "video_id", delay: str = LATENESS, idle_ms: int = IDLE_MS
) -> DataFrame:
    """Centre lines with memory of the previous frame: its line, moved by the camera motion, and the stable count.

    Input rows are frames ``(video, frame_index, event_time, runs array<struct<y,x0,x1>>, m, inliers, visibility,
    ground_confidence)``. A lost line resets the memory. Late rows and the end of a video's memory are as in :func:`stream_tracks`.
    """
    key_type = stream.schema[video].dataType
    line_fields = T.StructType.fromDDL(CENTRELINE_SCHEMA).fields
    output = T.StructType([T.StructField(video, key_type), T.StructField("frame_index", T.LongType()), *line_fields])

    def moved(line: list, m: Sequence[float]) -> list:
        clip = lambda v, n: float(min(n - 1, max(0, v)))
        return [(clip(m[0] * x + m[1] * y + m[2], width), clip(m[3] * x + m[4] * y + m[5], height)) for x, y in line]

    def row_of(frame: int, result: dict) -> list[tuple]:
        return [(frame, *(result[f.name] for f in line_fields))]

    def fold(state: dict, row) -> tuple[dict, list[tuple]]:
        free, clearance = np.zeros((height, width), bool), np.zeros((height, width), np.float32)
        for run in row.runs:
            span = np.arange(run["x0"], run["x1"])
            free[run["y"], span] = True
            clearance[run["y"], span] = np.minimum(span - run["x0"] + 1, run["x1"] - span)
        line = state["line"]
        before = moved(line, row.m) if line and row.inliers >= MIN_MOTION_INLIERS else None
        result, line, stable = trace_centreline(free, clearance, before, state["stable"], row.visibility, row.ground_confidence, vehicle, near_field)
        return {"line": [[float(x), float(y)] for x, y in line], "stable": int(stable)}, row_of(row.frame_index, result)

    def late(row) -> list[tuple]:
        return row_of(row.frame_index, {**NO_LINE, "status": "late"})

    return _with_ending_state(stream, output, {"line": [], "stable": 0}, fold, late, video, delay, idle_ms)


def write_split(df: DataFrame, late: Column, path: str, side: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Rows to ``path`` and late ones to the side table ``side``, each micro-batch in a folder of its own that a repeated batch overwrites."""

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for rows, where in ((batch.where(~late), path), (batch.where(late), side)):
            rows.write.mode("overwrite").parquet(os.path.join(where, f"batch={number}"))
        batch.unpersist()

    writer = df.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def throughput(progress: DataFrame, by: Sequence[str] = ("job",)) -> DataFrame:
    """Rate and time left per job from its latest progress row ``(job, processed, start, total, elapsed_seconds)``."""
    latest = progress.groupBy(*by).agg(F.max_by(F.struct("processed", "start", "total", "elapsed_seconds"), "processed").alias("_p")).select(*by, "_p.*")
    rate = (F.col("processed") - F.col("start")) / F.greatest(F.lit(0.001), F.col("elapsed_seconds"))
    return latest.withColumn("_rate", rate).select(
        *by, "processed", "total",
        F.bround(F.col("processed") / F.greatest(F.lit(1), F.col("total")), 5).alias("progress"),
        F.bround("_rate", 3).alias("rate"),
        F.bround((F.col("total") - F.col("processed")) / F.greatest(F.lit(0.001), F.col("_rate")), 1).alias("eta_seconds"),
    )
