"""Operators give the same rows whether a video fits one task or is cut into chunks."""

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import labels as L
from fieldspark.operators import routes as W
from fieldspark.operators import terrain as T


@pytest.fixture(scope="module")
def frames(spark):
    # Frame numbers far apart, so that each video spans many chunks.
    e = F.col("id")
    return spark.range(240).select(
        (e % 3).alias("video_id"), (F.floor(e / 3) * 20_000).alias("frame_index"), e.alias("event_id"), (e * 37 % 101).alias("value"), F.element_at(F.array(F.lit("a"), F.lit("b")), (e * 7 % 2 + 1).cast("int")).alias("kind")
    )


def same(make):
    plain, cut = make(False), make(True)
    digits = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain.columns == cut.columns and digits(plain.collect()) == digits(cut.collect())


def test_split(frames):
    same(lambda huge: L.frame_split(frames.select("video_id", "frame_index"), huge=huge))


def test_streaks_and_changes(frames):
    same(lambda huge: T.stable_run_length(frames, ["video_id"], "frame_index", F.col("value"), 40, huge))
    same(lambda huge: T.change_fraction(frames, ["video_id"], "frame_index", "kind", huge))


def test_label_tracks(frames):
    seen = frames.select("video_id", (F.col("event_id") % 11).alias("tracking_id"), "frame_index", F.col("kind").alias("class_id"), F.lit("new").alias("edit"))
    same(lambda huge: L.label_tracks(seen, seen.select("video_id", "frame_index"), huge=huge))


def test_walks(spark, frames):
    e = F.col("event_id")
    pairs = frames.select("video_id", (F.col("frame_index") + 1).alias("step"), ((e % 9 - 4) / F.lit(10.0)).alias("yaw_delta"), (e % 5 + 0.0).alias("flow"), (e % 40).alias("matches"), (e % 30).alias("inliers"))
    directions = spark.createDataFrame([(0, "A_TO_B"), (1, "B_TO_A"), (2, "A_TO_B")], "video_id long, direction string")
    same(lambda huge: W.integrate_motion(pairs, directions, huge=huge))
    points = frames.select("video_id", F.col("frame_index").alias("idx"), (e * 13 % 29 + 0.0).alias("x"), (e * 5 % 31 + 0.0).alias("y"))
    same(lambda huge: W.resample(points, ["video_id"], 33, huge=huge))
    same(lambda huge: W.abrupt_turns(points, ["video_id"], huge=huge))
