"""Video analysis with a stored path model: scores, cleaned mask, grades and truth figures per frame, in batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldspark.operators import kernel as N
from fieldspark.operators import metrics as M
from fieldspark.operators import runs as R
from fieldspark.operators import terrain as T
from fieldspark.sources import writers as W
from fieldspark.streaming import jobs

MODEL = "name string, i int, j int, value double"


def store_model(spark: SparkSession, model: N.Model, threshold: float, path: str, run_id: str) -> None:
    """Keep a path model and its threshold as a run of their own and point to it."""
    rows = [*model.rows(), ("threshold", 0, 0, float(threshold))]
    W.write_run(spark.createDataFrame(rows, MODEL).coalesce(1), f"{path}/models", run_id)
    W.set_active_run(spark, f"{path}/active", run_id)


def load_model(spark: SparkSession, path: str, run_id: str | None = None) -> tuple[str, N.Model, float]:
    """The run id, model and threshold of a stored run, by default the active one. A run named must be the active one.

    A model is a few thousand numbers, so its rows may be collected.
    """
    active = W.active_run(spark.read.parquet(f"{path}/active")).first()
    if active is None:
        raise LookupError("no active model run")
    if run_id is not None and run_id != active["run_id"]:
        raise ValueError(f"the active model run is {active['run_id']}, not {run_id}")
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/models").where(F.col("run_id") == active["run_id"]).select("name", "i", "j", "value").collect()]
    return active["run_id"], N.model_from_rows(rows), next(value for name, _, _, value in rows if name == "threshold")


def analyse(
    pixels: DataFrame, frames: DataFrame, truth: DataFrame | None, annotated: DataFrame | None, model: N.Model, threshold: float, width: int, height: int, key: Sequence[str] = R.KEY
) -> dict[str, DataFrame]:
    """Tables of a set of frames: ``masks`` and ``grades`` as runs, and ``frames`` with the path share and, where annotated, the figures.

    ``pixels(key…, y, x, features)``; ``frames`` and ``annotated`` name frames; ``truth(key…, y, x0, x1)`` are the true masks.
    """
    key = list(key)
    scores = N.score(pixels.select(*key, "y", "x", "features"), model)
    masks = N.predict_mask(scores, threshold, width, height, key)
    length = (F.col("x1") - F.col("x0")).cast("long")
    area = masks.groupBy(*key).agg(F.sum(length).alias("_area"))
    rows = frames.select(*key).join(area, key, "left").select(*key, F.bround(F.coalesce("_area", F.lit(0)) / (width * height), 5).alias("path_fraction"))
    if truth is not None:
        sized = frames.select(*key).join(annotated.select(*key), key, "left_semi").withColumns({"width": F.lit(width), "height": F.lit(height)})
        own = truth.join(sized.select(*key), key, "left_semi")
        rows = rows.join(M.symmetric_metrics(M.confusion_counts(own, masks.join(sized.select(*key), key, "left_semi"), sized, key)), key, "left")
    return {"masks": masks, "grades": T.grade(scores, masks, threshold, width, height, key), "frames": rows}


def stream_analysis(
    stream: DataFrame, models: str, run_id: str, unpack, truth: DataFrame | None, annotated: DataFrame | None, width: int, height: int, path: str, checkpoint: str,
    key: Sequence[str] = R.KEY, available_now: bool = False,
) -> StreamingQuery:
    """Analyse arriving frames with the stored model ``run_id``, which must be the active one when the stream starts.

    ``unpack`` turns frames into pixels with features. Every micro-batch writes its own folder in each of the three tables
    (``masks``, ``grades``, ``frames``), and a repeated batch overwrites them, so a stop and a restart leave each frame once.
    """
    spark = stream.sparkSession
    name, model, threshold = load_model(spark, models, run_id)

    def tables(batch: DataFrame) -> dict[str, DataFrame]:
        made = analyse(unpack(batch), batch, truth, annotated, model, threshold, width, height, key)
        return {table: rows.withColumn("run_id", F.lit(name)) for table, rows in made.items()}

    return jobs.stream_tables(stream, tables, path, checkpoint, available_now)
