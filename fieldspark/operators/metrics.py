"""Confusion counts, quality metrics, thresholds and evidence picks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.operators import runs as R
from fieldspark.operators.ordered import exact_quantiles
from fieldspark.session import cut_lineage

# Threshold quantiles and softmax scales.
THRESHOLD_LOW, THRESHOLD_HIGH, THRESHOLD_COUNT = 0.12, 0.88, 33
SOFTMAX_SCALES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


def attach_truth(predictions: DataFrame, truth: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictions with the truth record of the same frame, null where none exists."""
    return predictions.join(truth, list(key), "left")


def confusion_counts(
    truth: DataFrame, predicted: DataFrame, frames: DataFrame, key: Sequence[str] = R.KEY, by: Sequence[str] | None = None
) -> DataFrame:
    """tp/tn/fp/fn pixels per group. ``frames(key…, width, height)`` names every evaluated frame."""
    compared = R.comparison_mask(truth, predicted, key)
    length = (F.col("x1") - F.col("x0")).cast("long")
    area = lambda v: F.sum(F.when(F.col("value") == v, length).otherwise(0))
    per_frame = compared.groupBy(*key).agg(area(1).alias("tp"), area(3).alias("fp"), area(2).alias("fn"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    counts = frames.join(per_frame, list(key), "left").select(
        *frames.columns, *[zero(c).alias(c) for c in ("tp", "fp", "fn")]
    )
    counts = counts.withColumn(
        "tn", F.col("width").cast("long") * F.col("height") - F.col("tp") - F.col("fp") - F.col("fn")
    )
    by = list(key if by is None else by)
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])


def symmetric_metrics(counts: DataFrame) -> DataFrame:
    """Add the eight mask metrics; every denominator is at least one."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    over = lambda a, b: a / F.greatest(F.lit(1), b)
    missed, invented = over(fn, tp + fn), over(fp, tn + fp)
    error = 0.5 * (missed + invented)
    return counts.select(
        "*",
        F.bround(missed, 5).alias("missed_label_fraction"),
        F.bround(invented, 5).alias("invented_path_fraction"),
        F.bround(100 * error, 2).alias("symmetric_penalty_points"),
        F.bround(100 * (1 - error), 2).alias("symmetric_score"),
        F.bround(over(tp, tp + fp + fn), 5).alias("iou"),
        F.bround(over(2 * tp, 2 * tp + fp + fn), 5).alias("dice"),
        F.bround(over(tp, tp + fp), 5).alias("precision"),
        F.bround(over(tp, tp + fn), 5).alias("recall"),
    )


def multiclass_metrics(
    df: DataFrame, truth: str, predicted: str, confidence: str, threshold: float = 0.6
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``overall`` (one row), ``per_class`` and the confusion ``matrix`` as rows.

    All three come from one aggregate whose size is classes², so nothing large is kept.
    """
    sure = F.col(confidence) >= threshold
    matrix = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum(F.col(confidence)).alias("_confidence"),
        F.sum(sure.cast("long")).alias("_sure"),
    )
    hit = F.col("truth") == F.col("predicted")
    support = matrix.groupBy(F.col("truth").alias("class")).agg(
        F.sum("frames").alias("support"), F.sum(F.when(hit, F.col("frames")).otherwise(0)).alias("_hits")
    )
    guessed = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("frames").alias("_guessed"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    raw = support.join(guessed, "class", "full_outer").select(
        "class", zero("support").alias("support"), zero("_hits").alias("_hits"), zero("_guessed").alias("_guessed")
    )
    raw = raw.withColumn("_p", ratio(F.col("_hits"), F.col("_guessed"))).withColumn("_r", ratio(F.col("_hits"), F.col("support")))
    per_class = raw.select(
        "class",
        "support",
        F.bround("_p", 5).alias("precision"),
        F.bround("_r", 5).alias("recall"),
        F.bround(ratio(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), 5).alias("f1"),
    )
    balanced = raw.where(F.col("support") > 0).agg(F.avg("_r").alias("_balanced"))
    frames, right = F.sum("frames"), F.sum(F.when(hit, F.col("frames")).otherwise(0))
    overall = matrix.agg(
        frames.alias("frames"),
        right.alias("_right"),
        F.sum("_confidence").alias("_confidence"),
        F.sum("_sure").alias("_sure"),
        F.sum(F.when(hit, F.col("_sure")).otherwise(0)).alias("_sure_right"),
    )
    n = F.col("frames")
    overall = overall.crossJoin(F.broadcast(balanced)).select(
        "frames",
        F.bround(ratio(F.col("_right"), n), 5).alias("accuracy"),
        F.bround(F.coalesce("_balanced", F.lit(0.0)), 5).alias("balanced_accuracy"),
        F.bround(ratio(F.col("_confidence"), n), 5).alias("mean_confidence"),
        (n - F.col("_sure")).alias("uncertain_frames"),
        F.bround(ratio(n - F.col("_sure"), n), 5).alias("uncertain_fraction"),
        F.bround(ratio(F.col("_sure_right"), F.col("_sure")), 5).alias("accuracy_on_confident"),
    )
    return overall, per_class, matrix.select("truth", "predicted", "frames")


def prediction_summary(predictions: DataFrame, videos: DataFrame, by: Sequence[str], label: str = "terrain_category") -> DataFrame:
    """One row per predicted video: uncertain share, mean confidence, dominant class, agreement with its label."""
    per_class = predictions.groupBy(*by, "top_category").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("frame_index").alias("_first"),
        F.sum(F.col("uncertain").cast("long")).alias("_u"),
        F.sum("confidence").alias("_c"),
    )
    joined = per_class.join(videos.select(*by, label), list(by), "left")
    frames = F.sum("_n")
    matches = F.sum(F.when(F.col("top_category") == F.col(label), F.col("_n")).otherwise(0))
    return joined.groupBy(*by).agg(
        frames.alias("frames"),
        F.sum("_u").alias("uncertain_frames"),
        F.bround(F.sum("_u") / frames, 5).alias("uncertain_fraction"),
        F.bround(F.sum("_c") / frames, 5).alias("mean_confidence"),
        F.max_by("top_category", F.struct("_n", (-F.col("_first")).alias("f"))).alias("dominant_category"),
        F.when(F.max(label).isNull(), F.lit(None)).otherwise(F.bround(matches / frames, 5)).alias("matches_video_category"),
    )


def threshold_candidates(
    scores: DataFrame,
    score: str = "score",
    low: float = THRESHOLD_LOW,
    high: float = THRESHOLD_HIGH,
    n: int = THRESHOLD_COUNT,
) -> DataFrame:
    """Distinct quantiles of all scores."""
    return exact_quantiles(scores.select(score), [], score, threshold_steps(low, high, n)).select(F.col(score).alias("t")).distinct()


def threshold_steps(low: float = THRESHOLD_LOW, high: float = THRESHOLD_HIGH, n: int = THRESHOLD_COUNT) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def cleaned_counts(
    labelled: DataFrame, thresholds: Sequence[float], width: int, height: int, clean: bool = True, key: Sequence[str] = R.KEY
) -> DataFrame:
    """Confusion counts per frame and threshold of the cleaned masks.

    ``labelled(key…, y, x, score, label)``. The scores of a frame are shuffled once; all
    thresholds are tried on its raster inside the task, instead of multiplying pixels by
    candidates before the shuffle. The raster is cleaned once for all of them (``dense_clean``).
    """
    return cleaned_counts_of(labelled.withColumn("scores", F.array("score")), [thresholds], width, height, clean, key).drop("model")


def cleaned_counts_of(
    labelled: DataFrame, thresholds: Sequence[Sequence[float]], width: int, height: int, clean: bool = True, key: Sequence[str] = R.KEY
) -> DataFrame:
    """:func:`cleaned_counts` for several models: ``scores`` has one score for each, ``thresholds`` the candidates of each, ``model`` its number."""
    names, cuts = list(key), [(k, float(t)) for k, own in enumerate(thresholds) for t in own]
    limits = [np.array([float(t) for t in own]) for own in thresholds]
    slim = labelled.select(*key, "y", "x", "scores", F.col("label").cast("int").alias("label"))
    counts = ("tp", "tn", "fp", "fn")
    schema = T.StructType(
        [*[f for f in slim.schema.fields if f.name in key], T.StructField("model", T.IntegerType()), T.StructField("t", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in counts]]
    )

    def run(frame: pa.Table) -> pa.Table:
        y, x = frame.column("y").to_numpy(), frame.column("x").to_numpy()
        truth = np.zeros((height, width), bool)
        truth[y, x] = frame.column("label").to_numpy() == 1
        given = frame.column("scores").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        grids = np.full((len(limits), height, width), -np.inf)
        grids[:, y, x] = np.where(np.isnan(given), -np.inf, given).T
        grids = R.dense_clean(grids) if clean else grids
        rows, path = [], int(truth.sum())
        for grid, own in zip(grids, limits, strict=True):
            for tp, fp in zip(_reaching(grid[truth], own), _reaching(grid[~truth], own), strict=True):
                rows.append((tp, truth.size - path - fp, fp, path - tp))
        head = [pa.array(frame.column(n)[:1].to_pylist() * len(cuts), frame.schema.field(n).type) for n in names]
        body = [pa.array([k for k, _ in cuts], pa.int32()), pa.array([t for _, t in cuts]), *[pa.array(list(c), pa.int64()) for c in zip(*rows)]]
        return pa.Table.from_arrays([*head, *body], names=[*names, "model", "t", *counts])

    return slim.groupBy(*key).applyInArrow(run, schema)


def _reaching(scores: np.ndarray, limits: np.ndarray) -> list[int]:
    """How many scores are at or above each limit."""
    return (len(scores) - np.searchsorted(np.sort(scores), limits)).tolist()


def threshold_table(
    scores: DataFrame, truth: DataFrame | None, candidates: DataFrame, width: int, height: int, clean: bool = True, key: Sequence[str] = R.KEY
) -> DataFrame:
    """Total metrics of every candidate threshold (at most 33 numbers, held by the driver).

    ``truth`` may be None when the scores already carry ``label``.
    """
    from fieldspark.operators.pixels import flag_pixels

    cuts = sorted(r["t"] for r in candidates.collect())
    labelled = scores if truth is None else flag_pixels(scores, truth, "label", key)
    totals = cleaned_counts(labelled, cuts, width, height, clean, key).groupBy("t").agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])
    return symmetric_metrics(totals)


def choose_threshold(table: DataFrame) -> DataFrame:
    """Smallest penalty, first candidate on ties."""
    return table.orderBy("symmetric_penalty_points", "t").limit(1)


def choose_softmax_scale(scores: DataFrame, label: str, scales: Sequence[float] = SOFTMAX_SCALES) -> DataFrame:
    """Mean negative log-likelihood per temperature; the smallest one is the choice.

    ``scores`` holds ``scores array<double>`` and the 0-based true class in ``label``.
    """
    shifted = lambda s: F.transform("scores", lambda v: F.exp((v - F.array_max("scores")) * s))
    total = lambda s: F.aggregate(shifted(s), F.lit(0.0), lambda a, v: a + v)
    hit = lambda s: F.element_at(shifted(s), (F.col(label) + 1).cast("int")) / total(s)
    nll = [F.avg(-F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-9), hit(s))))).alias(f"n{i}") for i, s in enumerate(scales)]
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("scale"), F.col(f"n{i}").alias("nll")) for i, s in enumerate(scales)])
    return scores.agg(*nll).select(F.inline(pairs)).select("scale", F.bround("nll", 6).alias("nll"))


def best_scale(table: DataFrame) -> DataFrame:
    return table.orderBy("nll", "scale").limit(1)


def prediction_stats(scores: DataFrame, predicted: DataFrame, threshold: float, key: Sequence[str] = R.KEY) -> DataFrame:
    """Path share of the cleaned mask and mean distance of the scores to the threshold."""
    separation = scores.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.abs(F.col("score") - threshold)).alias("_m")
    )
    area = predicted.groupBy(*key).agg(F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("_a"))
    return separation.join(area, list(key), "left").select(
        *key,
        F.bround(F.coalesce("_a", F.lit(0)) / F.col("_n"), 5).alias("path_fraction"),
        F.bround("_m", 5).alias("mean_separation"),
    )


def pick_evidence(metrics: DataFrame, mode: str, key: Sequence[str], worst: int = 3, best: int = 2) -> DataFrame:
    """Report rows: ``penalty`` gives best/median/worst, ``iou`` the worst and best by IoU, no row twice.

    Only the needed ranks are kept: both ends come from bounded sorts, the median
    from the row count, so no single task sorts every frame.
    """
    order = "symmetric_penalty_points" if mode == "penalty" else "iou"
    if mode == "iou":
        low = metrics.orderBy(F.col(order), *key).limit(worst).withColumn("kind", F.lit("worst"))
        high = (
            metrics.orderBy(F.col(order).desc(), *[F.col(k).desc() for k in key])
            .limit(worst + best)
            .join(low.select(*key), list(key), "left_anti")
            .orderBy(F.col(order).desc(), *[F.col(k).desc() for k in key])
            .limit(best)
            .withColumn("kind", F.lit("best"))
        )
        return low.unionByName(high)
    first = metrics.orderBy(F.col(order), *key).limit(1).withColumn("_pick", F.lit(0))
    last = metrics.orderBy(F.col(order).desc(), *[F.col(k).desc() for k in key]).limit(1).withColumn("_pick", F.lit(2))
    middle = _at_rank(metrics, order, key).withColumn("_pick", F.lit(1))
    names = F.array(F.lit("best"), F.lit("median"), F.lit("worst"))
    return (
        first.unionByName(middle).unionByName(last)
        .groupBy(*metrics.columns)
        .agg(F.min("_pick").alias("_pick"))
        .withColumn("kind", F.element_at(names, F.col("_pick") + 1))
        .drop("_pick")
    )


def _at_rank(metrics: DataFrame, order: str, key: Sequence[str]) -> DataFrame:
    """The row at rank n // 2, found column by column from counts per value.

    Each step sorts distinct values only and hands one row to the driver, so many frames
    with the same penalty never meet in one task.
    """
    left = cut_lineage(metrics)
    rank = left.count() // 2
    for column in (order, *key):
        steps = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = left.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(steps))
        hit = counted.where(F.col("_upto") > rank).orderBy("_upto").first()
        if hit is None:
            break
        left, rank = left.where(F.col(column) == hit[column]), rank - (hit["_upto"] - hit["_n"])
    return left.limit(1)


def evaluation_report(metrics: DataFrame, baseline: DataFrame, missions: DataFrame) -> DataFrame:
    """Report rows: the data basis, one row per run, then the comparison values."""
    text = lambda c: F.col(c).cast("string")
    blank = F.lit(None).cast("double")
    figures = [F.bround(c, 3).alias(c) for c in ("iou", "precision", "recall")]
    basis = missions.select(
        F.lit("data").alias("section"),
        text("name").alias("label"),
        F.when(F.col("selected"), "selected").otherwise("available").alias("train"),
        F.lit(None).cast("string").alias("evaluation"),
        F.col("confirmed_frames").cast("long").alias("frames"),
        blank.alias("iou"),
        blank.alias("precision"),
        blank.alias("recall"),
    )
    rows = metrics.select(
        F.lit("run").alias("section"), text("key").alias("label"), text("train_mission").alias("train"),
        text("eval_mission").alias("evaluation"), F.col("eval_frames").cast("long").alias("frames"), *figures,
    )
    known = baseline.select(
        F.lit("baseline").alias("section"), text("label"), text("train"), text("validation").alias("evaluation"),
        F.lit(None).cast("long").alias("frames"), *figures,
    )
    return basis.unionByName(rows).unionByName(known)


def best_of(runs: DataFrame, score: Column, tie: Column) -> DataFrame:
    """The single best run, earliest on ties."""
    return runs.orderBy(score.desc(), tie).limit(1)
