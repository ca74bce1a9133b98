"""Random-Fourier ridge models: moments, sampling, Gram sums, fit, scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.operators import runs as R
from fieldspark.session import cut_lineage

# Training defaults of the path and the terrain model.
PATH = {"random_features": 64, "samples": 450, "ridge_lambda": 0.08, "seed": 42}
TERRAIN = {"random_features": 256, "ridge_lambda": 1.0, "seed": 4711}
MIN_SCALE = 1e-5


@dataclass
class Model:
    """Fitted parameters; small (d × D numbers), shipped to tasks with the closure."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    classes: list = field(default_factory=list)

    def folded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Standardisation and amplitude folded into projection and weights."""
        projection = self.projection / self.scale[:, None]
        offset = self.phase - (self.mean / self.scale) @ self.projection
        amplitude = math.sqrt(2.0 / self.projection.shape[1])
        return projection, offset, amplitude * self.weights[:-1], self.weights[-1]

    def rows(self) -> list[tuple[str, int, int, float]]:
        """Long form (name, i, j, value) for storage next to a run."""
        out = []
        for name in ("mean", "scale", "projection", "phase", "weights"):
            values = np.atleast_2d(getattr(self, name))
            out += [(name, int(i), int(j), float(values[i, j])) for i in range(values.shape[0]) for j in range(values.shape[1])]
        return out


def model_from_rows(rows: Sequence[tuple[str, int, int, float]]) -> Model:
    """A binary model from its long form; other names are left aside."""
    parts: dict[str, dict] = {}
    for name, i, j, value in rows:
        parts.setdefault(name, {})[i, j] = value
    full = {n: np.array([[cells[i, j] for j in range(1 + max(k[1] for k in cells))] for i in range(1 + max(k[0] for k in cells))]) for n, cells in parts.items()}
    return Model(full["mean"][0], full["scale"][0], full["projection"], full["phase"][0], full["weights"][0])


def draw_projection(d: int, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / math.sqrt(d), (d, features)), rng.uniform(0, 2 * math.pi, features)


def feature_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population std per column in one pass; a tiny std counts as one."""
    raw = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    scale = lambda c: F.when(F.col(f"s_{c}") < MIN_SCALE, 1.0).otherwise(F.col(f"s_{c}"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), scale(c).alias("scale")) for c in columns])
    return raw.select(F.inline(pairs))


def vector_moments(df: DataFrame, d: int, features: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Moments of an array column: tasks add up, Spark merges, 3·d numbers reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(d), np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                values = _vectors(batch, features)
                n, total, square = n + len(values), total + values.sum(axis=0), square + (values * values).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, float(n))), pa.array(total), pa.array(square)], names=["i", "n", "s", "q"])

    summed = df.select(features).mapInArrow(partial, "i int, n double, s double, q double").groupBy("i").agg(*[F.sum(c).alias(c) for c in "nsq"])
    rows = sorted(summed.collect())
    n, total, square = (np.array([r[c] for r in rows]) for c in "nsq")
    mean = total / n
    scale = np.sqrt(np.maximum(0.0, square / n - mean * mean))
    return mean, np.where(scale < MIN_SCALE, 1.0, scale)


def balanced_sample(
    pixels: DataFrame, label: str, n: int = 450, seed: int = 42, keep_all_negative: bool = True, key: Sequence[str] = R.KEY
) -> DataFrame:
    """Per frame min(n, positives, negatives) of each class; a frame without path gives up to n negatives.

    Drawing is by hash order: reproducible, without a random generator.
    """
    return balanced_samples(pixels, label, [n], seed, keep_all_negative, key).drop("sizes")


def balanced_samples(
    pixels: DataFrame, label: str, sizes: Sequence[int], seed: int = 42, keep_all_negative: bool = True, key: Sequence[str] = R.KEY
) -> DataFrame:
    """The rows of :func:`balanced_sample` for several ``sizes`` at once, with ``sizes``, those that a row belongs to.

    A task keeps the first rows in hash order of every frame and class and how many it saw, and hands them on when they are many;
    only these are shuffled, once, and put together by frame. A smaller sample is a part of a larger one, so one set of rows serves all.
    """
    most, names = max(sizes), list(key)
    draw = F.xxhash64(F.lit(seed), *key, "y", "x")
    drawn = pixels.where(F.col(label).isin(0, 1)).withColumn("_draw", draw)
    partial = T.StructType([*drawn.schema.fields, T.StructField("_seen", T.LongType()), T.StructField("_task", T.IntegerType())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        rows = 0

        def pruned() -> pa.Table:
            """The first ``most`` rows of every frame and class, with the number of rows that stand behind them."""
            table = pa.Table.from_batches(held)
            group, order = _frame_order(table, [*names, label])
            start = np.flatnonzero(np.diff(group[order], prepend=-1))
            place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            seen = table.column("_seen").to_numpy()
            total = np.bincount(group, weights=seen)
            keep = order[place < most]
            # the count goes with the first row of a group, so it is neither lost nor taken twice
            counts = np.where(place[place < most] == 0, total[group[keep]], 0).astype(np.int64)
            out = table.take(pa.array(keep))
            return out.set_column(out.schema.get_field_index("_seen"), "_seen", pa.array(counts))

        for batch in batches:
            held.append(pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ones(batch.num_rows, np.int64)), pa.array(np.full(batch.num_rows, task, np.int32))], partial.names))
            rows += batch.num_rows
            if rows > SAMPLER_ROWS:
                table = pruned().combine_chunks()
                held, rows = table.to_batches(), table.num_rows
                if rows > SAMPLER_ROWS // 2:  # many frames: what is left goes on, so a task's memory does not grow with its frames
                    yield from held
                    held, rows = [], 0
        if held:
            yield from pruned().to_batches()

    out = T.StructType([*pixels.schema.fields, T.StructField("sizes", T.ArrayType(T.IntegerType()))])

    def merge(frame: pa.Table) -> pa.Table:
        values, draws = frame.column(label).to_numpy(), frame.column("_draw").to_numpy()
        y, x, seen = (frame.column(c).to_numpy() for c in ("y", "x", "_seen"))
        order = np.lexsort((x, y, draws, values))
        negative, positive = (int(seen[values == v].sum()) for v in (0, 1))
        place = np.empty(len(order), np.int64)
        for v in (0, 1):
            own = order[values[order] == v]
            place[own] = np.arange(len(own))
        taken = []
        for n in sizes:
            quota = min(n, negative) if positive == 0 and keep_all_negative else min(n, positive, negative)
            taken.append(place < quota)
        chosen = np.flatnonzero(np.any(taken, axis=0))
        which = [[n for n, t in zip(sizes, taken) if t[k]] for k in chosen]
        slim = frame.take(pa.array(chosen)).select(out.names[:-1])
        return slim.append_column("sizes", pa.array(which, pa.list_(pa.int32())))

    return drawn.mapInArrow(first, partial).groupBy(*key).applyInArrow(merge, out)


SAMPLER_ROWS = 1 << 17  # rows that a task of the sampler takes in before it drops those that cannot be drawn


def _frame_order(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number per distinct value of the columns, and the order by it, then by the draw and the place."""
    group = np.zeros(table.num_rows, np.int64)
    for name in names:
        codes = table.column(name).combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        index = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
        group = np.unique(group * (len(codes.dictionary) + 1) + index, return_inverse=True)[1]
    draws, y, x = (table.column(c).to_numpy() for c in ("_draw", "y", "x"))
    return group, np.lexsort((x, y, draws, group))


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def gram(df: DataFrame, x: str, y: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """XᵀX (upper triangle) and Xᵀy as rows.

    Every task adds up its own batches and emits one small matrix; Spark sums by
    cell. The full design matrix is never anywhere.
    """
    columns = [x, y] + ([weight] if weight else [])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = moment = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _vectors(batch, x), _vectors(batch, y)
            wa = a * batch.column(weight).to_numpy(zero_copy_only=False)[:, None] if weight else a
            total = wa.T @ a if total is None else total + wa.T @ a
            moment = wa.T @ b if moment is None else moment + wa.T @ b
        if total is None:
            return
        i, j = np.triu_indices(total.shape[0])
        k, c = np.indices(moment.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(len(i), np.int32), np.ones(len(k), np.int32)])),
                pa.array(np.concatenate([i, k]).astype(np.int32)),
                pa.array(np.concatenate([j, c]).astype(np.int32)),
                pa.array(np.concatenate([total[i, j], moment[k, c]])),
            ],
            names=["part", "i", "j", "value"],
        )

    summed = (
        df.select(*columns)
        .mapInArrow(partial, "part int, i int, j int, value double")
        .groupBy("part", "i", "j")
        .agg(F.sum("value").alias("value"))
    )
    return summed.where("part = 0").drop("part"), summed.where("part = 1").select("i", F.col("j").alias("k"), "value")


def hidden_design(df: DataFrame, model: Model, features: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """Random features plus a constant as ``design array<double>``."""
    shift = model.phase - (model.mean / model.scale) @ model.projection
    projection = model.projection / model.scale[:, None]
    amplitude = math.sqrt(2.0 / projection.shape[1])
    kept = df.select(*keep, features)
    schema = T.StructType([*[f for f in kept.schema.fields if f.name in keep], T.StructField("design", T.ArrayType(T.DoubleType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hidden = amplitude * np.cos(_vectors(batch, features) @ projection + shift)
            design = np.column_stack([hidden, np.ones(len(hidden))])
            offsets = np.arange(0, design.size + 1, design.shape[1], dtype=np.int32)
            array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(design.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], array], names=[*keep, "design"])

    return kept.mapInArrow(project, schema)


def _collect_gram(design: DataFrame, size: int, outputs: int, weight: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The summed matrices: (D+1)² and (D+1)·classes numbers, whatever the row count."""
    upper, moment = gram(design, "design", "target", weight)
    a, b = np.zeros((size, size)), np.zeros((size, outputs))
    cells = upper.select(F.lit(0).alias("part"), "i", "j", "value").unionByName(moment.select(F.lit(1).alias("part"), "i", F.col("k").alias("j"), "value"))
    for part, i, j, value in cells.collect():
        if part:
            b[i, j] = value
        else:
            a[i, j] = a[j, i] = value
    return a, b


def fit_rff_ridge(
    samples: DataFrame, label: str, d: int, random_features: int = 64, ridge_lambda: float = 0.08, seed: int = 42, features: str = "features"
) -> Model:
    """Binary model: ±1 targets, ridge on random features."""
    return fit_ridges(samples, label, d, random_features, [ridge_lambda], seed, features)[0]


def fit_ridges(
    samples: DataFrame, label: str, d: int, random_features: int, lambdas: Sequence[float], seed: int, features: str = "features"
) -> list[Model]:
    """One model per ridge value from a single pass: the Gram sums do not depend on it."""
    samples = cut_lineage(samples.select(features, label))  # read twice: moments, then Gram sums
    mean, scale = vector_moments(samples, d, features)
    projection, phase = draw_projection(d, random_features, seed)
    model = Model(mean, scale, projection, phase, np.zeros(random_features + 1))
    target = F.array((F.col(label) * 2 - 1).cast("double")).alias("target")
    design = hidden_design(samples.select(features, target), model, features, ["target"])
    a, b = _collect_gram(design, random_features + 1, 1, None)
    eye = np.eye(random_features + 1)
    return [Model(mean, scale, projection, phase, np.linalg.solve(a + lam * eye, b[:, 0])) for lam in lambdas]


def fit_grid(
    samples: DataFrame, label: str, d: int, sizes: Sequence[int], feature_counts: Sequence[int], lambdas: Sequence[float], seed: int = 42, features: str = "features"
) -> dict[tuple[int, int, float], Model]:
    """Models for every (sample size, random features, ridge) from two passes over ``samples`` (of :func:`balanced_samples`).

    One pass sums the moments of every size, one the Gram matrices of every (size, random features). All ridge values of
    a pair come from one eigendecomposition.
    """
    slim = samples.select(features, F.col(label).cast("double").alias("_label"), "sizes")
    index = {n: k for k, n in enumerate(sizes)}

    def members(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = batch.column(2)
        inside = np.zeros((batch.num_rows, len(sizes)), bool)
        inside[np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), [index[n] for n in lists.flatten().to_pylist()]] = True
        return _vectors(batch, features), batch.column(1).to_numpy(), inside

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sizes), 2 * d + 1))
        for batch in batches:
            if batch.num_rows:
                x, _, inside = members(batch)
                total += inside.T.astype(float) @ np.column_stack([np.ones(len(x)), x, x * x])
        size, cell = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.record_batch({"size": size, "cell": cell, "value": total.ravel()})

    def summed(run, schema: str, *by: str) -> dict[tuple, float]:
        return {tuple(r)[:-1]: r["value"] for r in slim.mapInArrow(run, schema).groupBy(*by).agg(F.sum("value").alias("value")).collect()}

    cells = summed(moments, "size int, cell int, value double", "size", "cell")
    scaled = {}
    for n, k in index.items():
        count = cells.get((k, 0), 0.0)
        mean = np.array([cells[k, 1 + i] for i in range(d)]) / max(1.0, count)
        scale = np.sqrt(np.maximum(0.0, np.array([cells[k, 1 + d + i] for i in range(d)]) / max(1.0, count) - mean * mean))
        scaled[n] = mean, np.where(scale < MIN_SCALE, 1.0, scale)
    drawn = {m: draw_projection(d, m, seed) for m in feature_counts}

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(n, m): np.zeros((m + 1, m + 2)) for n in sizes for m in feature_counts}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, label_, inside = members(batch)
            for n, k in index.items():
                mean, scale = scaled[n]
                own, target = (x[inside[:, k]] - mean) / scale, label_[inside[:, k]] * 2 - 1
                for m, (projection, phase) in drawn.items():
                    design = np.column_stack([math.sqrt(2.0 / m) * np.cos(own @ projection + phase), np.ones(len(own))])
                    total[n, m] += design.T @ np.column_stack([design, target])
        for (n, m), matrix in total.items():
            i, j = np.indices(matrix.shape).reshape(2, -1).astype(np.int32)
            yield pa.record_batch({"size": np.full(len(i), n, np.int32), "features": np.full(len(i), m, np.int32), "i": i, "j": j, "value": matrix.ravel()})

    found = summed(grams, "size int, features int, i int, j int, value double", "size", "features", "i", "j")
    models = {}
    for n in sizes:
        for m, (projection, phase) in drawn.items():
            matrix = np.array([[found[n, m, i, j] for j in range(m + 2)] for i in range(m + 1)])
            values, vectors = np.linalg.eigh((matrix[:, :-1] + matrix[:, :-1].T) / 2)
            turned = vectors.T @ matrix[:, -1]
            for lam in lambdas:
                models[n, m, lam] = Model(*scaled[n], projection, phase, vectors @ (turned / (values + lam)))
    return models


def score_many(df: DataFrame, models: Sequence[Model], keep: Sequence[str], features: str = "features", out: str = "scores") -> DataFrame:
    """The scores of several binary models as one array; models with the same projection and moments share its cosines."""
    folded = [m.folded() for m in models]
    kept = df.select(*keep, features)
    schema = T.StructType([*[f for f in kept.schema.fields if f.name in keep], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, result, last = _vectors(batch, features), np.empty((batch.num_rows, len(folded))), None
            for k, (projection, offset, weights, bias) in enumerate(folded):
                if last is None or last[0].shape != projection.shape or not (np.array_equal(last[0], projection) and np.array_equal(last[1], offset)):
                    last = projection, offset, np.cos(x @ projection + offset)
                result[:, k] = last[2] @ weights + bias
            array = pa.ListArray.from_arrays(pa.array(np.arange(0, result.size + 1, len(folded), dtype=np.int32)), pa.array(result.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], array], names=[*keep, out])

    return kept.mapInArrow(run, schema)


def fit_multiclass(
    descriptors: DataFrame, label: str, classes: Sequence[str], d: int, random_features: int = 256, ridge_lambda: float = 1.0, seed: int = 4711, features: str = "features"
) -> Model:
    """One output column per class; rows weigh in inversely to their class size."""
    counts = {r[label]: r["count"] for r in descriptors.groupBy(label).count().collect()}
    total = sum(counts.values())
    mean, scale = vector_moments(descriptors, d, features)
    projection, phase = draw_projection(d, random_features, seed)
    model = Model(mean, scale, projection, phase, np.zeros((random_features + 1, len(classes))), list(classes))
    target = F.array(*[F.when(F.col(label) == c, 1.0).otherwise(-1.0) for c in classes]).alias("target")
    weight = F.lit(1.0)
    for c in classes:
        weight = F.when(F.col(label) == c, total / (len(classes) * max(1, counts.get(c, 0)))).otherwise(weight)
    design = hidden_design(descriptors.select(features, target, weight.alias("weight")), model, features, ["target", "weight"])
    a, b = _collect_gram(design, random_features + 1, len(classes), "weight")
    model.weights = np.linalg.solve(a + ridge_lambda * np.eye(random_features + 1), b)
    return model


def score(df: DataFrame, model: Model, features: str = "features", keep: Sequence[str] | None = None, out: str = "score") -> DataFrame:
    """Add the model score: a number for a binary model, an array for a multi-class one."""
    projection, offset, weights, bias = model.folded()
    keep = [c for c in df.columns if c != features] if keep is None else list(keep)
    many = weights.ndim == 2
    kept = df.select(*keep, features)
    kind = T.ArrayType(T.DoubleType()) if many else T.DoubleType()
    schema = T.StructType([*[f for f in kept.schema.fields if f.name in keep], T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            result = np.cos(_vectors(batch, features) @ projection + offset) @ weights + bias
            if many:
                offsets = np.arange(0, result.size + 1, result.shape[1], dtype=np.int32)
                array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(result.reshape(-1)))
            else:
                array = pa.array(result)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], array], names=[*keep, out])

    return kept.mapInArrow(run, schema)


def score_with(df: DataFrame, scorer, schema) -> DataFrame:
    """Custom model plug-in: ``scorer`` maps one Arrow record batch to one record batch."""
    return df.mapInArrow(lambda batches: (scorer(batch) for batch in batches if batch.num_rows), schema)


def predict_mask(scores: DataFrame, threshold: float, width: int, height: int, key: Sequence[str] = R.KEY, clean: bool = True) -> DataFrame:
    """Scores at or above the threshold, cleaned, as runs."""
    marked = scores.where(F.col("score") >= threshold).select(*key, "y", "x", F.lit(1).alias("value"))
    runs = R.encode_runs(marked, "value", key)
    return R.clean_mask(runs, width, height, key) if clean else runs


def terrain_probabilities(scores: DataFrame, scale: float, column: str = "score") -> DataFrame:
    """Softmax with a chosen scale."""
    shifted = F.transform(column, lambda v: F.exp((v - F.array_max(column)) * scale))
    total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
    return scores.withColumn("_e", shifted).withColumn("_t", total).withColumn(
        "probabilities", F.transform("_e", lambda v: v / F.col("_t"))
    ).drop("_e", "_t")


def verdict(probabilities: DataFrame, classes: Sequence[str], threshold: float = 0.6, column: str = "probabilities") -> DataFrame:
    """Top class, confidence, and whether the frame is too uncertain to be assigned one."""
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_max(column)
    top = F.element_at(names, F.array_position(column, best).cast("int"))
    return probabilities.withColumn("_b", best).withColumn("top_category", top).withColumns(
        {
            "predicted_category": F.when(F.col("_b") >= threshold, F.col("top_category")),
            "confidence": F.bround("_b", 5),
            "uncertain": F.col("_b") < threshold,
            "scores": F.map_from_arrays(names, F.transform(column, lambda p: F.bround(p, 5))),
        }
    ).drop("_b")
