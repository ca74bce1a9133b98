"""A quality classifier on random Fourier features.

Statistics of whole texts are standardised and mapped to ``WIDTH`` random cosines, whose inner products approximate a
Gaussian kernel. Tasks add up their normal equations, a second shuffle adds those of all tasks row by row, and the driver
solves one system of ``WIDTH + 1`` unknowns. Ridge scores are then made probabilities by isotonic regression on labelled
rows that the ridge fit did not see, counted in ``BINS`` bins. All labelled rows take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import text
from fieldspark.llm.doc_stats import stats
from fieldspark.llm.store import keep

WIDTH, GAMMA, RIDGE, BINS, SEED = 384, 0.08, 1e-3, 512, 71
FEATURES = 20


def fold(doc_id: int | None) -> int:
    """Fold 2 is held out, fold 3 calibrates, 0 and 1 fit the ridge; a null id counts as an empty string."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4


def features(part: text.Slice) -> np.ndarray:
    """Document statistics; ratios to the number of words, lines or characters, and sizes as logarithms."""
    s = stats(part)
    n, lines = np.maximum(1, s.n_words), np.maximum(1, s.n_lines)
    chars = np.maximum(1, s.classes.sum(axis=1, keepdims=True))
    size = s.words.end - s.words.start
    mean = s.word_chars / n
    before = part.data[np.maximum(s.words.end - 1, 0)] if len(size) else np.zeros(0, np.uint8)
    stop = np.isin(before, [ord(c) for c in ".!?"])
    upper = (part.data[s.words.start] >= 65) & (part.data[s.words.start] <= 90) if len(size) else np.zeros(0, bool)
    short = size <= 3
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[s.words.first])
    return np.column_stack(
        [
            np.log1p(s.n_words),
            mean,
            np.sqrt(count(size.astype(float) ** 2) / n),
            np.log1p(s.n_symbols),
            s.n_symbols / n,
            s.n_dup_lines / lines,
            np.log1p(s.n_dup_lines),
            s.n_repeat_words / n,
            s.n_distinct / n,
            np.log1p(s.n_lines),
            s.n_words / lines,
            count(stop) / n,
            count(upper) / n,
            count(short) / n,
            *(s.classes[:, [1, 2, 3, 5, 6]] / chars).T,
            np.log1p(s.classes.sum(axis=1)),
        ]
    )


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in text.slices(batch.column(1)):
                x = features(part)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch({"doc_id": batch.column(0)[part.rows], "fold": pa.array([fold(i) for i in ids[part.rows]], pa.int32()), "x": rows})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fold int, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # of the calibration: raw scores and probabilities
    values: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / WIDTH) * np.cos(z @ self.directions + self.shift), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.map(x) @ self.weights, -1.0, 2.0) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = text.column(batch, "x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, FEATURES))


def _summed(rows: DataFrame, make) -> np.ndarray:
    """Sum of the matrices that ``make`` gives for the batches: per task, then per matrix row through a shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = make(batch)
                total = m if total is None else total + m
        if total is not None:
            yield pa.record_batch({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array([r.astype("<f8").tobytes() for r in total], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(v, "<f8")
        if sums:
            yield pa.record_batch({"i": pa.array(list(sums), pa.int32()), "v": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    found = rows.mapInArrow(partial, "i int, v binary").repartition("i").mapInArrow(add, "i int, v binary").collect()
    return np.stack([np.frombuffer(r["v"], "<f8") for r in sorted(found)]) if found else np.zeros((0, 0))


def isotonic(x: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted ``x`` with ``hits`` of ``n``: the mean place and the share of every pool."""
    pools: list[list[float]] = []
    for place, h, k in zip(x.tolist(), hits.tolist(), n.tolist(), strict=True):
        pools.append([place * k, h, k])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(table: DataFrame, labels: DataFrame) -> Model:
    """``table``: ``doc_id, fold, x``; ``labels``: ``doc_id, y``. Without labels every score is one half."""
    known = keep(table.where("fold <> 2").join(labels, "doc_id").select("fold", "x", "y"), "labelled")
    train, rest = known.where("fold < 2"), known.where("fold = 3")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        return np.stack([np.full(x.shape[1], len(x)), x.sum(axis=0), (x**2).sum(axis=0)])

    m = _summed(train, moments)
    m = m if m.size else np.array([np.ones(FEATURES), np.zeros(FEATURES), np.ones(FEATURES)])
    mean = m[1] / m[0]
    scale = np.sqrt(np.maximum(m[2] / m[0] - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    model = Model(mean, scale, rng.normal(0, np.sqrt(2 * GAMMA), (len(mean), WIDTH)), rng.uniform(0, 2 * np.pi, WIDTH), np.zeros(WIDTH + 1), np.array([0.0]), np.array([0.5]))

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.map(_matrix(batch))
        return z.T @ np.column_stack([z, text.column(batch, "y").to_numpy().astype(float)])

    g = _summed(train, equations)
    if not g.size:
        return model
    model.weights = np.linalg.solve(g[:, :-1] + RIDGE * g[-1, -2] * np.eye(WIDTH + 1), g[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = ((model.raw(_matrix(batch)) + 1) / 3 * BINS).astype(np.int64)
            yield pa.record_batch({"bin": at, "y": text.column(batch, "y").to_numpy().astype(np.int64)})

    bins = rest.mapInArrow(binned, "bin long, y long").groupBy("bin").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        place = np.array([(r["bin"] + 0.5) * 3 / BINS - 1 for r in bins])
        model.knots, model.values = isotonic(place, np.array([r["hits"] for r in bins]), np.array([r["n"] for r in bins]))
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted``: a row for every row of ``docs``.

    ``labels`` has the id column of ``docs`` and a label of 0 or 1; null ids and labels are left out, repeated ones all count.
    Null and empty texts are scored by their statistics, all zero. Ids of ``docs`` may be null or repeat; other columns are ignored;
    no rows give no rows.
    """
    table = keep(feature_table(docs, id_col, text_col), "features")
    model = fit(table, labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch))
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": text.column(batch, "fold").to_numpy() == 2, "score": s, "predicted": (s >= limit).astype(np.int32)})

    return table.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
