"""Product codes of vectors, entries found by equal-average search.

A vector is cut into equal parts, and every part position has a codebook of at most 256 entries. The entries are sorted by
the sum of their components. For a part with sum ``s`` the search begins where ``s`` falls in that order and expands to
both sides. By Cauchy and Schwarz a squared distance is at least the squared gap of the sums over the dimension, so a side
ends as soon as that bound strictly exceeds the best distance; entries at the same distance are therefore all seen and the
lowest index wins. Parts are sorted by their sum and searched in groups, so that a group shares its window of entries.

Training is a few rounds of assignment and mean. A task adds up its own sums per entry; they are summed by a shuffle, and
only the codebooks (parts x 256 entries) reach the driver. All arithmetic is on integers and exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import store

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
GROUP, STEP = 512, 16  # parts that share a window, and entries by which it grows on a side
CHUNK = 1 << 14  # vectors that a task works on at once
LARGEST = 2**53  # components saturate here
LONG = 2**63 - 1
HOT = 4096  # a label with more than this share of the rows is looked up in a broadcast table, which has at most as many rows


class Codebook:
    """The entries of one part position, sorted by their component sums."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        self.top = int(np.abs(self.entries).max(initial=0))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every row of ``v`` and the squared distance; of equal ones the lowest index.

        Distances are doubles while they and the bounds hold in 53 bits, else Python integers.
        """
        k, size = self.entries.shape
        top = max(self.top, int(np.abs(v).max(initial=0)))
        small = 4 * size * size * top * top < 2**53
        kind = np.float64 if small else object
        c, x = self.entries.astype(kind), v.astype(kind)
        sums = c.sum(1) if size else np.zeros(k, kind)
        order = np.argsort(sums, kind="stable")
        search = _Search(c[order], sums[order], order, x.sum(1) if size else np.zeros(len(v), kind), x, small)
        line = np.argsort(search.s, kind="stable")
        best = np.empty(len(v), np.int64 if small else object)
        for at in range(0, len(v), GROUP):
            rows = line[at : at + GROUP]
            best[rows] = search.group(rows)
        return (best % k).astype(np.int64), best // k


class _Search:
    def __init__(self, c: np.ndarray, sums: np.ndarray, order: np.ndarray, s: np.ndarray, x: np.ndarray, small: bool):
        self.c, self.sums, self.order, self.s, self.x, self.small = c, sums, order, s, x, small
        self.cc, self.xx = (c * c).sum(1), (x * x).sum(1)

    def _keys(self, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Smallest distance * entries + index of the rows within a window of the sorted entries."""
        d = self.xx[rows][:, None] - 2 * self.x[rows].dot(self.c[lo:hi].T) + self.cc[lo:hi]
        if self.small:
            d = d.astype(np.int64)
        return (d * len(self.order) + self.order[lo:hi]).min(1)

    def group(self, rows: np.ndarray) -> np.ndarray:
        """Keys of rows in the order of their sums: expand outward until the bound exceeds the best distance on both sides."""
        k, size, s = len(self.order), self.x.shape[1], self.s[rows]
        lo = max(0, int(np.searchsorted(self.sums, s[0])) - STEP)
        hi = min(k, int(np.searchsorted(self.sums, s[-1])) + STEP)
        best = self._keys(rows, lo, hi)
        while True:
            reach = (best // k) * size
            left = np.flatnonzero((s - self.sums[lo - 1]) ** 2 <= reach) if lo else ()
            right = np.flatnonzero((self.sums[hi] - s) ** 2 <= reach) if hi < k else ()
            if not len(left) and not len(right):
                return best
            if len(left):
                best[left] = np.minimum(best[left], self._keys(rows[left], max(0, lo - STEP), lo))
                lo = max(0, lo - STEP)
            if len(right):
                best[right] = np.minimum(best[right], self._keys(rows[right], hi, min(k, hi + STEP)))
                hi = min(k, hi + STEP)


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def _components(vec: Column) -> Column:
    scaled = F.transform(vec.cast("array<double>"), lambda x: F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    return F.transform(scaled, lambda x: F.floor(x).cast("long"))


def clean(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, v``: rows whose vector is there and all finite, components as integers ``floor(1024 * x)``."""
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vec_col).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), _components(F.col(vec_col)).alias("v"))


def _matrices(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Chunks of rows: the table, the rows that have the codebooks' length, and those as a matrix with whole parts."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield _matrix(held, width, length)
            held, n = [], 0
    if n:
        yield _matrix(held, width, length)


def _matrix(held: list[pa.RecordBatch], width: int, length: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    rows = pa.Table.from_batches(held)
    column = rows.column("v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    fits = np.flatnonzero(sizes == length)
    flat = column.flatten().to_numpy()
    if len(fits) < len(sizes):
        flat = flat[np.repeat(sizes == length, sizes)]
    m = np.zeros((len(fits), width), np.int64)
    m[:, :length] = flat.reshape(len(fits), length)
    return rows, fits, m


def _sums(kept: DataFrame, codebooks: list[np.ndarray], length: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and component sums of the parts assigned to each entry. Sums travel as high and low halves, so none overflows."""
    size = codebooks[0].shape[1]
    k = len(codebooks[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(b) for b in codebooks]
        total = np.zeros((len(books), k, size), object)
        count = np.zeros((len(books), k), np.int64)
        for _, _, m in _matrices(batches, len(books) * size, length):
            wide = int(np.abs(m).max(initial=0)) * len(m) >= 2**62
            for p, book in enumerate(books):
                own = m[:, p * size : (p + 1) * size]
                index, _ = book.nearest(own)
                line = np.argsort(index, kind="stable")
                used, first = np.unique(index[line], return_index=True)
                if len(used) and size:
                    total[p, used] += np.add.reduceat(own[line].astype(object if wide else np.int64), first, axis=0)
                count[p] += np.bincount(index, minlength=k)
        part, entry = np.nonzero(count)
        if len(part):
            sums = [[int(x) for x in row] for row in total[part, entry]]
            yield pa.record_batch(
                {
                    "part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": count[part, entry],
                    "high": pa.array([[x >> 32 for x in row] for row in sums], pa.list_(pa.int64())), "low": pa.array([[x & 0xFFFFFFFF for x in row] for row in sums], pa.list_(pa.int64())),
                }
            )

    partial = kept.select("v").mapInArrow(add, "part int, entry int, n long, high array<long>, low array<long>")
    halves = [F.sum(F.col(h)[j]).alias(f"{h}{j}") for j in range(size) for h in ("high", "low")]
    rows = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *halves).collect()  # at most one row per entry
    return {(r["part"], r["entry"]): (r["n"], [(r[f"high{j}"] << 32) + r[f"low{j}"] for j in range(size)]) for r in rows}


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """The codebooks after ``rounds`` rounds over all rows of ``kept`` (from ``clean``), and the vectors' length.

    The first codebooks are the parts of the ``entries`` smallest vec_ids (null ids last, of equal ids the smaller vector).
    The length is that of the first of them; vectors of other lengths take no part. A length that ``parts`` does not divide
    is filled up with zeros, which changes no distance. Unused entries stay. No rows: no codebooks.
    """
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return [], 0
    length = len(first[0]["v"])
    size = -(-length // parts)
    seeds = kept.where(F.size("v") == length).select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.zeros((len(seeds), size * parts), np.int64)
    start[:, :length] = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), length)
    codebooks = [start[:, p * size : (p + 1) * size].copy() for p in range(parts)]
    for _ in range(rounds):
        for (p, e), (n, sums) in _sums(kept, codebooks, length).items():
            codebooks[p][e] = [s // n for s in sums]
    return codebooks, length


def assign(kept: DataFrame, codebooks: list[np.ndarray], length: int) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits per part and the squared distances summed over the parts.

    Vectors of another length than the codebooks' have null code and error. An error beyond 64 bits is 2**63 - 1.
    """
    pairs = np.array([f"{e:02x}" for e in range(256)])
    kind = kept.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(b) for b in codebooks]
        size = codebooks[0].shape[1]
        for rows, fits, m in _matrices(batches, len(books) * size, length):
            spelled, error = np.full(len(m), "", object), np.zeros(len(m), object)
            for p, book in enumerate(books):
                index, d = book.nearest(m[:, p * size : (p + 1) * size])
                spelled, error = spelled + pairs[index].astype(object), error + d
            codes, errors = np.full(rows.num_rows, None, object), np.full(rows.num_rows, None, object)
            codes[fits], errors[fits] = spelled, np.minimum(error, LONG)
            yield from pa.table({"vec_id": rows.column("vec_id"), "label": rows.column("label"), "code": pa.array(codes, pa.string()), "error": pa.array(errors, pa.int64())}).to_batches()

    return kept.mapInArrow(code, f"vec_id long, label {kind}, code string, error long")


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (a written table) with ``label_error``, the errors summed over equal labels, nulls together.

    Labels with more than one row in 4096 are looked up in a broadcast table of at most 4096 rows; the others are joined.
    Sums beyond 64 bits are 2**63 - 1.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = store.keep(coded.groupBy("label").agg(F.coalesce(total, F.lit(0).cast("long")).alias("label_error"), F.count(F.lit(1)).alias("rows")), "op11-labels")
    n = coded.count()
    named = sums.withColumnRenamed("label", "of")
    hot = F.col("rows") * HOT > n
    same = F.col("label").eqNullSafe(F.col("of"))
    marked = coded.join(F.broadcast(named.where(hot)), same, "left")
    columns = [*coded.columns, "label_error"]
    rest = marked.where(F.col("rows").isNull()).select(*coded.columns).join(named.where(~hot), same)
    return marked.where(F.col("rows").isNotNull()).select(*columns).unionByName(rest.select(*columns))


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every row whose vector is there and all finite.

    Components become ``floor(1024 * x)``, saturating at 2**53 in size. Null and repeated ids and repeated vectors are rows of
    their own; other columns are ignored; no rows give no rows. Vectors of another length than that of the smallest id have
    null code and error and add nothing to their label's sum. The cleaned vectors and the codes are written once.
    """
    spark = vectors.sparkSession
    kept = store.keep(clean(vectors, id_col, vec_col, label_col), "op11-vectors")
    codebooks, length = train(kept)
    if not codebooks:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = store.keep(assign(kept, codebooks, length), "op11-codes")
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def sql() -> str:
    """SQL of the registered query: all rounds written out, every part against every entry."""
    nearest = """
near{r} AS (SELECT vec_id, p, min(d * 256 + e) AS k FROM (
  SELECT x.vec_id, x.p, b.e, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts x JOIN book{r} b USING (p)) GROUP BY vec_id, p)"""
    update = """
flat{r} AS (SELECT n.p, n.k % 256 AS e, unnest(x.v) AS c, generate_subscripts(x.v, 1) AS i FROM near{r} n JOIN parts x USING (vec_id, p)),
mean{r} AS (SELECT p, e, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS v FROM (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM flat{r} GROUP BY p, e, i) GROUP BY p, e),
book{q} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m USING (p, e))"""
    rounds = ",".join(nearest.format(r=r) + "," + update.format(r=r, q=r + 1) for r in range(ROUNDS))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM kept, range(4) t(p)),
book0 AS (SELECT p, e, v FROM (SELECT *, dense_rank() OVER (ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256),{rounds},{nearest.format(r=ROUNDS)},
codes AS (SELECT vec_id, string_agg(printf('%02x', k % 256), '' ORDER BY p) AS code, CAST(sum(k // 256) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, sha.codebooks_sha256 FROM kept k JOIN codes c USING (vec_id), sha"""
