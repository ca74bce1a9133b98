"""Writers: immutable runs, the active-run pointer, resumable output, GeoJSON."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldspark.operators.routes import geojson_lines
from fieldspark.sources import snapshots


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append one run as its own partition; a run id can be used only once."""
    known = _existing(df.sparkSession, path)
    if known is not None and known.where(F.col("run_id") == run_id).limit(1).count():
        raise ValueError(f"run {run_id} exists already")
    df.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").mode("append").parquet(path)


def set_active_run(spark: SparkSession, path: str, run_id: str) -> None:
    """Append a pointer event; earlier ones stay as history."""
    known = _existing(spark, path)
    last = known.agg(F.max("seq")).first()[0] if known is not None else None
    spark.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("set_at"), F.lit((last or 0) + 1).cast("long").alias("seq")).write.mode("append").parquet(path)


def active_run(pointers: DataFrame) -> DataFrame:
    """The run of the latest pointer event (none if there is no event)."""
    return pointers.agg(F.max_by("run_id", F.struct("seq", "set_at")).alias("run_id")).where(F.col("run_id").isNotNull())


def reuse_results(requested: DataFrame, results: DataFrame, run_id: str, schema_version: str, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Results that fit run and schema version, and the requested rows that still need computing."""
    fitting = results.where((F.col("run_id") == run_id) & (F.col("schema_version") == schema_version))
    reusable = fitting.join(requested.select(*key), list(key), "left_semi")
    return reusable, requested.join(fitting.select(*key), list(key), "left_anti")


def resume_write(
    frames: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, run_id: str, schema_version: str, key: Sequence[str]
) -> int:
    """Score only frames without a stored result of this run and schema; add them in one commit. Returns rows left before.

    ``path`` is a table of versions (see ``snapshots``); read it with ``snapshots.read``. The commit adds the new rows and leaves
    out those of other schema versions of the run, so a reader has either all of the old or all of the new ones. An interrupted
    write leaves nothing visible, and a restart continues after the last commit. A commit by another writer in
    between raises ``snapshots.Conflict``; the write can then be repeated.
    """
    spark = frames.sparkSession
    version, stored = snapshots.latest(spark, path)
    known = snapshots.read(spark, path, version, run_id=run_id, schema_version=schema_version) if version else None
    todo = frames if known is None else frames.join(known.select(*key), list(key), "left_anti")
    seen, folder = Observation(f"rows of {run_id}"), snapshots.new_folder()
    rows = score(todo.observe(seen, F.count(F.lit(1)).alias("left"))).withColumn("run_id", F.lit(run_id)).withColumn("schema_version", F.lit(schema_version))
    rows.write.parquet(f"{path}/{folder}")
    left = seen.get["left"]
    wanted = [e for e in stored if e["run_id"] != run_id or e["schema_version"] == schema_version]
    if left:
        wanted.append({"folder": folder, "run_id": run_id, "schema_version": schema_version})
    if wanted != stored:
        snapshots.commit(spark, path, wanted, version)
    return left


def write_geojson_lines(points: DataFrame, path: str, group: Sequence[str], order: str = "idx", lng: str = "lng", lat: str = "lat") -> None:
    """One LineString feature per text line."""
    geojson_lines(points, group, order, lng, lat).select("feature").write.mode("overwrite").text(path)
