"""Written intermediates in the shared folder: they survive a lost executor, and later jobs read only the columns they need."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from fieldspark.session import BATCH_BYTES, BATCH_ROWS, batches_by_rows, run_dir, ship_package

BATCH = 500  # rows of one Arrow batch; texts are large, and a task holds a few batches at a time
NUMBERS = 1 << 14  # rows of one batch that has no texts
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches small."""
    ship_package(spark)
    spark.conf.set(BATCH_ROWS, BATCH)
    spark.conf.unset(BATCH_BYTES)


def narrow(spark: SparkSession, rows: int = NUMBERS, size: int = 1 << 20) -> None:
    """Arrow batches bounded by their bytes, so that rows of a few numbers come in many at a time; holds until ``prepare``."""
    spark.conf.set(BATCH_ROWS, rows)
    spark.conf.set(BATCH_BYTES, size)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and return the table read back. What the write shuffled is removed with it."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def keep_numbers(df: DataFrame, name: str, rows: int = NUMBERS) -> DataFrame:
    """:func:`keep` for many rows of a few numbers, whose batches need no bound but ``rows``."""
    with batches_by_rows(df.sparkSession, rows):
        return keep(df, name)


def forget(written: DataFrame) -> None:
    """Delete a table from ``keep`` that nothing reads any more."""
    jvm, conf = written.sparkSession._jvm, written.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {os.path.dirname(f) for f in written.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def neutral(docs: DataFrame, *names: str | None) -> tuple[DataFrame, list[str | None]]:
    """``docs`` with its columns named by their number, so that none clashes with a name used inside, and the new names of ``names``."""
    new = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), [new.get(n) for n in names]


def as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in their order."""
    return rows.select(*[f"`{c}`" for c in docs.columns])
