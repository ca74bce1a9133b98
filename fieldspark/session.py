"""Session helpers: a tuned builder and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: set[str] = set()


def build_session(app: str = "fieldspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on; pass ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {name.replace("__", "."): value for name, value in conf.items()}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests, a temporary folder is created and remembered on the session.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.conf.get("spark.fieldspark.scratch", None)
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors of {master} share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.fieldspark.scratch", configured)
    return configured


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one job's files."""
    import uuid

    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def batches_by_rows(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """For jobs run inside, Arrow batches are bounded by their rows alone. A bound on bytes has Spark add up the size of all columns' buffers for every row."""
    before = {name: spark.conf.get(name, None) for name in (BATCH_ROWS, BATCH_BYTES)}
    spark.conf.set(BATCH_BYTES, str((1 << 31) - 1))
    if rows:
        spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss because the data sits in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Ship the package to the Python workers once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), f"fieldspark-{context.applicationId}")
    context.addPyFile(shutil.make_archive(base, "zip", root, "fieldspark"))  # Spark serves it to the executors
    _SHIPPED.add(context.applicationId)
