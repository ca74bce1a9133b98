"""Versions of a stored table.

Data folders are written first and are visible to nobody. A manifest that names the folders of the next version is then put
in place by one rename that fails if that version exists already, so a reader sees one version or the next and never parts of
both, and of two writers that began with the same version one gets a conflict. Folders that no version names any more
stay until they are removed by hand, so readers of an older version can finish.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

VERSIONS, DATA = "_versions", "data"


class Conflict(RuntimeError):
    """Another writer has committed since the version this write began with."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """Number and entries of the latest version; 0 and none if there is no version."""
    folder, files = _files(spark, f"{path}/{VERSIONS}")
    if not files.exists(folder):
        return 0, []
    numbers = [int(name[:-5]) for name in (s.getPath().getName() for s in files.listStatus(folder)) if name.endswith(".json") and not name.startswith(".")]
    return (0, []) if not numbers else (max(numbers), entries(spark, path, max(numbers)))


def entries(spark: SparkSession, path: str, version: int) -> list[dict]:
    """What a version consists of: data folders with the properties they were committed with."""
    place, files = _files(spark, f"{path}/{VERSIONS}/{version:08d}.json")
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def new_folder() -> str:
    """A name for the data of one write, below the table's path."""
    return f"{DATA}/{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, wanted: list[dict], before: int) -> int:
    """Make ``wanted`` the version after ``before``; raises :class:`Conflict` if there is one already."""
    name = f"{path}/{VERSIONS}/{before + 1:08d}.json"
    staged, files = _files(spark, f"{path}/{VERSIONS}/.{uuid.uuid4().hex}")
    stream = files.create(staged, False)
    stream.write(bytearray(json.dumps(wanted).encode()))
    stream.close()
    jvm = spark._jvm
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration()) if staged.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    try:
        context.rename(staged, _files(spark, name)[0], never)
    except Py4JJavaError as error:
        files.delete(staged, False)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass()):
            raise Conflict(f"version {before + 1} of {path} exists already") from None
        raise
    return before + 1


def read(spark: SparkSession, path: str, version: int | None = None, **properties: str) -> DataFrame | None:
    """The rows of a version (the latest by default) whose folders have the given properties; None if there are none."""
    known = latest(spark, path)[1] if version is None else entries(spark, path, version)
    folders = [f"{path}/{e['folder']}" for e in known if all(e.get(k) == v for k, v in properties.items())]
    return spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None
