"""Tables written to the folder that all machines share, which is how lineage is cut."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@functools.cache
def _own_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='lacuna-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  One process alone (tests) may do without and gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.match(r"local(\[|$)", sc.master):
        return _own_folder(sc.applicationId)
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def new_path(spark: SparkSession) -> str:
    """A place in the shared folder that goes when the application ends."""
    path = f"{shared_folder(spark)}/lacuna-{uuid.uuid4().hex}"
    fs, place = _file_system(spark, path)
    fs.deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a written table; what reads them no longer depends on the executors that made them."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it, wherever it lies."""
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Remove tables that stored() gave, once nothing reads them any more."""
    for t in tables:
        if path := _paths.pop(t, None):
            remove(t.sparkSession, path)
