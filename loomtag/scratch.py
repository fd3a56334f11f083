"""Tables between the steps of a job, in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or _own_dirs.get(sc.applicationId)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-loomtag-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in a folder of this application below the shared one; the folder is deleted when the application ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/loomtag-{app}"
    if app not in _cleaned:
        fs, where = _hadoop(spark, root)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _cleaned.add(app)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what was written to path, when nothing reads it any more."""
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A small iteration frame, checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
