"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where unset, a folder of this machine in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="windspark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables of each application, by its id, for :func:`clear`.
_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, so that lost executors do not change what random or partition numbers it holds."""
    path = f"{shared_folder(df.sparkSession)}/windspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this application has written, once no result that reads them is needed; returns their number."""
    sc = spark.sparkContext
    paths = _WRITTEN.pop(sc.applicationId, [])
    for p in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
