"""Intermediate tables in the folder that all executors share, for loops whose lineage would grow without end."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.match(r"local($|\[)", sc.master):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
    if not getattr(sc, "_sparkloom_dir", None):  # one machine: any folder is shared
        sc._sparkloom_dir = tempfile.mkdtemp(prefix="sparkloom-")
    return sc._sparkloom_dir


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one: what it leaves there is deleted with it, by clear() or from outside."""
    return f"{shared_dir(spark)}/sparkloom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """All intermediate tables of this application go; no DataFrame made before may be used after."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as a written table: its plan starts anew, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
