"""Tables written on the way: into the folder that driver and executors share, in columns, deleted when they are spent."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set a temporary one, but only of a local master."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return at
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return sc.getCheckpointDir()


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet; what is written there goes with the session."""
    path = f"{shared_dir(spark).rstrip('/')}/lectern-{uuid.uuid4().hex}"
    at = _path(spark, path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)  # only what is there is deleted on exit
    files.deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = _path(spark, path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def store(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df and read it from there: it is computed once and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_table = path
    return out


def release(*stored: DataFrame) -> None:
    """Delete tables of store that nothing reads any more."""
    for df in stored:
        delete(df.sparkSession, df._lectern_table)
