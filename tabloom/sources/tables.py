"""Reading the tables of a data folder, and writing those that several jobs read to the shared folder."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table `table` of a folder; any file system that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder shared by driver and executors that the session names; a folder of our own only where it names none and
    driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return qualified(spark, f"{base.rstrip('/')}/tabloom")


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark takes it to have: the session's own file system if it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: Bytes of a row group of a written table: what a writing task buffers.
ROW_GROUP_BYTES = 16 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later jobs start from its files, so a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    jvm = spark._jvm
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs. It acts when the driver's garbage is collected: once
    for what Python and the last job's events hold on to, and again when these are gone."""
    for pause in (0.5, 0.1):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)
