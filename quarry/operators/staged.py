"""Tables written to the folder that all executors share, read back as they were fixed by the write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder in use; one of this machine only where the master is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    in_use = sc._jsc.sc().getCheckpointDir()
    if in_use.isDefined():
        return in_use.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quarry-")
    sc.setCheckpointDir(made)
    return made


def staged(df: DataFrame, *sort: str) -> DataFrame:
    """The rows of df, written once; with `sort`, in that order within files, so that filters skip row groups."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of few partitions dealt to all cores; one that has enough is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
