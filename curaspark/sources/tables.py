"""Reading parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """A parquet table. ``wide`` prepares it for work that is heavy per row, such as parsing long texts.

    A table of few row groups gives fewer scan tasks than the cluster has cores. Only then are its rows dealt out
    anew, after column pruning; a table with enough splits is left as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if wide and df.rdd.getNumPartitions() * 2 <= cores:
        return df.repartition(cores)
    return df
