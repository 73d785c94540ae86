"""Table readers: one Parquet file or folder per table, columns pruned at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Read ``<folder>/<name>.parquet``; with ``columns`` only those reach the scan."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores, dealt out to all cores; larger scans stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_spread(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """``read_table`` for tables whose rows are costly to work on."""
    return spread(read_table(spark, folder, name, *columns))
