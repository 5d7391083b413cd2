"""Stage tables: the hand-off between jobs, and the per-cluster export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.schemas import CLUSTERS


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet with one folder per partition value.

    Rows are rebalanced by partition value: a small day ends in one file, a huge
    one is split over several tasks, and no task writes a file to every day.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_cluster_csv(clusters: DataFrame, path: str) -> None:
    """One folder of CSV per cluster holding the distinct number and name."""
    rows = clusters.select("number", "name", "cluster").distinct()
    rows.write.mode("overwrite").option("header", True).partitionBy("cluster").csv(path)


def read_cluster_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(CLUSTERS).option("header", True).csv(path)
    return df.select("number", "name", F.col("cluster").cast("string"))
