"""Row layout for steps whose cost is not in their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions, by a hash of the keys.

    Adaptive execution merges partitions by size.  Before a CPU-heavy step on
    small rows (formulas, model fits) that would leave most cores idle.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys)
