"""Audit of exact copies among the snapshots.

A group of copies may hold any share of the rows: it is always counted with
partial aggregation, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.functions.calendar import weekday_name

COPIES_PER_ROW = 100_000


def duplicate_groups(snapshots: DataFrame) -> DataFrame:
    """Each repeated row once with ``copies``, the occurrences after the first."""
    columns = snapshots.columns
    counted = snapshots.groupBy(*columns).agg((F.count(F.lit(1)) - 1).alias("copies"))
    return counted.where(F.col("copies") > 0)


def duplicate_rows(snapshots: DataFrame) -> DataFrame:
    """The second and later occurrences as rows, flagged ``duplicate``.

    Copies of one row are written out in chunks spread over all tasks.
    """
    per = COPIES_PER_ROW
    chunks = duplicate_groups(snapshots).withColumn(
        "_start", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(per)))
    )
    size = F.least(F.lit(per), F.col("copies") - F.col("_start"))
    spread = chunks.withColumn("_size", size.cast("int")).repartition("_start", *snapshots.columns)
    return (
        spread.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_size"))))
        .drop("_start", "_size", "_copy", "copies")
        .withColumn("duplicate", F.lit(True))
    )


def multiplicity(snapshots: DataFrame) -> DataFrame:
    """Duplicate rows per station name and moment."""
    ts = F.col("last_update")
    day = F.to_date(ts)
    return (
        duplicate_groups(snapshots)
        .groupBy("number", "name", "last_update")
        .agg(F.sum("copies").alias("count"))
        .withColumns(
            {
                "year": F.year(ts),
                "month": F.month(ts),
                "day": F.dayofmonth(ts),
                "weekday": weekday_name(day),
            }
        )
    )


def repeated_more_than_once(snapshots: DataFrame) -> DataFrame:
    return multiplicity(snapshots).where(F.col("count") > 1)


def bars(snapshots: DataFrame) -> DataFrame:
    """Number of duplicate groups by station, day, month and weekday."""
    facts = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value"))
            for name in ("number", "day", "month", "weekday")
        ]
    )
    return (
        multiplicity(snapshots)
        .select(F.explode(facts).alias("bar"))
        .groupBy("bar.dimension", "bar.value")
        .agg(F.count(F.lit(1)).alias("groups"))
    )
