"""Stock change expressions.

A check-in is an *increase of free docks* and a check-out a decrease; bikes in
place are capacity minus free docks.  The names follow the reference data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_in(change: Column) -> Column:
    return F.when(change > 0, change).otherwise(F.lit(0))


def check_out(change: Column) -> Column:
    return F.when(change < 0, F.abs(change)).otherwise(F.lit(0))


def activity() -> Column:
    return F.col("check_in") + F.col("check_out")


def occupancy() -> Column:
    return F.col("bike_stands") - F.col("available_stands")
