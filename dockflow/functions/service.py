"""Forecast band, stock verdict and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVE_TOTAL = 50_000


def upper_band(pred: Column, error: Column) -> Column:
    return pred + error


def lower_band(pred: Column, error: Column) -> Column:
    return F.when(pred - error < 0, F.lit(0.0)).otherwise(pred - error)


def verdict(actual: Column, low: Column, high: Column) -> Column:
    """NULL if a number is missing."""
    known = actual.isNotNull() & low.isNotNull() & high.isNotNull()
    return (
        F.when(known & (actual <= high) & (actual >= low), "Sufficient")
        .when(known & (actual > high), "Oversupply")
        .when(known, "Insufficient")
    )


def gap_size(label: Column, actual: Column, low: Column, high: Column) -> Column:
    """Distance to the violated bound, 3 where none is violated, NULL without a label."""
    return (
        F.when(label == "Oversupply", F.abs(actual - high))
        .when(label == "Insufficient", F.abs(actual - low))
        .when(label.isNotNull(), F.lit(3.0))
    )


def station_range(number: Column) -> Column:
    return (
        F.when(number < 26, "1-25")
        .when(number < 51, "26-50")
        .when(number < 76, "51-75")
        .when(number >= 76, "76-102")
    )


def activity_label(total: Column, threshold: int = ACTIVE_TOTAL) -> Column:
    return F.when(total > threshold, "Most Active").when(total <= threshold, "Least Active")


def plain_number(value: Column) -> Column:
    """Number as text without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def error_label(error: Column) -> Column:
    return F.concat(F.lit("Error margin: "), plain_number(F.bround(error, 2)))


def error_range_label(error: Column) -> Column:
    return F.concat(F.lit("Error range: "), plain_number(F.bround(error * 2)), F.lit(" bikes"))


def squared_error(actual: Column, pred: Column) -> Column:
    return (actual - pred) * (actual - pred)


def rmse(actual: Column, pred: Column) -> Column:
    return F.sqrt(F.avg(squared_error(actual, pred)))


def rmsle(actual: Column, pred: Column) -> Column:
    return F.sqrt(F.avg(squared_error(F.log1p(actual), F.log1p(pred))))
