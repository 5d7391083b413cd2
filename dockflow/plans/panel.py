"""Snapshots to the 10-minute activity panel.

``snapshots``: number, name, address, bike_stands, available_bike_stands,
last_update (TIMESTAMP_NTZ) and any tiebreak columns.

One exchange of raw rows: each station's 10-minute slot becomes one row with its
snapshots as a sorted array.  Copies collapse in the map side, where the arrays
begin as sets, and again where the sets meet.

Skew: without copies a station holds at most a handful of rows per millisecond,
so a slot is bounded however many rows the station has in all.  The change into a
slot comes from the slot before; it is added on the rolled-up rows, of which a
station has at most 144 a day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dockflow.functions import calendar as cal
from dockflow.functions.flows import check_in, check_out

TIEBREAK = ("name", "address", "bike_stands", "available_bike_stands")
CHRONOLOGICAL = "chronological"
TEXT_HOUR = "legacy_text_hour"


def dedupe(snapshots: DataFrame) -> DataFrame:
    """Distinct rows; copies collapse before the shuffle."""
    return snapshots.distinct()


def quarantine(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): rows without a station, stock or time are rejected."""
    usable = (
        F.col("number").isNotNull()
        & F.col("available_bike_stands").isNotNull()
        & F.col("bike_stands").isNotNull()
        & F.col("last_update").isNotNull()
    )
    return snapshots.where(usable), snapshots.where(~usable)


def with_slot(snapshots: DataFrame) -> DataFrame:
    ts = F.col("last_update")
    return snapshots.withColumns({"date": F.to_date(ts), "slot": cal.slot_of(ts)})


def hour_order(hour: Column, order: str) -> Column:
    """Sort key of an hour within a day; the legacy order sorts it as text."""
    if order == CHRONOLOGICAL:
        return hour
    if order == TEXT_HOUR:
        return hour.cast("string")
    raise ValueError(f"unknown order {order!r}")


SLOT = ("number", "date", "slot")


def slots(snapshots: DataFrame, tiebreak: Sequence[str] = TIEBREAK, distinct: bool = True) -> DataFrame:
    """One row per station, date and slot with its snapshots (``rows``) in order."""
    rows, _ = quarantine(with_slot(snapshots))
    # stated here, not left to be inferred from a join: plans that read the
    # slots twice then have equal filters and share the shuffle
    rows = rows.where(F.col("date").isNotNull() & F.col("slot").isNotNull())
    first = ["last_update", *tiebreak]
    row = F.struct(*first, *[c for c in snapshots.columns if c not in (*first, "number")])
    held = F.collect_set(row) if distinct else F.collect_list(row)
    return rows.groupBy(*SLOT).agg(F.sort_array(held).alias("rows"))


def inside(slotted: DataFrame) -> DataFrame:
    """The snapshots again, with ``seat`` (place in the slot), ``change`` (since the
    one before in the slot; NULL for the first) and the slot's ``closing`` stock."""
    element = slotted.schema["rows"].dataType.elementType.names
    stock = "available_bike_stands"

    def row(x: Column, i: Column) -> Column:
        change = x[stock] - F.get("rows", i - 1)[stock]
        return F.struct(*[x[c].alias(c) for c in element], (i + 1).alias("seat"), change.alias("change"))

    closing = F.element_at("rows", -1)[stock].alias("closing")
    return slotted.select(*SLOT, closing, F.inline(F.transform("rows", row)))


def station_order(order: str) -> list[Column]:
    """Rolled-up rows of a station; the row that holds a slot's opening snapshot
    comes first within the slot."""
    hour = hour_order(cal.hour_of(F.col("slot")), order)
    return [F.col("date"), hour, F.col("slot"), F.col("opening").isNull(), F.col("name"), F.col("address")]


def entry(order: str) -> Column:
    """The change into a slot, on the row that holds its opening snapshot: the
    opening against the closing stock of the slot before."""
    station = W.partitionBy("number").orderBy(*station_order(order))
    return F.coalesce(F.col("opening") - F.lag("closing").over(station), F.lit(0))


def activity_panel(
    snapshots: DataFrame,
    order: str = CHRONOLOGICAL,
    tiebreak: Sequence[str] = TIEBREAK,
    distinct: bool = True,
) -> DataFrame:
    """One row per station name, address, date and 10-minute slot."""
    rows = inside(slots(snapshots, tiebreak, distinct))
    change, stock = F.col("change"), F.col("available_bike_stands")
    rolled = rows.groupBy("number", "name", "address", "date", "slot").agg(
        F.min("bike_stands").alias("bike_stands"),
        F.coalesce(F.sum("change"), F.lit(0)).alias("_diff"),
        F.sum(check_in(change)).alias("_in"),
        F.sum(check_out(change)).alias("_out"),
        F.max_by(stock, "seat").alias("available_stands"),
        F.max(F.when(F.col("seat") == 1, stock)).alias("opening"),
        F.max("closing").alias("closing"),
    )
    return rolled.withColumn("_entry", entry(order)).select(
        "number",
        "name",
        "address",
        "date",
        "slot",
        cal.time_text(F.col("slot")).alias("time"),
        cal.weekday_name(F.col("date")).alias("weekday"),
        "bike_stands",
        (F.col("_diff") + F.col("_entry")).cast("bigint").alias("prev_period_diff"),
        (F.col("_in") + check_in(F.col("_entry"))).cast("bigint").alias("check_in"),
        (F.col("_out") + check_out(F.col("_entry"))).cast("bigint").alias("check_out"),
        "available_stands",
    )


def snapshot_changes(
    snapshots: DataFrame,
    order: str = CHRONOLOGICAL,
    tiebreak: Sequence[str] = TIEBREAK,
    distinct: bool = True,
) -> DataFrame:
    """Every snapshot with its change, check-in, check-out and the station's first time.

    ``seat`` is its place within the station's slot.  The stock carried into a slot
    comes from a table of at most 144 rows per station and day, joined on the keys
    by which the slots already lie.
    """
    slotted = slots(snapshots, tiebreak, distinct)
    station = W.partitionBy("number")
    edge = lambda i, c: F.element_at("rows", i)[c]
    hour = hour_order(cal.hour_of(F.col("slot")), order)
    carried = slotted.select(
        *SLOT, edge(1, "last_update").alias("_first"), edge(1, "available_bike_stands").alias("_opening"),
        edge(-1, "available_bike_stands").alias("_closing"),
    ).select(
        *SLOT,
        (F.col("_opening") - F.lag("_closing").over(station.orderBy("date", hour, "slot"))).alias("_entry"),
        F.min("_first").over(station).alias("first_update"),
    )
    change = F.coalesce("change", "_entry", F.lit(0)).cast("bigint")
    return (
        inside(slotted)
        .join(carried, list(SLOT))
        .withColumn("prev_period_diff", change)
        .withColumn("check_in", check_in(F.col("prev_period_diff")))
        .withColumn("check_out", check_out(F.col("prev_period_diff")))
        .drop("change", "closing", "_entry")
    )


def study_period(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Dates from start to end, both included."""
    return panel.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def half_open_period(panel: DataFrame, start: str, end: str) -> DataFrame:
    day = F.col("date")
    return panel.where((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))


def from_date(panel: DataFrame, start: str) -> DataFrame:
    return panel.where(F.col("date") >= F.lit(start).cast("date"))
