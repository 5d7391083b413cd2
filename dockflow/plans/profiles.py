"""Daily station profiles: gap fill, wide form, vectors.

The working form is one row per station and date with an array of the 144 slots'
free docks (``stands``, NULL where a slot is missing).  The long form (number,
date, slot, available_stands) and 144 columns appear only where a caller asks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.operators.series import fill_arrays_across, fill_arrays_within
from dockflow.schemas import DAY_SLOTS

WEEKDAY_SET = ("Mon", "Tue", "Wed", "Thu")
WEEKEND_SET = ("Fri", "Sat", "Sun")
# fixed value: "Thur" matches no weekday, so Thursday falls out
LEGACY_WEEKDAY_SET = ("Mon", "Tue", "Wed", "Thur")

REPEATED = "a station has two rows for one date and slot; leave out the outdated name"


def without_names(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drops outdated station names (and rows without a name)."""
    if not names:
        return panel
    return panel.where(~F.col("name").isin(*names))


def on_weekdays(panel: DataFrame, weekdays: Sequence[str]) -> DataFrame:
    return panel.where(F.col("weekday").isin(*weekdays))


def cells(panel: DataFrame) -> DataFrame:
    """(number, date, slot, available_stands); a repeated cell is an error."""
    count, value = F.count(F.lit(1)), F.max("available_stands")
    return panel.groupBy("number", "date", "slot").agg(
        F.when(count > 1, F.raise_error(F.lit(REPEATED)).cast("int"))
        .otherwise(value)
        .alias("available_stands")
    )


def present_slots(panel: DataFrame) -> list[int]:
    """The slots that some row has a value for, in order: those of the vectors."""
    known = panel.where(F.col("available_stands").isNotNull()).select("slot").distinct()
    return sorted(r["slot"] for r in known.collect())  # at most 144


def days(panel: DataFrame) -> DataFrame:
    """number, date, stands: the cells of a day as an array over all slots."""
    cell = F.collect_list(F.struct("slot", "available_stands"))
    rows = panel.groupBy("number", "date").agg(cell.alias("_cells"))
    slots_ = F.transform("_cells", lambda c: c["slot"])
    repeated = F.size(F.array_distinct(slots_)) < F.size(slots_)
    known = F.map_from_entries(
        F.when(repeated, F.raise_error(F.lit(REPEATED)).cast(rows.schema["_cells"].dataType)).otherwise(F.col("_cells"))
    )
    rows = rows.withColumn("_cells", known)
    stands = F.transform(F.array(*map(F.lit, DAY_SLOTS)), lambda slot: F.try_element_at("_cells", slot))
    return rows.select("number", "date", stands.alias("stands"))


def filled_days(panel: DataFrame, across_stations: bool = True) -> DataFrame:
    """Days without gaps; by default the fill runs on from station to station."""
    fill = fill_arrays_across if across_stations else fill_arrays_within
    return fill(days(panel), "stands", len(DAY_SLOTS), "number", "date")


def long_of(daily: DataFrame) -> DataFrame:
    """number, date, slot, available_stands: a row per slot, missing ones too."""
    cells_ = F.arrays_zip(F.array(*map(F.lit, DAY_SLOTS)).alias("slot"), F.col("stands").alias("available_stands"))
    cell = lambda c: F.struct(c["slot"].alias("slot"), c["available_stands"].alias("available_stands"))
    return daily.select("number", "date", F.inline(F.transform(cells_, cell)))


def filled(panel: DataFrame, across_stations: bool = True) -> DataFrame:
    """The gap-filled profiles in long form."""
    return long_of(filled_days(panel, across_stations))


def wide_of(daily: DataFrame) -> DataFrame:
    """One row per station and date, one column per slot."""
    return daily.select("number", "date", *[F.get("stands", F.lit(i)).alias(slot_column(s)) for i, s in enumerate(DAY_SLOTS)])


def slot_column(slot: int) -> str:
    return f"{slot // 60}_{slot % 60:02d}_00"


def wide(long: DataFrame, slots: Sequence[int] = tuple(DAY_SLOTS)) -> DataFrame:
    """One row per station and date, one column per slot."""
    pivoted = long.groupBy("number", "date").pivot("slot", list(slots)).agg(F.max("available_stands"))
    return pivoted.withColumnsRenamed({str(s): slot_column(s) for s in slots})


def long_from_wide(table: DataFrame, slots: Sequence[int] = tuple(DAY_SLOTS)) -> DataFrame:
    """Wide profile back to (number, date, time, available_stands)."""
    names = [slot_column(s) for s in slots]
    melted = table.unpivot(["number", "date"], names, "time", "available_stands")
    return melted.withColumn("time", F.translate("time", "_", ":"))


def vectors(daily: DataFrame) -> DataFrame:
    """One ML vector per station and date, slots in order.

    A slot that no station ever has stays NULL in every row of a fill across
    stations; it has no value to compare and is left out.
    """
    known = F.filter("stands", lambda x: x.isNotNull())
    return daily.select("number", "date", array_to_vector(F.transform(known, lambda x: x.cast("double"))).alias("features"))


def station_profile(panel: DataFrame) -> DataFrame:
    """Mean free docks per station name and slot."""
    return panel.groupBy("number", "name", "slot").agg(F.avg("available_stands").alias("stands"))
