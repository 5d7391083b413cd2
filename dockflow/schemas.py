"""Declared schemas and the fixed value sets of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Ordered categories.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
WEEKEND = ["Sat", "Sun"]
SEASONS = ["Winter", "Spring", "Summer", "Autumn"]
DAY_PARTS = ["Morning", "Afternoon", "Night", "Late night"]
VERDICTS = ["Sufficient", "Oversupply", "Insufficient"]

# Study periods.  The year is closed on both ends, the unseen
# week is half open.
STUDY_YEAR = ("2016-10-14", "2017-10-14")
UNSEEN_WEEK = ("2017-11-06", "2017-11-13")

SLOT_MINUTES = 10
DAY_SLOTS = list(range(0, 24 * 60, SLOT_MINUTES))
HALF_HOURS = [f"{h:02d}:{m:02d}" for h in range(24) for m in (0, 30)]


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# One poll of one station as the CSV dumps hold it; last_update is epoch ms.
SNAPSHOT_CSV = _schema(
    number=T.IntegerType(),
    name=T.StringType(),
    address=T.StringType(),
    bike_stands=T.IntegerType(),
    available_bike_stands=T.IntegerType(),
    last_update=T.LongType(),
)

# The JSON files carry a nested position as well.
SNAPSHOT_JSON = T.StructType(
    SNAPSHOT_CSV.fields
    + [T.StructField("position", _schema(lat=T.DoubleType(), lng=T.DoubleType()))]
)

STATION_CSV = _schema(
    Number=T.IntegerType(),
    Name=T.StringType(),
    Address=T.StringType(),
    Latitude=T.DoubleType(),
    Longitude=T.DoubleType(),
)

# The hourly weather header repeats "ind"; the position decides which is which.
WEATHER_CSV = _schema(
    date=T.StringType(),
    ind=T.IntegerType(),
    rain=T.DoubleType(),
    ind_1=T.IntegerType(),
    temp=T.DoubleType(),
    ind_2=T.IntegerType(),
    wetb=T.DoubleType(),
    dewpt=T.DoubleType(),
    vappr=T.DoubleType(),
    rhum=T.DoubleType(),
    msl=T.DoubleType(),
)

# The elements that follow in files with all of the code book.  Wind
# speed and direction have an indicator each; the weather codes ww and w do not.
WEATHER_EVERY_CSV = T.StructType(
    WEATHER_CSV.fields
    + _schema(
        ind_3=T.IntegerType(),
        wdsp=T.DoubleType(),
        ind_4=T.IntegerType(),
        wddir=T.DoubleType(),
        ww=T.IntegerType(),
        w=T.IntegerType(),
        sun=T.DoubleType(),
        vis=T.DoubleType(),
        clht=T.DoubleType(),
        clamt=T.IntegerType(),
    ).fields
)

CLUSTERS = _schema(number=T.IntegerType(), name=T.StringType(), cluster=T.StringType())
CENTRES = _schema(cluster=T.IntegerType(), slot=T.IntegerType(), available_stands=T.DoubleType())
