"""File readers with declared schemas: no inference pass, stable types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.functions.calendar import from_epoch_millis
from dockflow.schemas import SNAPSHOT_CSV, SNAPSHOT_JSON, STATION_CSV, WEATHER_CSV, WEATHER_EVERY_CSV


#: Holds the text of a record that does not fit the schema.
CORRUPT = "_corrupt"


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad records with the file they come from) of a reader's rows
    with ``keep_corrupt``."""
    # Spark parses the columns that are asked for, and a line is judged by these: an
    # empty piece of every column makes it read them all
    whole = F.concat_ws("", *[F.substring(F.col(c).cast("string"), 1, 0) for c in rows.columns if c not in (CORRUPT, "file")]) == ""
    bad = rows.where(F.col(CORRUPT).isNotNull() & whole)
    return rows.where(F.col(CORRUPT).isNull() & whole).drop(CORRUPT, "file"), bad.select("file", F.col(CORRUPT).alias("record"))


def _read(spark: SparkSession, schema, keep_corrupt: bool):
    if not keep_corrupt:
        return spark.read.schema(schema)
    wider = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(wider).option("columnNameOfCorruptRecord", CORRUPT)


def _with_file(df: DataFrame, keep_corrupt: bool) -> DataFrame:
    return df.withColumn("file", F.col("_metadata.file_path")) if keep_corrupt else df


def snapshots_json(
    spark: SparkSession, path: str | Sequence[str], flatten: bool = True, multi_line: bool = True, keep_corrupt: bool = False
) -> DataFrame:
    """All JSON files of a folder, each an array of station objects.

    ``multi_line=False`` reads one object per line, which splits large files.
    With ``keep_corrupt``, records that are no such object stay, to be told apart
    by :func:`split_corrupt`.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = _with_file(_read(spark, SNAPSHOT_JSON, keep_corrupt).option("multiLine", multi_line).json(paths), keep_corrupt)
    if flatten:
        df = df.select(
            *SNAPSHOT_CSV.names,
            F.col("position.lat").alias("position_lat"),
            F.col("position.lng").alias("position_lng"),
            *[c for c in (CORRUPT, "file") if keep_corrupt],
        )
    return with_timestamps(df)


def snapshots_csv(spark: SparkSession, path: str, skip_first: bool = False, keep_corrupt: bool = False) -> DataFrame:
    """All CSV dumps of a folder, or one file; optionally without the first by name,
    and with the lines that do not fit the schema (see :func:`split_corrupt`)."""
    df = _read(spark, SNAPSHOT_CSV, keep_corrupt).option("header", True).csv(path)
    if skip_first:
        # a listing, found when the rows are read: the content column is pruned
        files = spark.read.format("binaryFile").load(path).select("path")
        df = df.where(F.col("_metadata.file_path") != files.agg(F.min("path")).scalar())
    return with_timestamps(_with_file(df, keep_corrupt))


def with_timestamps(raw: DataFrame) -> DataFrame:
    return raw.withColumn("last_update", from_epoch_millis(F.col("last_update")))


def stations(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(STATION_CSV).option("header", True).csv(path)
    return df.toDF(*[c.lower() for c in df.columns])


def weather_hourly(spark: SparkSession, path: str, every_element: bool = False) -> DataFrame:
    """Hourly weather; the header is skipped because it repeats a name.

    Files that hold every element of the code book, with wind, weather codes, sun,
    visibility and clouds, are read with ``every_element``.
    """
    schema = WEATHER_EVERY_CSV if every_element else WEATHER_CSV
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return df.withColumn("date", F.col("date").try_cast("timestamp_ntz"))
