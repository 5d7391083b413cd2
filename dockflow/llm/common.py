"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockflow.session import shared_dir

#: White space between words: space, tab, line feed, vertical tab, form feed, return.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


#: Drops the shuffle files of an execution at its end (Spark 4.1).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: later steps no longer depend on
    the work before, so a lost executor costs only its running tasks, and the
    shuffle files of that work can go at once."""
    spark = df.sparkSession
    path, before = shared_dir(spark), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    rows = spark.read.schema(df.schema).parquet(path)
    rows._folder = path
    return rows


def discard(*frames: DataFrame) -> None:
    """Remove the folders of frames from ``materialise`` that nothing reads any more;
    other frames stay as they are."""
    for df in frames:
        if folder := vars(df).get("_folder"):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """Words as an array; none for NULL, empty or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def number_within(df: DataFrame, key: str, order: list[str], out: str, rows_per_cell: int = 20_000) -> DataFrame:
    """Positions 0, 1, 2... inside each key, without one task per key.

    Rows are dealt into cells by a hash of their order columns and of their place
    in ``df``, a written table; counts per cell give offsets, and only a cell is
    sorted, also where many rows are equal.  ``key`` is not NULL.
    """
    cells = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows_per_cell)).cast("int")
    n = df.agg(cells.alias("n")).first()["n"]
    placed = df.withColumn("_row", F.monotonically_increasing_id())
    placed = placed.withColumn("_cell", F.pmod(F.xxhash64(*order, "_row"), F.lit(n)))
    by_key = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(key, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(by_key), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(key, "_cell").orderBy(*order, "_row")
    return (
        placed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, [key, "_cell"])
        .withColumn(out, F.col("_before") + F.col("_rank"))
        .drop("_cell", "_rank", "_before", "_row")
    )
