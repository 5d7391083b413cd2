"""Order-dependent operators: gap fill and sums that reset at zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fill_within(grid: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """Previous non-NULL value per key; a leading gap takes the next one.

    For keys whose row count is bounded (one station and slot: its days).
    """
    rows = W.partitionBy(*keys).orderBy(order)
    prior = F.last(value, ignorenulls=True).over(rows.rowsBetween(W.unboundedPreceding, 0))
    lead = F.first(value, ignorenulls=True).over(
        rows.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    return grid.withColumn(value, F.coalesce(prior, lead))


def fill_across(
    grid: DataFrame, value: str, column: str, outer: str, inner: str, block: int = 4096
) -> DataFrame:
    """Gap fill down each ``column`` over rows sorted by (outer, inner).

    The fill runs on from one outer key (station) into the next.  Sorting a
    whole column in one task would not scale, so it is done in three levels:
    inside an outer key, over the outer keys of a block, over the blocks.
    A gap at the top of the column takes the column's first value.
    """
    past = (W.unboundedPreceding, -1)
    rows = W.partitionBy(column, outer).orderBy(inner)
    whole = rows.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = grid.withColumns(
        {
            "_own": F.last(value, ignorenulls=True).over(rows.rowsBetween(W.unboundedPreceding, 0)),
            "_tail": F.last(value, ignorenulls=True).over(whole),
            "_head": F.first(value, ignorenulls=True).over(whole),
            "_closes": F.lead(F.lit(1)).over(rows).isNull(),
            "_block": F.floor(F.col(outer) / F.lit(block)),
        }
    )

    # one row per column and outer key, read off the same shuffled rows
    tails = filled.where("_closes").select(column, outer, "_block", "_tail", "_head")
    in_block = W.partitionBy(column, "_block").orderBy(outer).rowsBetween(*past)
    near = tails.select(
        column, outer, "_block", F.last("_tail", ignorenulls=True).over(in_block).alias("_near")
    )
    at_tail = F.when(F.col("_tail").isNotNull(), F.col(outer))
    blocks = tails.groupBy(column, "_block").agg(
        F.max_by("_tail", at_tail).alias("_tail"), F.min_by("_head", at_tail).alias("_head")
    )
    over = W.partitionBy(column).orderBy("_block")
    far = blocks.select(
        column,
        "_block",
        F.last("_tail", ignorenulls=True).over(over.rowsBetween(*past)).alias("_far"),
        F.first("_head", ignorenulls=True)
        .over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        .alias("_top"),
    )
    carry = near.join(far, [column, "_block"]).select(
        column, outer, F.coalesce("_near", "_far", "_top").alias("_carry")
    )
    return (
        filled.drop("_tail", "_head", "_closes", "_block")
        .join(carry, [column, outer])
        .withColumn(value, F.coalesce("_own", "_carry"))
        .drop("_own", "_carry")
    )


def each_known(value: str, size: int, known) -> Column:
    """An array from an expression per element of the array ``value``."""
    return F.array(*[known(F.get(value, F.lit(i))) for i in range(size)])


def first_known(*arrays: Column | str) -> Column:
    """Element by element the first value that is not NULL."""
    first, *rest = [F.col(a) if isinstance(a, str) else a for a in arrays]
    for other in rest:
        first = F.zip_with(first, other, lambda x, y: F.coalesce(x, y))
    return first


def fill_arrays_within(rows: DataFrame, value: str, size: int, outer: str, inner: str) -> DataFrame:
    """Gap fill in arrays of ``size``, element by element down the rows of an outer
    key: the previous known element; a leading gap takes the next one."""
    ordered = W.partitionBy(outer).orderBy(inner)
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own = each_known(value, size, lambda x: F.last(x, ignorenulls=True).over(so_far))
    head = each_known(value, size, lambda x: F.first(x, ignorenulls=True).over(whole))
    return rows.withColumns({"_own": own, "_head": head}).withColumn(value, first_known("_own", "_head")).drop("_own", "_head")


def fill_arrays_across(rows: DataFrame, value: str, size: int, outer: str, inner: str, block: int = 4096) -> DataFrame:
    """The same over rows sorted by (outer, inner): the fill runs on from one outer
    key into the next, and a gap at the top takes the element's first value.

    An array of last known elements is carried inside an outer key, over the outer
    keys of a block, and over the blocks; no task sees all rows.
    """
    past = (W.unboundedPreceding, -1)
    ordered = W.partitionBy(outer).orderBy(inner)
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    last_of = lambda name, over: each_known(name, size, lambda x: F.last(x, ignorenulls=True).over(over))
    filled = rows.withColumns(
        {
            "_own": last_of(value, so_far),
            "_row": F.row_number().over(ordered),
            "_block": F.floor(F.col(outer) / F.lit(block)),
        }
    )
    # one row per outer key: its last known and its first known elements
    first_at = lambda x: F.min_by(x, F.when(x.isNotNull(), F.col("_row")))
    tails = filled.groupBy("_block", outer).agg(
        F.max_by("_own", "_row").alias("_tail"), each_known("_own", size, first_at).alias("_head")
    )
    in_block = W.partitionBy("_block").orderBy(outer).rowsBetween(*past)
    near = tails.select("_block", outer, last_of("_tail", in_block).alias("_near"))
    key = F.col(outer)
    blocks = tails.groupBy("_block").agg(
        each_known("_tail", size, lambda x: F.max_by(x, F.when(x.isNotNull(), key))).alias("_tail"),
        each_known("_head", size, lambda x: F.min_by(x, F.when(x.isNotNull(), key))).alias("_head"),
    )
    over = W.partitionBy(F.lit(0)).orderBy("_block")
    first = each_known("_head", size, lambda x: F.first(x, ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    far = blocks.select("_block", last_of("_tail", over.rowsBetween(*past)).alias("_far"), first.alias("_top"))
    carry = near.join(far, "_block").select(outer, first_known("_near", "_far", "_top").alias("_carry"))
    return (
        filled.join(carry, outer)
        .withColumn(value, first_known("_own", "_carry"))
        .drop("_own", "_row", "_block", "_carry")
    )


def reset_sum(value: str, keys: Sequence[str], order: Sequence[str]) -> tuple[Column, Column]:
    """(island, running sum) expressions; use through :func:`with_reset_sum`."""
    rows = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    island = F.sum(F.when(F.col(value) == 0, 1).otherwise(0)).over(rows)
    inside = W.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return island, F.sum(value).over(inside)


def with_reset_sum(
    df: DataFrame, value: str, name: str, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Running sum that starts again wherever the value is zero."""
    island, running = reset_sum(value, keys, order)
    return df.withColumn("_island", island).withColumn(name, running).drop("_island")
