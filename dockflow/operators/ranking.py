"""Top-n with ties, exact quantiles and global row positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from dockflow.operators.keys import null_safe_join


def top_n(df: DataFrame, n: int, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is among the n largest (n < 0: smallest), ties kept.

    Only the n-th value is looked for in sorted order; the rows themselves are
    then filtered where they are, so a tie of any size never meets in one task.
    NULL values are never selected.
    """
    k, keep = abs(n), F.col(value).isNotNull()
    order = F.col(value).desc() if n > 0 else F.col(value).asc()
    edge = F.min(value) if n > 0 else F.max(value)
    known = df.where(keep)
    if not by:
        limit = known.select(value).orderBy(order).limit(k).agg(edge).scalar()
        return known.where(_reaches(F.col(value), limit, n))
    if k == 1:
        best = F.max(value) if n > 0 else F.min(value)
        edges = known.groupBy(*by).agg(best.alias("_edge"))
    else:
        # row_number() <= k lets Spark cut each map task's groups to k rows
        seat = F.row_number().over(W.partitionBy(*by).orderBy(order))
        firsts = known.select(*by, value, seat.alias("_seat")).where(F.col("_seat") <= k)
        edges = firsts.groupBy(*by).agg(edge.alias("_edge"))
    joined = null_safe_join(known, edges, by)
    return joined.where(_reaches(F.col(value), F.col("_edge"), n)).drop("_edge")


def _reaches(value: Column, edge: Column, n: int) -> Column:
    return value >= edge if n > 0 else value <= edge


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], splits: int = 100
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    A group may hold any share of the rows.  Equal values are counted first,
    a quantile sketch cuts each group's value range into about ``splits`` even
    pieces, and only running counts inside a piece and over the pieces are
    sorted.  The sketch steers the work; the result does not depend on it.
    """
    keys = list(by) or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    source = source.where(F.col(value).isNotNull())
    counts = source.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    cuts = [i / splits for i in range(1, splits)]
    bounds = counts.groupBy(*keys).agg(
        F.sum("_c").alias("_n"),
        F.percentile_approx("_v", cuts, 20 * splits).alias("_cuts"),
    )
    placed = counts.join(bounds, keys).withColumn(
        "_piece", F.size(F.filter("_cuts", lambda cut: cut < F.col("_v")))
    )
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = (
        placed.groupBy(*keys, "_piece")
        .agg(F.sum("_c").alias("_size"))
        .select(*keys, "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    inside = (
        W.partitionBy(*keys, "_piece").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    ranked = (
        placed.withColumn("_upto", F.sum("_c").over(inside))
        .join(pieces, [*keys, "_piece"])
        .withColumn("_end", F.col("_before") + F.col("_upto"))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )

    def seat(p: float) -> Column:
        return (F.col("_n") - 1) * F.lit(float(p))

    def at(row: Column) -> Column:
        return F.max(F.when((F.col("_start") <= row) & (row < F.col("_end")), F.col("_v")))

    found = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[at(F.floor(seat(p))).alias(f"_lo_{name}") for name, p in probs.items()],
        *[at(F.ceil(seat(p))).alias(f"_hi_{name}") for name, p in probs.items()],
    )
    out = []
    for name, p in probs.items():
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (seat(p) - F.floor(seat(p)))).alias(name))
    return found.select(*by, *out)


def row_index(df: DataFrame, key: str, order: Sequence[str], block: int = 4096) -> DataFrame:
    """Adds ``row_index``, the 1-based position in (key, order) order, and ``row_count``.

    Rows are numbered per key; key offsets come from running counts inside
    blocks of keys and over the blocks.  With an int key the last window sees
    at most 2^32 / block rows.
    """
    counts = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_block", F.floor(F.col(key) / F.lit(block)))
    )
    in_block = W.partitionBy("_block").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    # one constant key instead of none: the input is block totals, see above
    everything = W.partitionBy(F.lit(0))
    over_blocks = everything.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        counts.groupBy("_block")
        .agg(F.sum("_n").alias("_total"))
        .select(
            "_block",
            F.coalesce(F.sum("_total").over(over_blocks), F.lit(0)).alias("_blocks"),
            F.sum("_total").over(everything).alias("row_count"),
        )
    )
    offsets = (
        counts.withColumn("_inner", F.coalesce(F.sum("_n").over(in_block), F.lit(0)))
        .join(blocks, "_block")
        .select(key, (F.col("_inner") + F.col("_blocks")).alias("_offset"), "row_count")
    )
    seat = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return (
        df.withColumn("_seat", seat)
        .join(offsets, key)
        .withColumn("row_index", (F.col("_seat") + F.col("_offset")).cast(T.LongType()))
        .drop("_seat", "_offset")
    )
