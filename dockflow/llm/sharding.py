"""Sharding by a minimax contiguous partition.

Equal texts are one group, never cut; groups are ordered by their smallest id.
The shard capacity is the smallest with which a greedy walk over the group sizes
needs no more than the given number of shards, found by binary search.  The
groups never meet on the driver: running sums are made per range of groups, and
the search sees only one sum per cell of a fixed number of cells.  Where a cell
hides a cut, the cells that can hold it are looked up again in finer ones, until
both bounds of the search agree; so the capacity is exact.  Of the cuts that keep
to this capacity those are taken that are nearest to equal shares: bounds from the
right say how far a shard must reach, the capacity how far it may.

Defined cases: NULL texts have no bytes and belong to the group of the empty
text; repeated rows belong to one group; rows with a NULL id come first; only
doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.llm.common import materialise, number_within

CELLS = 1 << 16  # sums that a look at the groups brings to the driver
ROW_BYTES = 16  # each row's own part of its size


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the digest that equal texts share."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("digest"),
    )


def with_running_sums(groups: DataFrame) -> DataFrame:
    """Adds ``below`` and ``rows_below``: sums of size and rows over all groups before."""
    spread = groups.repartitionByRange("first_doc", "digest").sortWithinPartitions("first_doc", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), [0, 0]
        for batch in batches:
            columns = list(batch.columns)
            for k, name in enumerate(("size", "rows")):
                values = batch.column(name).to_numpy()
                ends = sums[k] + np.cumsum(values)
                columns.append(pa.array(ends - values, pa.int64()))
                sums[k] = int(ends[-1]) if len(ends) else sums[k]
            columns.append(pa.array(np.full(batch.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "b", "r", "part"])

    schema = T.StructType([*spread.schema.fields]).add("b", "long").add("r", "long").add("part", "integer")
    # written, so that every later look sees the same ranges
    summed = materialise(spread.mapInArrow(run, schema))
    parts = summed.groupBy("part").agg(F.max(F.col("b") + F.col("size")).alias("b0"), F.max(F.col("r") + F.col("rows")).alias("r0"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "part", F.coalesce(F.sum("b0").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r0").over(before), F.lit(0)).alias("r0")
    )
    rows = summed.join(F.broadcast(offsets), "part")  # one row per range of groups
    return rows.select(*groups.columns, (F.col("b") + F.col("b0")).alias("below"), (F.col("r") + F.col("r0")).alias("rows_below"))


class Ends:
    """What is known of the sums at which groups end: some of them, and the
    stretches between two of them that hide others."""

    def __init__(self, total: int):
        self.known = np.array([0, total], np.int64)
        self.hides = np.array([True])

    def refine(self, groups: DataFrame, stretches: np.ndarray) -> None:
        """Look into the given stretches, at CELLS sums in all."""
        low, high = self.known[stretches], self.known[stretches + 1]
        each = max(2, CELLS // len(low))
        width = np.maximum(1, -(-(high - low) // each))
        end = F.col("below") + F.col("size")
        at = F.array(*[F.lit(int(x)) for x in low])
        # the stretches are few: at most three for each shard
        which = F.lit(None).cast("int")
        for k in range(len(low)):
            which = F.when((end > int(low[k])) & (end < int(high[k])), F.lit(k)).otherwise(which)
        cell = F.floor((end - F.get(at, which) - 1) / F.get(F.array(*[F.lit(int(w)) for w in width]), which))
        seen = groups.select(end.alias("e"), which.alias("which"), cell.alias("cell")).where("which IS NOT NULL")
        seen = seen.groupBy("which", "cell").agg(F.min("e"), F.max("e"), F.count_distinct("e")).collect()
        hidden = dict(zip(self.known[:-1].tolist(), self.hides.tolist(), strict=True))
        for x in low:
            hidden[int(x)] = False
        ends = []
        for _, _, first, last, n in seen:
            ends += [first, last]
            hidden[first] = n > 2
            hidden.setdefault(last, False)
        self.known = np.unique(np.concatenate([self.known, np.array(ends, np.int64)]))
        self.hides = np.array([hidden.get(int(x), False) for x in self.known[:-1]])

    def walk(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Greedy cuts; where the best one is hidden, the hopeful walk takes the
        whole capacity, the other the last known end."""
        total, at, cuts = int(self.known[-1]), 0, []
        for _ in range(shards):
            target = at + capacity
            if target >= total:
                cuts.append(total)
                break
            k = int(np.searchsorted(self.known, target, side="right")) - 1
            at = int(target if hopeful and self.hides[k] and self.known[k] != target else max(at, self.known[k]))
            cuts.append(at)
        return cuts

    def least_ends(self, capacity: int, shards: int) -> list[int]:
        """For each shard but the last, the smallest known end from which the rest
        still fits into the shards that follow."""
        total, out = int(self.known[-1]), []
        at = total
        for _ in range(shards - 1):
            at = int(self.known[np.searchsorted(self.known, max(at - capacity, 0), side="left")])
            out.append(at)
        return out[::-1]

    def levelled(self, shards: int) -> np.ndarray:
        """The known ends on a scale on which a group that is larger than an equal
        share of all others counts as such a share: it has a shard of its own."""
        sizes = np.diff(self.known)
        large = np.zeros(len(sizes), bool)
        while True:
            share = sizes[~large].sum() / max(1, shards - int(large.sum()))
            more = ~large & ~self.hides & (sizes > share)
            if not more.any():
                return np.concatenate([[0], np.cumsum(np.where(large, share, sizes))])
            large |= more

    def even(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """The ends nearest to equal shares of what is left, no shard over the
        capacity; and the stretches that hide ends where one was looked for."""
        total, at, cuts, unsure = int(self.known[-1]), 0, [], set()
        level = self.levelled(shards)

        def note(k: int) -> None:
            if 0 <= k < len(self.hides) and self.hides[k]:
                unsure.add(k)

        def place(x: int, side: str) -> int:
            k = int(np.searchsorted(self.known, x, side=side))
            if side == "right":
                k -= 1
            if self.known[min(k, len(self.known) - 1)] != x:
                note(k if side == "right" else k - 1)
            return k

        back = total
        for _ in range(shards - 1):  # where the smallest ends were looked for
            back = int(self.known[place(max(back - capacity, 0), "left")])
        for left, least in zip(range(shards, 1, -1), self.least_ends(capacity, shards), strict=True):
            here = int(np.searchsorted(self.known, at, side="left"))
            low = int(np.searchsorted(self.known, max(at, least), side="left"))
            high = place(at + capacity, "right")
            if low <= here < high:  # no shard stays empty while groups are left
                low = here + 1
                note(here)
            goal = level[here] + (level[-1] - level[here]) / left
            k = int(np.searchsorted(level, goal, side="left"))
            if level[min(k, len(level) - 1)] != goal:
                note(k - 1)
            near = [min(max(x, low), high) for x in (k - 1, k)]
            at = int(self.known[min(near, key=lambda x: (abs(level[x] - goal), x))])
            cuts.append(at)
        return [*cuts, total], unsure

    def smallest(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        """The smallest capacity with which the walk gets to the end."""
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, shards, hopeful)[-1] == self.known[-1]:
                high = middle
            else:
                low = middle + 1
        return low


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """The ends of the shards, as sums of sizes, of the smallest capacity; of all
    such cuts one that deals what is left evenly at each shard."""
    total, largest = groups.agg(F.sum("size"), F.max("size")).first()
    if total is None:
        return []
    ends = Ends(total)
    least = max(largest, -(-total // shards))
    ends.refine(groups, np.array([0]))
    while True:
        low = ends.smallest(least, total, shards, hopeful=True)
        high = ends.smallest(low, total, shards, hopeful=False)
        a, b = ends.walk(low, shards, hopeful=False), ends.walk(high, shards, hopeful=True)
        b += [total] * (len(a) - len(b))
        if low == high and a == b[: len(a)] and a[-1] == total:
            return even_cuts(groups, ends, low, shards)
        # stretches with a hidden end that a cut may fall into, at any capacity left
        wanted = set()
        for x, y in zip(a, b, strict=False):
            i = np.searchsorted(ends.known, min(x, y), side="right") - 1
            j = np.searchsorted(ends.known, max(x, y), side="left")
            wanted |= {int(s) for s in range(i, min(j + 1, len(ends.hides))) if ends.hides[s]}
        if not wanted:
            return even_cuts(groups, ends, high, shards)
        # many at first: the widest ones, the others follow
        widest = sorted(wanted, key=lambda s: ends.known[s] - ends.known[s + 1])[: 3 * shards]
        ends.refine(groups, np.array(sorted(widest)))


def even_cuts(groups: DataFrame, ends: Ends, capacity: int, shards: int) -> list[int]:
    """Looks into stretches that hide ends until the even cuts are sure."""
    while True:
        cuts, unsure = ends.even(capacity, shards)
        if not unsure:
            return cuts
        ends.refine(groups, np.array(sorted(unsure)))


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (position in the shard)."""
    rows = materialise(sized(docs))
    groups = rows.groupBy("digest").agg(
        F.min("doc_id").alias("first_doc"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")
    )
    groups = materialise(with_running_sums(groups))
    cuts = minimax_cuts(groups, shards)  # one number per shard
    # the shard is the number of cuts at or before the group's begin
    shard = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("below"))) if cuts else F.lit(0)
    groups = groups.withColumn("shard", shard.cast("int"))
    starts = groups.groupBy("shard").agg(F.min("rows_below").alias("start"))  # a row per shard
    groups = groups.join(F.broadcast(starts), "shard")
    groups = groups.select("digest", "shard", (F.col("rows_below") - F.col("start")).alias("before"))
    ranked = number_within(rows, "digest", ["doc_id", "size", "text_crc32"], "rank")
    return ranked.join(groups, "digest").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot")
    )
