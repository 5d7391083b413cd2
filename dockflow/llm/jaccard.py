"""Near copies: texts whose sets of word shingles have a Jaccard of ``similarity`` or more.

The first candidates come from the operator of ``simhash.py``: each set has a
fingerprint, and its Gray-order index gives links that join all fingerprints within
its radius.  A likeness of 0.8 may lie further apart than the radius, so the other
pairs are found by prefixes.

No pair is lost and none is taken on an estimate.  Shingles have one order: those
that a sample finds frequent come last, the more frequent the later, all others
by their hash.  Two sets of the wanted likeness then share a shingle among the
first ``n - ceil(similarity * n) + 1`` of each, so texts meet by these.  Each link
is checked on the whole sets.  The order may be any, so the sample decides on the
cost only.

To keep a large group of near copies from making all its pairs, each text is first
checked against two texts of each shingle's group and those that the index names.  What
these links join needs no further look; the other pairs of a group are then looked at
too, so the components are those of all pairs.  Texts that meet in several such groups
are compared in the first of them: a member has the ``EARLIER`` smallest of its groups
with it, and a pair that shares one before the group at hand is left to that one.

Each set has a map of at least as many bits as shingles: a shingle turns one bit
over.  Bits in which two maps differ stand for shingles that only one set has, so
two maps bound the likeness from above, and nearly all pairs are refuted by them;
the whole sets meet only for the rest.  A group with members in several components
is cut into blocks of about ``BLOCK`` members, and pairs of blocks are compared in
tasks of their own: a large group is no single task, and only pairs that the maps
cannot refute leave it.

Bounds: at most FREQUENT shingles reach the driver and are broadcast (16 MB).

Defined cases: NULL and blank texts have no shingles and are copies of each other;
fewer words than a shingle form one shingle; equal sets are one node; rows with a
NULL id take part; only doc_id and text are read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import discard, materialise
from dockflow.llm.components import components
from dockflow.llm.simhash import BLOCKS, SLICE, majority, shingle_hashes
from dockflow.llm.simhash import links as index_links

ONE_IN = 8  # texts in the sample
SEEN = 4  # times in the sample that make a shingle frequent
FREQUENT = 1 << 20
RADIUS = 2  # of the index, in bits
EARLIER = 32  # groups that a member names; pairs that share only others are compared again
MARGIN = 1e-9  # for products of a decimal fraction
BLOCK = 512  # members of a group that are compared together


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingles' hashes, in order."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles in order, and the rank of each by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                found = shingle_set(text.as_py(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["g"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(ONE_IN)) == 0).select("text")
    counts = sample.mapInArrow(run, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN)
    top = counts.orderBy(F.desc("n"), "g").limit(FREQUENT).toPandas()  # the documented bound
    hashes, rank = top["g"].to_numpy(np.int64).view(np.uint64), np.arange(len(top))[::-1]
    order = np.argsort(hashes)
    return hashes[order], rank[order]


def prefix(shingles: np.ndarray, hashes: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set: two like sets share one of them."""
    n = len(shingles)
    size = n - ceil(similarity * n - MARGIN) + 1 if n else 0
    if not len(hashes):
        return shingles[:size]
    at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
    often = hashes[at] == shingles
    rare = shingles[~often]
    if len(rare) >= size:
        return rare[:size]
    return np.concatenate([rare, shingles[often][np.argsort(rank[at[often]])]])[:size]


def bit_map(shingles: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes: whether an odd number of them has it."""
    size = 1 << max(6, (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles >> np.uint64(20)).view(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Maps (a row of 64-bit words each) as those of so many words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def may_be_alike(m: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of m and n shingles with these maps (of equal width) can be alike."""
    differ = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    # of the union, at least ``similarity`` is shared and ``differ`` is not
    return (np.minimum(m, n) >= similarity * np.maximum(m, n) - MARGIN) & (differ * (1 + similarity) <= (1 - similarity) * (m + n) + MARGIN)


def nodes_of(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, h (hash of the text), node (hash of the set), n, prefix, bits, fps (the set's fingerprint)."""
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), words)
                node = np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)
                out.append((int(node), len(s), prefix(s, *known.value, similarity).view(np.int64), bit_map(s), majority(slices(s))))
            node, n, first, bits, fps = zip(*out, strict=True) if out else ((), (), (), (), ())
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (first, fps)]
            columns = [*batch.columns[:2], pa.array(node, pa.int64()), pa.array(n, pa.int32()), lists[0], pa.array(bits, pa.binary()), lists[1]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "node", "n", "prefix", "bits", "fps"])

    def slices(s: np.ndarray) -> Iterator[np.ndarray]:
        return (s[at : at + SLICE] for at in range(0, len(s), SLICE))

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, h long, node long, n int, prefix array<long>, bits binary, fps array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, shingles.  ``nodes``: node and the doc_id and h of one of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"), "text")
    texts = texts.join(nodes, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h"))).select("node", "text")
    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    least, most = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = both.where(least >= similarity * most - MARGIN)
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return both.where(shared >= similarity * union - MARGIN).select("a", "b")


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sizes and maps do not refute."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    y = nodes.select(F.col("node").alias("b"), "n", F.col("bits").alias("y"))
    both = pairs.join(x, "a").join(y, "b").where(F.least("m", "n") >= similarity * F.greatest("m", "n") - MARGIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for m, n, x, y in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                x, y = (np.frombuffer(z, "<u8").reshape(1, -1) for z in (x, y))
                words = min(x.shape[1], y.shape[1])
                stay.append(bool(may_be_alike(np.array([m]), np.array([n]), folded(x, words), folded(y, words), similarity)[0]))
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def block_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: members of a group (g, size, node, n, bits, component, earlier) in different
    components that sizes and maps do not refute; blocks of a group meet pairwise.
    ``earlier``: some groups before g that the member has."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select(
        "g", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "n", "component", "bits", "earlier"
    )
    keys = ["g", "i", "j"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def compare(i: int, j: int, held: list[tuple]) -> tuple[list, list]:
        a, b = [], []
        classes: dict[tuple[int, int], list] = {}
        for mine, node, n, component, bits, earlier in held:
            classes.setdefault((mine, len(bits) // 8), []).append((node, n, component, bits, frozenset(earlier)))
        for (x_block, x_words), x in classes.items():
            for (y_block, y_words), y in classes.items():
                words = min(x_words, y_words)
                if (x_block, y_block) != (i, j) or similarity * max(x_words, y_words) > 2 * words:
                    continue  # a map has less than two bits for a shingle, and sizes of alike sets are near
                xn, xm, xc = (np.array(c) for c in list(zip(*x, strict=True))[:3])
                yn, ym, yc = (np.array(c) for c in list(zip(*y, strict=True))[:3])
                xs, ys = (folded(np.frombuffer(b"".join(r[3] for r in z), "<u8").reshape(len(z), -1), words) for z in (x, y))
                for k in range(len(x)):
                    good = may_be_alike(xm[k], ym, xs[k], ys, similarity) & (xc[k] != yc) & ((xn[k] < yn) | (i != j))
                    node, before = x[k][0], x[k][4]
                    for at in np.flatnonzero(good).tolist():
                        other = y[at]
                        if before.isdisjoint(other[4]):
                            a.append(min(node, other[0]))
                            b.append(max(node, other[0]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for (_, i, j), held in groupby(stream, key=lambda r: r[:3]):
            a, b = compare(i, j, [r[3:] for r in held])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def checked_texts(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose sets are alike; ``pairs`` is a written table."""
    needed = pairs.selectExpr("explode(array(a, b)) AS node").distinct()
    sets = materialise(sets_of(docs, nodes.select("node", "doc_id", "h").join(needed, "node"), words))
    found = materialise(checked(pairs, sets, similarity))
    discard(sets)
    return found


def links(docs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: alike nodes, enough of them for the components of all.  ``rows``: of ``nodes_of``."""
    nodes = materialise(rows.dropDuplicates(["node"]))
    keys = nodes.select("node", F.explode("prefix").alias("g"))
    groups = keys.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"), F.max("node").alias("last"))
    # written first, so that its size decides whether the keys must move to meet it
    groups = materialise(groups.where("size > 1"))
    members = materialise(keys.join(groups, "g"))
    star = members.select("node", F.explode(F.array("first", "last")).alias("hub")).where("node <> hub")
    star = star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    index = index_links(nodes.select("node", "fps"), RADIUS, BLOCKS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialise(star.unionByName(index).distinct())
    near = materialise(plausible(pairs, nodes, similarity))
    found = checked_texts(docs, near, nodes, words, similarity)
    discard(groups, near)
    tied = materialise(components(found))
    placed = members.join(tied, "node", "left").select("g", "size", "node", F.coalesce("component", "node").alias("component"))
    placed = materialise(placed)
    apart = placed.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    apart, joined = materialise(apart.select("g")), placed
    placed = materialise(placed.join(apart, "g").where("size > 2"))
    discard(members, joined, apart)
    named = placed.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("g")), 1, EARLIER).alias("named"))
    rows = placed.join(nodes.select("node", "n", "bits").join(named, "node"), "node")
    rows = rows.withColumn("earlier", F.filter("named", lambda x: x < F.col("g"))).drop("named")
    rest = materialise(block_pairs(rows, similarity).distinct().join(pairs, ["a", "b"], "left_anti"))
    more = checked_texts(docs, rest, nodes, words, similarity)
    discard(pairs, placed, rest, tied, nodes)
    return found.unionByName(more)


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, h, node, component: rows that links of alike texts join share it."""
    rows = materialise(nodes_of(docs, words, similarity))
    tied = components(links(docs, rows, words, similarity))
    rows = rows.select("doc_id", "h", "node")
    return rows.join(tied, "node", "left").select("doc_id", "h", "node", F.coalesce("component", "node").alias("component"))
