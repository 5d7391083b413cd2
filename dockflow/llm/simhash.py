"""Near-duplicates by SimHash and a Gray-order hierarchical index.

A text's fingerprint takes, per bit, the majority of the 64-bit hashes of its
word shingles.  To find all fingerprints within ``radius`` bits of each other,
the 64 bits are cut into blocks; two such fingerprints agree in all but
``radius`` blocks, so each choice of blocks that may agree is a key, and equal
keys meet in a task.  There they are sorted by Gray rank, and groups of
neighbours are joined into the nodes of a tree.  A node holds the bits that all
below it share; a pair of nodes adds up its differences from level to level,
counting each shared bit once, and is dropped with everything below as soon as
the sum is over the radius.  No link is lost, none is found by comparing all.

With three words and a radius of 2 the six blocks leave at most 22 bits free, so
a key has at most 2**22 fingerprints (32 MB).  What leaves a task is one link per
fingerprint and key group, not all pairs.

Defined cases: NULL and blank texts have fingerprint zero, linked like others;
fewer words than a shingle form one shingle; equal texts share a fingerprint;
rows with a NULL id take part, and their component is the smallest id in it that
is not NULL; only doc_id and text are read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import materialise
from dockflow.llm.components import components

SEED = 42
FANOUT = 8
TOP = 32  # nodes of the highest level, at most
FRONTIER = 1 << 15  # node pairs opened at a time
BLOCKS = 6
SLICE = 1 << 18  # shingles counted at a time


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, repeats included, in slices."""
    w = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII spaces
    if not w:
        return
    if len(w) < words:
        w = [b" ".join(w)]
        words = 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(w) - words + 1, SLICE):
        part = w[at : at + SLICE + words - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))
        yield np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(part) - words + 1)


def remixed(h: np.ndarray, family: int) -> np.ndarray:
    """Further hashes of the same shingles (a mixer of 64-bit integers)."""
    if family == 0:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * family % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(slices: Iterable[np.ndarray], families: int = 1) -> list[int]:
    """One fingerprint per family, as signed 64-bit integers, of hashes in slices."""
    ones, n = np.zeros((families, 64), np.int64), 0
    for h in slices:
        n += len(h)
        for f in range(families):
            bits = np.unpackbits(remixed(h, f).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[f] += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > n, axis=1, bitorder="little") if n else np.zeros((families, 8), np.uint8)
    return packed.view("<i8").ravel().tolist()


def fingerprint(text: str | None, words: int, families: int = 1) -> list[int]:
    return majority(shingle_hashes(text, words), families)


def fingerprints(docs: DataFrame, words: int = 3, families: int = 1) -> DataFrame:
    """doc_id, h (hash of the text), fps (one signed 64-bit integer per family)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words, families) for t in batch.column(2)]
            columns = [*batch.columns[:2], pa.array(fps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "fps"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h long, fps array<long>")


def block_masks(radius: int, blocks: int) -> list[int]:
    """A mask for each choice of blocks that agree, as signed integers."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (m >> 63 << 64) for m in masks]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def levels_of(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Patterns and masks of each level, the single words first.

    ``words`` are in Gray order; a level's node covers FANOUT nodes below it.
    """
    full = np.uint64(2**64 - 1)
    levels = [(words, np.full(len(words), full))]
    while len(levels[-1][0]) > TOP:
        pattern, mask = levels[-1]
        first = np.arange(0, len(pattern), FANOUT)
        lead = np.repeat(pattern[first], FANOUT)[: len(pattern)]
        shared = np.bitwise_and.reduceat(mask, first) & ~np.bitwise_or.reduceat(pattern ^ lead, first)
        levels.append((pattern[first] & shared, shared))
    return levels


def close_pairs(words: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius; ``words`` are in Gray order."""
    levels = levels_of(words)
    i, j = np.triu_indices(len(levels[-1][0]))
    pattern, mask = levels[-1]
    seen = mask[i] & mask[j]
    far = np.bitwise_count((pattern[i] ^ pattern[j]) & seen)
    near = far <= radius
    todo = [(len(levels) - 1, i[near], j[near], far[near])]
    steps = np.arange(FANOUT)
    while todo:
        level, i, j, far = todo.pop()
        if level == 0:
            yield i[i < j], j[i < j]
            continue
        if len(i) > FRONTIER:
            todo.append((level, i[FRONTIER:], j[FRONTIER:], far[FRONTIER:]))
            i, j, far = i[:FRONTIER], j[:FRONTIER], far[:FRONTIER]
        above = levels[level][1]
        pattern, mask = levels[level - 1]
        a = np.repeat(i * FANOUT, FANOUT**2) + np.tile(np.repeat(steps, FANOUT), len(i))
        b = np.repeat(j * FANOUT, FANOUT**2) + np.tile(steps, FANOUT * len(i))
        far = np.repeat(far, FANOUT**2)
        counted = np.repeat(above[i] & above[j], FANOUT**2)
        there = (a <= b) & (a < len(pattern)) & (b < len(pattern))
        a, b, far, counted = a[there], b[there], far[there], counted[there]
        # only the bits that the level above has not counted
        far = far + np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b] & ~counted)
        near = far <= radius
        todo.append((level - 1, a[near], b[near], far[near]))


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each position is linked to, over any steps."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            ra, rb = ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def links(nodes: DataFrame, radius: int, blocks: int, similarity: float | None = None) -> DataFrame:
    """a, b: links that join all nodes within the radius in some family.

    ``nodes``: node, fps.  With a ``similarity``, a pair must also agree in that
    share of the bits of the family and the one after it.
    """
    masks = block_masks(radius, blocks)
    families = nodes.select(F.max(F.size("fps"))).first()[0] or 1
    keys = [F.get("fps", F.lit(f)).bitwiseAND(F.lit(m)) for f in range(families) for m in masks]
    rows = nodes.select("node", "fps", F.posexplode(F.array(*keys)).alias("c", "key"))
    family = F.floor(F.col("c") / len(masks)).cast("int")
    rows = rows.select("c", "key", F.get("fps", family).alias("fp"), "node", F.get("fps", (family + 1) % families).alias("more"))
    rows = rows.repartition("c", "key").sortWithinPartitions("c", "key")
    most = 128 if similarity is None else int((1 - similarity) * 128 + 1e-9)

    def of_run(fp: np.ndarray, node: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(gray_rank(fp))
        fp, node, more = fp[order], node[order], more[order]

        def agreeing() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in close_pairs(fp, radius):
                ok = np.bitwise_count(fp[a] ^ fp[b]) + np.bitwise_count(more[a] ^ more[b]) <= most
                yield a[ok], b[ok]

        root = roots(len(fp), agreeing())
        tied = root != np.arange(len(fp))
        return node[tied], node[root[tied]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(held: list, closed: bool):
            c, key, fp, node, more = (np.concatenate(x) for x in zip(*held, strict=True))
            border = np.flatnonzero((c[1:] != c[:-1]) | (key[1:] != key[:-1])) + 1
            begin = np.concatenate([[0], border])
            end = np.concatenate([border, [len(c)]])
            upto = len(begin) if closed else len(begin) - 1
            size = end[:upto] - begin[:upto]
            a, b = [], []
            # runs of a leaf's size: each place against those after it, all runs at once
            run_end = np.repeat(end[:upto], size)
            place = np.flatnonzero(np.repeat((size > 1) & (size <= FANOUT), size))
            for step in range(1, FANOUT):
                place = place[place + step < run_end[place]]
                x, y = place, place + step
                far = np.bitwise_count(fp[x] ^ fp[y])
                ok = (far <= radius) & (far + np.bitwise_count(more[x] ^ more[y]) <= most)
                a.append(node[x[ok]])
                b.append(node[y[ok]])
            for s, e in zip(begin[:upto][size > FANOUT], end[:upto][size > FANOUT], strict=True):
                x, y = of_run(fp[s:e], node[s:e], more[s:e])
                a.append(x)
                b.append(y)
            s = begin[-1]
            rest = [] if closed else [[x[s:] for x in (c, key, fp, node, more)]]
            found = [pa.array(np.concatenate(x), pa.int64()) for x in (a, b)]
            return rest, pa.RecordBatch.from_arrays(found, names=["a", "b"])

        held = []
        for batch in batches:
            if batch.num_rows:
                new = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
                new[2], new[4] = new[2].view(np.uint64), new[4].view(np.uint64)
                # a run that goes on is only added to, not searched
                open_run = held and new[0][-1] == held[0][0][0] and new[1][-1] == held[0][1][0]
                held.append(new)
                if not open_run:
                    held, found = cut(held, closed=False)
                    yield found
        if held:
            yield cut(held, closed=True)[1]

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    radius: int = 2,
    blocks: int = BLOCKS,
    families: int = 1,
    similarity: float | None = None,
) -> DataFrame:
    """doc_id, h, fps, node, component_id (smallest doc_id that can be reached)."""
    node: Column = F.get("fps", F.lit(0)) if families == 1 else F.xxhash64("fps")
    rows = materialise(fingerprints(docs, words, families).withColumn("node", node))
    nodes = materialise(rows.groupBy("node", "fps").agg(F.min("doc_id").alias("least")))
    found = materialise(links(nodes.select("node", "fps"), radius, blocks, similarity))
    tied = components(found)
    joined = nodes.join(tied, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = materialise(joined.join(least, "component").select("node", "component", "component_id").distinct())
    return rows.join(joined, "node").select("doc_id", "h", "fps", "node", "component", "component_id")


def first_of_each(docs: DataFrame, **search) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all columns."""
    return one_of_each(docs, near_duplicates(docs, **search))


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``rows`` (doc_id, h, component):
    that of the smallest doc_id, then the smallest hash of the text.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h"))
    stay = materialise(rows.groupBy("component").agg(first.alias("first")).select("first.doc_id", "first.h"))
    stay = stay.withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    known = rows
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_x"))
    rows = rows.join(stay, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_x") == F.col("_h")), "left_semi")
    # of a row that is there more than once one stays; only such rows are looked through
    twice = known.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"))
    twice = materialise(twice)
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_x") == F.col("_h"))
    once = rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["_id", "_x"]))
    return once.select("row.*")
