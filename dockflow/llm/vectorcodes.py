"""Vector codes: each part of a vector is replaced by its nearest codebook entry.

Components become whole numbers, vectors are cut into equal parts, and each part
position has a codebook of its own, improved by rounds of nearest entry and mean.

The different parts of all vectors, with how often each occurs, are dealt by range
in lexicographic order, so a task holds a section of the trie over them: a node is
a prefix of components, a leaf a part.  The section is traversed depth first, a
strip of leaves at a time: a node's distances to all entries are its parent's plus
those of its own component, so a shared prefix is added up once for all leaves
below it.  Leaves take the nearest entry and add their weighted components to
its sum.  Only these sums (entries x part positions) reach the driver.

Copies are counted inside a task before they are dealt, so a vector that a third
of all rows hold is a few weighted leaves.

Defined cases: vectors that are NULL or hold a NULL or non-finite component are
left out, and so are those with a component of ``LIMIT`` or more in size (their
distances would not fit) and those whose length is not the most frequent one (of
equally frequent ones the smallest); a vector of a length that the parts do not
divide is cut into parts that differ by one; with fewer vectors than entries a
codebook has as many entries as vectors; the smallest ids come first, of equal
ids the lexicographically smaller vector, a NULL id last; repeated rows count
each; only vec_id, embedding and label are read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import discard, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 17  # of a component, so that whole numbers stay under 2**27
STRIP = 1 << 19  # distances held per level
ZERO = 1 << 31  # added, so that big-endian bytes sort as the numbers do


def packed(v: np.ndarray) -> np.ndarray:
    """Whole numbers, a row each, as bytes that sort in the same order."""
    return (v + ZERO).astype(">u4")


def unpacked(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), ">u4").reshape(len(raw), width).astype(np.int64) - ZERO


def most_frequent_length(vectors: DataFrame) -> int | None:
    sizes = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    row = sizes.orderBy(F.desc("rows"), "n").first()
    return row["n"] if row else None


def whole_numbers(vectors: DataFrame, dims: int, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (packed whole numbers) of the rows that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            fit = np.flatnonzero(column.is_valid().to_numpy(False) & (column.value_lengths().fill_null(-1).to_numpy(False) == dims))
            x = column.take(pa.array(fit)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fit), dims)  # NULL is NaN
            with np.errstate(invalid="ignore"):
                good = (np.abs(x) < LIMIT).all(axis=1)
            v = packed(np.floor(x[good] * scale).astype(np.int64))
            rows = pa.array(fit[good])
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([r.tobytes() for r in v], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v"])

    rows = vectors.select("vec_id", "label", "embedding")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, v binary")


def cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    ends = [dims * k // parts for k in range(parts + 1)]
    return list(zip(ends, ends[1:], strict=False))


def distinct_parts(kept: DataFrame, dims: int, parts: int) -> DataFrame:
    """position, part, n: in lexicographic order, dealt by range; a part that
    several tasks have comes several times, next to each other."""
    places = cuts(dims, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[int, bytes], int] = {}
            for raw in batch.column(0).to_pylist():
                for p, (a, b) in enumerate(places):
                    key = p, raw[4 * a : 4 * b]
                    counts[key] = counts.get(key, 0) + 1
            if counts:
                position, part = zip(*counts, strict=True)
                columns = [pa.array(position, pa.int32()), pa.array(part, pa.binary()), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["position", "part", "n"])

    rows = kept.select("v").mapInArrow(run, "position int, part binary, n long")
    return rows.repartitionByRange("position", "part").sortWithinPartitions("position", "part")


def nearest(leaves: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each leaf; leaves are different and sorted."""
    n, depth = leaves.shape
    if not n or not depth:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    spread = max(int(leaves.max()), int(book.max())) - min(int(leaves.min()), int(book.min()))
    kind = np.int32 if spread * spread * depth < 1 << 31 else np.int64
    leaves, entries = leaves.astype(kind), np.ascontiguousarray(book.T.astype(kind))
    # opens[k, i]: leaf i is the first below its node of level k
    opens = np.logical_or.accumulate(np.concatenate([np.ones((1, depth), bool), leaves[1:] != leaves[:-1]]), axis=1).T
    index, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    strip = max(1, STRIP // len(book))
    for begin in range(0, n, strip):
        part = leaves[begin : begin + strip]
        above = summed = None
        for k in range(depth):
            first = opens[k, begin : begin + strip].copy()
            first[0] = True  # the path to a strip's first leaf is added up anew
            nodes = np.flatnonzero(first)
            own = part[nodes, k][:, None] - entries[k]
            own *= own
            if summed is None:
                summed = own
            elif len(nodes) == len(summed):
                summed += own
            else:
                own += summed[np.searchsorted(above, nodes, side="right") - 1]
                summed = own
            above = nodes
        which = summed.argmin(axis=1)  # of equal distances the first entry
        index[begin : begin + strip] = which
        distance[begin : begin + strip] = summed[np.arange(len(which)), which]
    return index, distance


def leaves_of(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different parts in lexicographic order, and the place of each given one."""
    if not width:
        return np.zeros((1, 0), np.int64), np.zeros(len(raw), np.int64)
    leaves, back = np.unique(np.frombuffer(b"".join(raw), f"V{4 * width}"), return_inverse=True)
    return unpacked(list(map(bytes, leaves)), width), back


def sums_of(parts: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """position, entry, n, sums of the components of the parts nearest to it."""
    widths = [b.shape[1] for b in books]
    most = max(widths)
    names = [f"s{k}" for k in range(most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), most + 1), np.int64) for b in books]
        for batch in batches:
            position = batch.column(0).to_numpy()
            raw, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                v, back = leaves_of([raw[k] for k in at.tolist()], widths[p])  # files may follow each other in any order
                weight = np.zeros(len(v), np.int64)
                np.add.at(weight, back, n[at])
                index, _ = nearest(v, books[p])
                np.add.at(total[p], (index, 0), weight)
                np.add.at(total[p][:, 1 : widths[p] + 1], index, v * weight[:, None])
        rows = [(p, e, *total[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(total[p][:, 0]).tolist()]
        if rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["position", "entry", "n", *names])

    schema = ", ".join(f"{c} long" for c in ["position", "entry", "n", *names])
    rows = parts.mapInArrow(run, schema)
    return rows.groupBy("position", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *names]])


def train(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position; ``kept`` is what ``whole_numbers`` gives."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    start = unpacked([bytes(r["v"]) for r in kept.select("vec_id", "v").orderBy(*order).limit(entries).collect()], dims)
    books = [start[:, a:b].copy() for a, b in cuts(dims, parts)]
    if not len(start):
        return books
    dealt = materialise(distinct_parts(kept, dims, parts))
    for _ in range(rounds):
        for row in sums_of(dealt, books).collect():  # at most parts x entries rows
            book = books[row["position"]]
            book[row["entry"]] = [row[f"s{k}"] // row["n"] for k in range(book.shape[1])]
    discard(dealt)
    return books


def encode(kept: DataFrame, dims: int, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, codes (an entry per part), error (squared distance)."""
    places = cuts(dims, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            codes, error = np.zeros((len(raw), len(books)), np.int32), np.zeros(len(raw), np.int64)
            for p, (a, b) in enumerate(places):
                if not raw:
                    continue
                leaves, back = leaves_of([r[4 * a : 4 * b] for r in raw], b - a)
                index, distance = nearest(leaves, books[p])
                codes[:, p] = index[back]
                error += distance[back]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), len(books)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists, pa.array(error)], names=["vec_id", "label", "codes", "error"])

    kind = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, codes array<int>, error long")


def decode(codes: np.ndarray, books: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """Vectors, a row each, from their codes."""
    return np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], axis=1) / scale


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, codes, error and label_error (summed over equal labels), and
    the codebooks."""
    dims = most_frequent_length(vectors) or 0
    kept = materialise(whole_numbers(vectors, dims))
    books = train(kept, dims, parts, entries, rounds)
    rows = materialise(encode(kept, dims, books))
    discard(kept)
    totals = materialise(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    rows = rows.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return rows.select("vec_id", "label", "codes", "error", "label_error"), books
