"""Best-fit packing of token pieces into sequences of a fixed capacity.

Documents are cut into pieces of at most ``capacity`` tokens.  Only the counts
per length (at most ``capacity`` numbers) reach the driver, which plans how many
sequences of which layout there are; the pieces then find their place by length
and position among the pieces of that length, in parallel.

The plan is a linear grouping scheme: large lengths are sorted, divided into
groups of equal cardinality and rounded up to the largest of their group; the
few sizes left make a configuration program, solved by column generation (a
knapsack finds the next configuration); its whole parts become sequences, whose
slots take the real pieces of the group.  What remains, and all small lengths,
goes by best fit in decreasing order into the space left, then into new sequences.

Defined cases: NULL and empty texts hold the closing id alone; documents, also
repeated ones, are packed one by one; only doc_id and text are read; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dockflow.llm.bpe import codec
from dockflow.llm.common import materialise, number_within

CAPACITY = 2048
CLOSING_ID = 0
GROUPS = 96
SMALL = 0.45  # of the capacity; larger lengths are grouped
PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for batch in batches:
            row, piece, length, crc = [], [], [], []
            for k, found in enumerate(coder.encode_all(batch.column(1).to_pylist())):
                ids = found + closing
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(k)
                    piece.append(p)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            number = np.array(piece, np.int32)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number)]
            columns += [pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECE}")


def best_configuration(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The counts of sizes of most value that fit together (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fit = np.flatnonzero(sizes <= room)
        with_it = best[room - sizes[fit]] + values[fit]
        top = int(np.argmax(with_it))
        best[room], last[room] = best[room - 1], -1
        if with_it[top] > best[room] + 1e-12:
            best[room], last[room] = with_it[top], fit[top]
    counts = np.zeros(len(sizes), int)
    room = capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= sizes[last[room]]
    return best[capacity], counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """How often to use which configuration: the whole parts of an optimal
    fractional solution, found by column generation."""
    n = len(sizes)
    columns = [np.eye(n, dtype=int)[i] * (capacity // sizes[i]) for i in range(n)]
    basis = np.array(columns, float).T
    for _ in range(40 * n):
        inverse = np.linalg.inv(basis)
        worth, counts = best_configuration(np.maximum(inverse.sum(axis=0), 0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ counts
        used = np.maximum(inverse @ demand, 0)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[out], basis[:, out] = counts, counts
    used = np.linalg.solve(basis, demand.astype(float))
    return [(int(x + 1e-6), c) for x, c in zip(used, columns, strict=True) if x >= 1 - 1e-6]


class Plan:
    """Runs of equal sequences, and which pieces go into them.

    ``runs`` has a row for each placement: length, first position among the
    pieces of this length, number of pieces in each sequence, first sequence,
    offset there.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(counts)
        self.sequences, self.runs = 0, []
        self.taken = dict.fromkeys(counts, 0)
        self.open: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence, how many
        self.rooms: list[int] = []
        self._large()
        self._rest()

    def _new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, length: int, each: int, first: int, n: int, used: int) -> None:
        self.runs.append((length, self.taken[length], each, first, used))
        self.taken[length] += each * n
        self.left[length] -= each * n

    def _keep(self, first: int, n: int, room: int) -> None:
        if n and room:
            if room not in self.open:
                insort(self.rooms, room)
            self.open.setdefault(room, []).append((first, n))

    def _large(self) -> None:
        large = [x for x in sorted(self.left, reverse=True) if self.capacity * SMALL < x and self.left[x]]
        total = sum(self.left[x] for x in large)
        if not large:
            return
        # groups of equal cardinality, as queues of (length, how many)
        groups, share = [[]], max(1, -(-total // GROUPS))
        held = 0
        for length in large:
            n = self.left[length]
            while n:
                if held == share:
                    groups.append([])
                    held = 0
                part = min(n, share - held)
                groups[-1].append([length, part])
                held += part
                n -= part
        sizes: dict[int, list] = {}
        for g in groups:  # groups that round to the same size are one
            sizes.setdefault(g[0][0], []).extend(g)
        demand = np.array([sum(n for _, n in g) for g in sizes.values()])
        for n, counts in configurations(np.array(list(sizes)), demand, self.capacity):
            self._fill(n, [q for q, c in zip(sizes.values(), counts, strict=True) for _ in range(c)])

    def _fill(self, n: int, slots: list[list]) -> None:
        """Open n sequences and give each slot the next pieces of its queue."""
        parts = [(self._new(n), n, 0)]
        for queue in slots:
            after = []
            for first, many, used in parts:
                while many and queue:
                    length, there = queue[0]
                    c = min(many, there)
                    self._put(length, 1, first, c, used)
                    after.append((first, c, used + length))
                    first, many = first + c, many - c
                    queue[0][1] -= c
                    if not queue[0][1]:
                        queue.pop(0)
                if many:
                    after.append((first, many, used))
            parts = after
        for first, many, used in parts:
            self._keep(first, many, self.capacity - used)

    def _rest(self) -> None:
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    each = self.capacity // length
                    n = -(-self.left[length] // each)
                    self._keep(self._new(n), n, self.capacity)
                    continue
                room = self.rooms[at]
                first, many = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room], self.rooms[at]
                each = min(room // length, self.left[length])
                n = min(many, self.left[length] // each)
                self._put(length, each, first, n, self.capacity - room)
                self._keep(first + n, many - n, room)
                self._keep(first, n, room - each * length)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    rows = materialise(pieces(docs, tokenizer, capacity))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity``
    runs = np.array(sorted(Plan(counts, capacity).runs), np.int64).reshape(-1, 5)
    # one sorted key for length and position
    far = np.int64(1) << 48
    keys = runs[:, 0] * far + runs[:, 1]
    ranked = number_within(rows, "length", ["doc_id", "piece", "start", "ids_crc32"], "rank")
    ranked = ranked.select(*rows.columns, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            place = np.searchsorted(keys, length * far + rank, side="right") - 1
            _, begin, each, first, used = runs[place].T
            sequence = first + (rank - begin) // each
            offset = used + (rank - begin) % each * length
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = T.StructType([*rows.schema.fields]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)
