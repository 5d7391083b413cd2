"""Conversation prefix trie: every sequence of first turns that conversations share.

Turns are known by a hash of role and text; a sequence of turns is known by two
running polynomials modulo 2**61 - 1, which can be put together from parts, so
turns of one conversation may be dealt to several tasks.  Conversations are cut
into segments of at most ``SEGMENT`` turns, each with the hash of what precedes
it: equal beginnings of segments are equal beginnings of conversations.

Inside a task the segments go into z-fast tries: compacted nodes, found by the
hash of their path at the two-fattest depth of their edge.  A batch's segments are
located first (a fat binary search gives the node where a segment leaves the trie),
then inserted node by node, then the edges are expanded to one row per depth.
Rows of equal paths from several tasks are added up by Spark, so a beginning that
a third of all conversations share is one row per task.

Sums over subtrees need no walk through the tree.  Each node belongs to its
smallest conversation, whose nodes form a chain down to its end.  A node's subtree
holds the whole chains of all its other members and the part of its own chain from
it on; chain totals are added up by the same tries.

Defined cases: rows without a conversation id are left out; NULL roles and texts
are empty; turns are ordered by number (NULL first), ties by a hash of role and
text; repeated rows are turns of their own; other columns are left out; without
conversations there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.llm.common import discard, materialise

PRIME = (1 << 61) - 1
BASES = (0x1D872B41F2A3C56B, 0x0C2B7F5A96E1D387)  # any two numbers under PRIME
SEGMENT = 1024  # turns
BATCH = 20_000  # conversations' segments located together
FLUSH = 500_000  # turns of a task's tries before they are expanded
BORROW, SPREAD = 9, 5
LIST = 4096  # ids of a piece of a list

NO_PATH = (0, 0)


def longer(path: tuple[int, int], turn: tuple[int, int]) -> tuple[int, int]:
    return (path[0] * BASES[0] + turn[0] + 1) % PRIME, (path[1] * BASES[1] + turn[1] + 1) % PRIME


def shifted(path: tuple[int, int], n: int) -> tuple[int, int]:
    """What a path adds to the hash of one that goes on for n turns after it."""
    return path[0] * pow(BASES[0], n, PRIME) % PRIME, path[1] * pow(BASES[1], n, PRIME) % PRIME


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    __slots__ = ("top", "depth", "paths", "ends", "children", "stats")

    def __init__(self, top: int, depth: int, paths: list):
        self.top, self.depth, self.paths = top, depth, paths  # the edge covers depths top + 1 to depth
        self.ends: list[int] = []  # segments that end here
        self.children: dict[tuple[int, int], Node] = {}  # by the path one turn on


class ZFast:
    """Compacted trie of sequences of paths (``paths[d]`` is the path of d turns)."""

    def __init__(self, root: tuple[int, int]):
        self.root = Node(0, 0, [root])
        self.handles: dict[tuple[int, int], Node] = {}

    def locate(self, paths: list, start: Node | None = None) -> tuple[Node, int]:
        """The node where a sequence leaves the trie, and how many turns they share."""
        found = start or self.root
        low, high = found.depth, len(paths) - 1
        while low < high:
            f = two_fattest(low, high)
            node = self.handles.get(paths[f])
            if node is None:
                high = f - 1
                continue
            if node.depth >= len(paths) or node.paths[node.depth] != paths[node.depth]:
                return node, self._shared(node, paths, f)
            found, low = node, node.depth
        below = found.children.get(paths[found.depth + 1]) if found.depth + 1 < len(paths) else None
        if below is None:
            return found, found.depth
        return below, self._shared(below, paths, found.depth + 1)  # left above the handle

    @staticmethod
    def _shared(node: Node, paths: list, low: int) -> int:
        """Turns shared with a node's edge, at least ``low``."""
        high = min(node.depth, len(paths) - 1)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if node.paths[middle] == paths[middle] else (low, middle - 1)
        return low

    def _split(self, node: Node, depth: int) -> Node:
        """Cut a node's edge; the lower part becomes a node of its own."""
        low = Node(depth, node.depth, node.paths)
        low.ends, low.children = node.ends, node.children
        del self.handles[node.paths[two_fattest(node.top, node.depth)]]
        node.depth, node.ends, node.children = depth, [], {node.paths[depth + 1]: low}
        self.handles[node.paths[two_fattest(node.top, depth)]] = node
        self.handles[low.paths[two_fattest(depth, low.depth)]] = low
        return low

    def insert(self, item: int, paths: list, start: Node | None = None) -> None:
        node, shared = self.locate(paths, start)
        if shared < node.depth:
            self._split(node, shared)
        if shared == len(paths) - 1:
            node.ends.append(item)
            return
        leaf = Node(shared, len(paths) - 1, paths)
        leaf.ends.append(item)
        node.children[paths[shared + 1]] = leaf
        self.handles[paths[two_fattest(shared, leaf.depth)]] = leaf

    def insert_batch(self, items: list[tuple[int, list]]) -> None:
        """Locate all, then insert those that leave at one node together, from the
        last node above it that stays as it is."""
        at: dict[int, tuple[Node, list]] = {}
        for item, paths in items:
            node, shared = self.locate(paths)
            start = node if shared == node.depth else None
            at.setdefault(id(start), (start, []))[1].append((item, paths))
        for start, group in at.values():
            for item, paths in group:
                # a node that was met whole stays a node on this path, also when others are put below it
                self.insert(item, paths, start)

    def expanded(self, values: np.ndarray, least: np.ndarray) -> Iterator[tuple]:
        """path before, path, depth here, smallest of ``least`` and sums of
        ``values`` over the sequences through it, for each depth of each edge."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children.values()
        for node in reversed(order):
            mine = [values[node.ends].sum(axis=0).tolist()] if node.ends else []
            low = [int(least[node.ends].min())] if node.ends else []
            below = [child.stats for child in node.children.values()]
            node.stats = [min(low + [b[0] for b in below]), [sum(c) for c in zip(*mine, *[b[1] for b in below], strict=True)]] if low or below else None
            for d in range(node.top + 1, node.depth + 1):
                yield node.paths[d - 1], node.paths[d], d, node.stats[0], node.stats[1]


HASH = "a long, b long"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, t (hash of role and text), n_bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long"), "turn", F.md5(whole.cast("binary")).alias("t"), F.octet_length(text).alias("n_bytes"))


def own_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (the path of the first ``depth`` turns), n_bytes.

    Turns are dealt by range; a conversation that lies in several parts gets what
    its earlier parts add.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "t"]
    rows = turn_rows(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, path = None, 0, NO_PATH
        for batch in batches:
            places, a, b = [], [], []
            for conv, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if conv != current:
                    current, place, path = conv, 0, NO_PATH
                place += 1
                path = longer(path, (int(t[:15], 16), int(t[15:30], 16)))
                places.append(place)
                a.append(path[0])
                b.append(path[1])
            columns = [batch.column(0), batch.column(4), pa.array(places, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "depth", "a", "b", "n_bytes"])

    rows = materialise(rows.mapInArrow(run, f"conv_id long, part int, depth long, {HASH}, n_bytes int"))
    last = F.max_by(F.struct("a", "b"), "depth")
    parts = rows.groupBy("conv_id", "part").agg(F.max("depth").alias("n"), last.alias("path"))
    parts = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "path"))).alias("parts"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before, path = 0, NO_PATH
                for x in known:
                    out.append((conv, x["part"], before, *path))
                    on = shifted(path, x["n"])
                    path = (on[0] + x["path"]["a"]) % PRIME, (on[1] + x["path"]["b"]) % PRIME
                    before += x["n"]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 3], strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "before", "ca", "cb"])

    # of each part at most its first and last conversation: as many rows as parts
    carried = materialise(parts.where(F.size("parts") > 1).mapInArrow(carry, "conv_id long, part int, before long, ca long, cb long"))
    rows = rows.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return rows.select("conv_id", F.col("depth").alias("place"), F.coalesce("before", F.lit(0).cast("long")).alias("before"), "a", "b", "ca", "cb", "n_bytes").mapInArrow(
        put_together, f"conv_id long, depth long, {HASH}, n_bytes int"
    )


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths inside a part (place, a, b) go on from the path before it (ca, cb)."""
    for batch in batches:
        place, before = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        a, b = (batch.column(c).to_numpy().copy() for c in (3, 4))
        for k in np.flatnonzero(before).tolist():
            on = shifted((batch.column(5)[k].as_py(), batch.column(6)[k].as_py()), int(place[k]))
            a[k], b[k] = (on[0] + int(a[k])) % PRIME, (on[1] + int(b[k])) % PRIME
        columns = [batch.column(0), pa.array(place + before), pa.array(a), pa.array(b), batch.column(7)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "a", "b", "n_bytes"])


def rebuilt_paths(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, ends): the rows of the rebuilt conversations, and for each its last
    depth and path."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROW
    path = F.struct("depth", "a", "b", "n_bytes")
    heads = F.array_sort(F.collect_list(F.when(F.col("depth") < BORROW, path)))  # BORROW - 1 at most
    convs = own.groupBy("conv_id").agg(F.max("depth").alias("n"), heads.alias("heads"), F.max_by(F.struct("a", "b"), "depth").alias("last"))
    convs = materialise(convs.withColumn("h", h.cast("int")).withColumn("donor", F.col("conv_id") - F.col("conv_id") % SPREAD))
    donors = convs.where("conv_id = donor").select(F.col("conv_id").alias("donor"), F.col("heads").alias("given"))
    joined = convs.join(donors, "donor", "left")
    joined = joined.withColumn("given", F.coalesce(F.slice("given", 1, F.col("h")), F.expr("filter(heads, x -> false)")))
    nothing = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("n_bytes"))
    at = lambda array, n: F.when(n > 0, F.try_element_at(array, n.cast("int"))).otherwise(nothing)
    joined = joined.select(
        "conv_id", "n", "h", "given", "last", at(F.col("given"), F.size("given")).alias("top"), at(F.col("heads"), F.least("h", "n")).alias("cut")
    )
    joined = materialise(joined)
    head = joined.select("conv_id", F.explode("given").alias("x")).select("conv_id", "x.*")
    moved = own.join(joined.select("conv_id", "h", "top", "cut"), "conv_id").where("depth > h")
    plain = joined.where("n > h").select("conv_id", (F.col("n") - F.col("h")).alias("on"), "top", "cut", F.col("last.a").alias("a"), F.col("last.b").alias("b"))
    columns = ["conv_id", F.col("on"), F.col("top.depth").alias("td"), "top.a", "top.b", "cut.a", "cut.b"]
    names = ["conv_id", "on", "td", "ta", "tb", "ca", "cb", "a", "b", "n_bytes"]
    moved = moved.withColumn("on", F.col("depth") - F.col("h")).select(*columns, "a", "b", "n_bytes").toDF(*names)
    tails = moved.mapInArrow(regrown, f"conv_id long, depth long, {HASH}, n_bytes int")
    paths = materialise(head.unionByName(tails))
    plain = plain.select(*columns, "a", "b", F.lit(0).alias("n_bytes")).toDF(*names)
    ends = plain.mapInArrow(regrown, f"conv_id long, depth long, {HASH}, n_bytes int").drop("n_bytes")
    ends = materialise(ends.unionByName(joined.where("n <= h").select("conv_id", "top.depth", "top.a", "top.b")))
    discard(convs, joined)
    return paths, ends


def regrown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of own turns after a cut (ca, cb), put on top of another path (ta, tb)."""
    for batch in batches:
        rows = zip(*[c.to_pylist() for c in batch.columns[1:9]], strict=True)
        a, b, depth = [], [], []
        for on, td, ta, tb, ca, cb, xa, xb in rows:
            more = shifted((ta - ca, tb - cb), on)
            a.append((xa + more[0]) % PRIME)
            b.append((xb + more[1]) % PRIME)
            depth.append(td + on)
        columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (depth, a, b)], batch.column(9)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "a", "b", "n_bytes"])


def segments(paths: DataFrame) -> DataFrame:
    """conv_id, segment, entries (depth, a, b, n_bytes) in order, at most SEGMENT,
    after the path that precedes them."""
    number = F.floor((F.col("depth") - 1) / SEGMENT).cast("long")
    entry = F.struct("depth", "a", "b", "n_bytes")
    rows = paths.withColumn("segment", number)
    border = rows.where(F.col("depth") % SEGMENT == 0).withColumn("segment", F.col("segment") + 1)
    rows = rows.unionByName(border).groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.where(F.element_at("entries", -1)["depth"] > F.col("segment") * SEGMENT)


def trie_rows(rows: DataFrame, values: list[str]) -> DataFrame:
    """pa, pb (path before), a, b, depth, conv (smallest), n_bytes and the sums of
    ``values`` of every beginning, from rows of conv_id, segment, entries, values;
    added up inside tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple[int, int], tuple[ZFast, int]] = {}
        convs, weights, sizes, turns = [], [], {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            least, sums = np.array(convs, np.int64), np.array(weights, np.int64).reshape(len(convs), len(values))
            out = []
            for trie, above in tries.values():
                for before, path, depth, low, total in trie.expanded(sums, least):
                    out.append((*before, *path, depth + above, low, sizes[path], *total))
                    if len(out) >= 50_000:
                        yield table_of(out)
                        out = []
            if out:
                yield table_of(out)

        def table_of(out: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["pa", "pb", "a", "b", "depth", "conv", "n_bytes", *values])

        for batch in batches:
            together: dict[tuple[int, int], list] = {}
            for k, conv in enumerate(batch.column(0).to_pylist()):
                entries = batch.column(2)[k].values
                depth, a, b, n_bytes = (entries.field(c).to_pylist() for c in range(4))
                above = batch.column(1)[k].as_py() * SEGMENT
                paths = list(zip(a, b, strict=True))
                if depth[0] > above:
                    paths, n_bytes = [NO_PATH, *paths], [0, *n_bytes]
                sizes.update(zip(paths[1:], n_bytes[1:], strict=True))
                if paths[0] not in tries:
                    tries[paths[0]] = ZFast(paths[0]), above
                together.setdefault(paths[0], []).append((len(convs), paths))
                convs.append(conv)
                weights.append([c[k].as_py() for c in batch.columns[3:]])
                turns += len(paths)
            for root, items in together.items():
                for at in range(0, len(items), BATCH):
                    tries[root][0].insert_batch(items[at : at + BATCH])
            if turns >= FLUSH:
                yield from flush()
                tries, convs, weights, sizes, turns = {}, [], [], {}, 0
        yield from flush()

    schema = ", ".join(f"{c} long" for c in ["pa", "pb", "a", "b", "depth", "conv", "n_bytes", *values])
    rows = rows.select("conv_id", "segment", "entries", *values).mapInArrow(run, schema)
    first = [F.min(c).alias(c) for c in ("pa", "pb", "depth", "conv", "n_bytes")]
    return rows.groupBy("a", "b").agg(*first, *[F.sum(c).alias(c) for c in values])


def chain_sums(nodes: DataFrame, value: Column) -> DataFrame:
    """Adds ``above``: the sum of ``value`` over the nodes of the same smallest
    conversation at smaller depths, by stretches of a chain."""
    stretch = F.floor(F.col("depth") / SEGMENT)
    rows = nodes.withColumn("_value", value).withColumn("_stretch", stretch)
    totals = rows.groupBy("conv", "_stretch").agg(F.sum("_value").alias("_total"))
    past = Window.partitionBy("conv").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "_stretch", F.coalesce(F.sum("_total").over(past), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("conv", "_stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    rows = rows.join(totals, ["conv", "_stretch"])
    return rows.withColumn("above", F.col("_before") + F.col("_inside")).drop("_stretch", "_before", "_inside", "_value")


def id_lists(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256: of the decimal ids that end at a path, in order.

    Ids are sorted by range and joined to pieces of ``LIST`` ids at most; the
    pieces of a path follow each other in one task, which holds one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held, out = None, [], []
        for batch in batches:
            for a, b, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and ((a, b) != path or len(held) == LIST):
                    out.append((*path, held[0], ",".join(map(str, held))))
                    held = []
                path = a, b
                held.append(conv)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "first", "ids"])
                    out = []
        if held:
            out.append((*path, held[0], ",".join(map(str, held))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state, out = None, None, []
        for batch in batches:
            for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if (a, b) != path:
                    if path:
                        out.append((*path, state.hexdigest()))
                    path, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "ends_sha256"])
                out = []
        if path:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*path, state.hexdigest())], names=["a", "b", "ends_sha256"])

    order = ["a", "b", "conv_id"]
    rows = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.mapInArrow(pieces, "a long, b long, first long, ids string")
    rows = rows.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return rows.mapInArrow(digests, "a long, b long, ends_sha256 string")


EMPTY_LIST = hashlib.sha256(b"").hexdigest()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    own = materialise(own_paths(conversations))
    paths, ends = rebuilt_paths(own)
    pieces = materialise(segments(paths))
    discard(own, paths)
    counted = trie_rows(pieces.withColumn("n_convs", F.lit(1).cast("long")), ["n_convs"])
    nodes = materialise(counted)
    # children, and the totals of each chain
    children = nodes.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    known = materialise(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    chains = known.groupBy(F.col("conv").alias("conv_id")).agg(F.sum(saved).alias("w"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    below = trie_rows(pieces.join(chains, "conv_id"), ["w", "leaf"]).select("a", "b", "w", "leaf")
    below = materialise(below)
    # the root is one row, all totals in it
    all_convs = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    totals = known.agg(
        F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"),
        F.greatest(F.count(F.when(F.col("n_children") == 0, 1)), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum(saved), F.lit(0)).cast("long").alias("saved_tokens"),
    )
    least = all_convs.first()  # one row
    totals = totals.first()
    spark, none = conversations.sparkSession, F.lit(None).cast("long")
    lists = id_lists(ends)
    rows = chain_sums(known.join(below, ["a", "b"]), saved)
    parents = known.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"))
    deeper = rows.where("depth > 1").join(parents, ["pa", "pb"])
    rows = rows.where("depth = 1").withColumn("parent_conv_id", F.lit(least["conv_id"]).cast("long")).unionByName(deeper)
    rows = rows.select(
        "a", "b", F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("leaf").alias("n_leaves"), (F.col("w") - F.col("above")).alias("saved_tokens"),
    )
    if least["n_convs"]:
        root = spark.range(1).select(
            F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(least["conv_id"]).alias("conv_id"),
            F.lit(0).cast("long").alias("depth"), none.alias("parent_conv_id"), F.lit(least["n_convs"]).alias("n_convs"),
            *[F.lit(totals[c]).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
        )
        rows = rows.unionByName(root)
    rows = rows.join(lists, ["a", "b"], "left")
    return rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_LIST))).drop("a", "b")
