"""Random forest for regression that is grown and applied by tasks, never on the driver.

The rules are those of Spark ML's forest: each tree weighs the rows by a Poisson draw,
a node tries a few predictors, categories are ordered by their mean label, a split
must lower the variance and leave enough rows on both sides, trees grow to a depth.
Continuous predictors are cut into bins as there.  What differs is the layout: Spark ML
sends histograms of all open nodes of all trees through a shuffle for each group of
nodes and keeps the trees as objects in the driver.

Here a row is a key (the bins of its predictors), a label and how often both occur.
Draws and choices of predictors are hashes of the seed, the tree and the row or the
node, so the forest does not depend on partitions.  Nodes of more than ``limit``
different rows are split by sums that Spark adds up; smaller ones go to a task with
their rows and are grown there.  The trees lie in a folder of the shared storage in
bundles; keys meet them there, and the parts of a prediction are added in order.

Bounds: a task holds ``limit`` rows and a bundle of trees, the driver the upper
nodes (about 2 x trees x rows / limit) and at most 2^16 values of a predictor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.session import remove_dir, shared_dir

LIMIT = 1 << 20  # different rows of a task
BATCH = 1 << 26  # rows under way at once, when each tree has its own
VALUES = 1 << 16  # of a predictor, that the driver looks at one by one
BUNDLE = 8  # most trees of a task
TREES = "bundle int, tree int, roots binary, feature binary, rule binary, child binary, value binary, gain array<double>"
PART = "bundle int, part binary"


# --- hashes -----------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(*numbers: int) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    for n in numbers:
        out = mixed(out ^ np.array([n % (1 << 64)], np.uint64))
    return out


def poisson_steps(mean: int) -> np.ndarray:
    """P(draw <= k) for k = 0, 1, ...; a draw is the number of steps at or below a uniform number."""
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 20))
    logs = np.array([math.lgamma(i + 1.0) for i in k])
    return np.cumsum(np.exp(k * math.log(mean) - mean - logs))


STEPS = {b: poisson_steps(1 << b) for b in range(11)}


def weights(key: np.ndarray, label: np.ndarray, n: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree sees each row: Poisson(n), as the sum of draws for the bits of n."""
    own = mixed(key.view(np.uint64) ^ mixed(label.view(np.uint64)))
    out = np.zeros(len(key))

    def add(where: np.ndarray, bit: int, draw: int) -> None:
        u = (mixed(own[where] ^ salt(seed, tree, bit, draw)) >> np.uint64(11)) * 2.0**-53
        out[where] += np.searchsorted(STEPS[bit], u, side="right")

    top = max(STEPS)
    for bit in range(top):
        if (where := np.flatnonzero((n >> bit) & 1)).size:
            add(where, bit, 0)
    for draw in range(int(n.max(initial=0)) >> top):
        add(np.flatnonzero(n >> top > draw), top, draw + 1)
    return out


def choices(path: np.ndarray, predictors: int, tried: int, seed: int, tree: int) -> np.ndarray:
    """The predictors that each node tries."""
    node = mixed(path.astype(np.uint64) ^ salt(seed, tree, -1))
    scores = np.stack([mixed(node ^ salt(f)) for f in range(predictors)], axis=1)
    return np.argsort(scores, axis=1, kind="stable")[:, :tried]


# --- splits -----------------------------------------------------------------


def codes_of(key: np.ndarray, predictors: int) -> np.ndarray:
    """A key's bytes: one bin for each predictor."""
    return np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :predictors]


def goes_left(category: np.ndarray, rule: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A rule is the last bin of the left side, or one bit for each category on it."""
    code = code.astype(np.uint64)
    return np.where(category, (rule >> (code & np.uint64(63))) & np.uint64(1) == 1, code <= rule)


def settle(tree: dict, codes: np.ndarray, category: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The node without children that each row reaches from the node ``at``."""
    feature, rule, child = tree["feature"], tree["rule"], tree["child"]
    at = at.copy()
    live = np.flatnonzero(feature[at] >= 0)
    while live.size:
        node = at[live]
        f = feature[node]
        at[live] = child[node] + ~goes_left(category[f], rule[node], codes[live, f])
        live = live[feature[at[live]] >= 0]
    return at


def best_splits(slot: np.ndarray, code: np.ndarray, w: np.ndarray, s: np.ndarray, category: np.ndarray, least: int) -> tuple:
    """(gain, rule) for each slot, a node with a predictor it tries.

    ``w`` and ``s`` are the sums of weights and of weighted labels of the bins of a slot;
    slots are 0, 1, ... in order and each has a bin.  Without a split the gain is 0.
    The gain is that of the variance times the node's weight.
    """
    order = np.lexsort((np.where(category[slot], s / w, code), slot))
    slot, code, w, s = slot[order], code[order], w[order], s[order]
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    all_w, all_s = np.add.reduceat(w, starts), np.add.reduceat(s, starts)
    left_w, left_s = np.cumsum(w), np.cumsum(s)
    left_w -= np.r_[0.0, left_w[starts[1:] - 1]][slot]
    left_s -= np.r_[0.0, left_s[starts[1:] - 1]][slot]
    right_w, right_s = all_w[slot] - left_w, all_s[slot] - left_s
    valid = (left_w >= least) & (right_w >= least)
    whole = (all_s * all_s / all_w)[slot]
    gain = np.where(valid, left_s**2 / left_w + right_s**2 / np.where(valid, right_w, 1.0) - whole, 0.0)
    gain[gain <= 1e-12 * np.abs(whole)] = 0.0  # rounding
    best = np.maximum.reduceat(gain, starts)
    first = np.flatnonzero(gain == best[slot])[::-1]
    place = np.empty(len(starts), np.int64)
    place[slot[first]] = first
    bits = np.where(np.arange(len(slot)) <= place[slot], np.uint64(1) << (code.astype(np.uint64) & np.uint64(63)), np.uint64(0))
    return best, np.where(category, np.bitwise_or.reduceat(bits, starts), code[place].astype(np.uint64))


def cells_of(codes: np.ndarray, node: np.ndarray, chosen: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple:
    """(slot, code, weight, sum) of the bins that occur; a slot is node x tried + its number."""
    tried = chosen.shape[1]
    rows = np.arange(len(node))
    key = np.concatenate([(node * tried + j) << 8 | codes[rows, chosen[node, j]] for j in range(tried)])
    order = np.argsort(key)
    key, row = key[order], order % len(node)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[starts] >> 8, key[starts] & 255, np.add.reduceat(w[row], starts), np.add.reduceat(s[row], starts)


def grown(codes: np.ndarray, label: np.ndarray, w: np.ndarray, node: np.ndarray, path: np.ndarray, depth: np.ndarray, spec: dict, tree: int) -> dict:
    """The nodes below the given ones, level by level; the given ones come first."""
    category, tried, least = np.array(spec["arity"]) > 0, spec["tried"], spec["least"]
    s, levels, count = w * label, [], 0
    gains = np.zeros(len(category))
    while len(path):
        many = len(path)
        all_w, all_s = np.bincount(node, w, many), np.bincount(node, s, many)
        level = {"feature": np.full(many, -1, np.int8), "rule": np.zeros(many, np.uint64), "child": np.zeros(many, np.int32), "value": all_s / np.maximum(all_w, 1e-300)}
        levels.append(level)
        count += many
        tries = np.flatnonzero((all_w >= 2 * least) & (depth < spec["depth"]))
        if not tries.size:
            break
        number = np.full(many, -1)
        number[tries] = np.arange(len(tries))
        stay = np.flatnonzero(number[node] >= 0)
        codes, w, s, node = codes[stay], w[stay], s[stay], number[node[stay]]
        chosen = choices(path[tries], len(category), tried, spec["seed"], tree)
        gain, rule = best_splits(*cells_of(codes, node, chosen, w, s), category[chosen.ravel()], least)
        gain, rule = gain.reshape(-1, tried), rule.reshape(-1, tried)
        best = np.argmax(gain, axis=1)
        line = np.arange(len(tries))
        gain, rule, feature = gain[line, best], rule[line, best], chosen[line, best]
        split = np.flatnonzero(gain > 0)
        at = tries[split]
        level["feature"][at], level["rule"][at] = feature[split], rule[split]
        level["child"][at] = count + 2 * np.arange(len(split))
        gains += np.bincount(feature[split], gain[split], len(category))
        number = np.full(len(tries), -1)
        number[split] = np.arange(len(split))
        stay = np.flatnonzero(number[node] >= 0)
        codes, w, s, node = codes[stay], w[stay], s[stay], node[stay]
        f = feature[node]
        left = goes_left(category[f], rule[node], codes[np.arange(len(node)), f])
        node = 2 * number[node] + ~left
        path = np.stack([2 * path[at], 2 * path[at] + 1], axis=1).ravel()
        depth = np.repeat(depth[at] + 1, 2)
    return {k: np.concatenate([x[k] for x in levels]) for k in levels[0]} | {"gain": gains}


# --- upper nodes ------------------------------------------------------------


def new_top(rows: int) -> dict:
    return {"feature": [-1], "rule": [0], "child": [0], "path": [1], "depth": [0], "rows": [rows], "value": [None]}


def arrays(top: dict) -> dict:
    """``value`` is NaN where a task grows on."""
    kinds = {"feature": np.int8, "rule": np.uint64, "child": np.int32, "path": np.int64, "depth": np.int64, "value": float}
    return {k: np.array(top[k], kind) for k, kind in kinds.items()}


def columns(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy() for n in names]


def census(spec: dict, tops: list[dict], open_nodes: dict[int, list[int]]):
    """Sums over a batch for the bins of the open nodes."""
    trees = {t: arrays(tops[t]) for t in open_nodes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        category = np.array(spec["arity"]) > 0
        for batch in batches:
            key, label, n = columns(batch, "key", "label", "n")
            codes = codes_of(key, len(category))
            for tree, top in trees.items():
                w = weights(key, label, n, spec["seed"], tree)
                number = np.full(len(top["feature"]), -1)
                number[open_nodes[tree]] = np.arange(len(open_nodes[tree]))
                node = number[settle(top, codes, category, np.zeros(len(key), np.int64))]
                rows = np.flatnonzero((node >= 0) & (w > 0))
                if not rows.size:
                    continue
                chosen = choices(top["path"][open_nodes[tree]], len(category), spec["tried"], spec["seed"], tree)
                at, some, weight = node[rows], codes[rows], w[rows]
                slot, code, cell_w, cell_s = cells_of(some, at, chosen, weight, weight * label[rows])
                count = cells_of(some, at, chosen, np.ones(len(rows)), weight)[2]
                place, j = slot // spec["tried"], slot % spec["tried"]
                node_of = np.array(open_nodes[tree])[place]
                found = {"tree": np.full(len(slot), tree, np.int32), "node": node_of.astype(np.int32), "j": j.astype(np.int32), "feature": chosen[place, j].astype(np.int32), "code": code.astype(np.int32)}
                yield pa.RecordBatch.from_pydict(found | {"w": cell_w, "s": cell_s, "rows": count.astype(np.int64)})

    return run


def splitter(spec: dict):
    """The best split of a node, from all its bins."""

    def run(table: pa.Table) -> pa.Table:
        tree, node, j, feature, code, w, s, rows = columns(table, "tree", "node", "j", "feature", "code", "w", "s", "rows")
        category = np.array(spec["arity"]) > 0
        order = np.lexsort((code, j))
        j, feature, code, w, s, rows = (x[order] for x in (j, feature, code, w, s, rows))
        slots = feature[np.flatnonzero(np.r_[True, j[1:] != j[:-1]])]
        gain, rule = best_splits(j.astype(np.int64), code.astype(np.int64), w, s, category[slots], spec["least"])
        best = int(np.argmax(gain))
        mine = j == best
        left = goes_left(category[feature[mine]], rule[best], code[mine])
        found = {"tree": tree[:1], "node": node[:1], "feature": slots[best : best + 1], "rule": rule[best : best + 1].view(np.int64), "gain": gain[best : best + 1]}
        sizes = {"left": [int(rows[mine][left].sum())], "right": [int(rows[mine][~left].sum())], "value": [float(s[mine].sum() / w[mine].sum())]}
        return pa.table(found | sizes)

    return run


def upper_nodes(rows: DataFrame, total: int, spec: dict) -> tuple[list[dict], list[list[float]]]:
    """The trees down to nodes of at most ``limit`` rows, and the gains of the predictors in them."""
    tops = [new_top(total) for _ in range(spec["trees"])]
    gains = [[0.0] * len(spec["arity"]) for _ in tops]
    open_nodes = {t: [0] for t in range(len(tops))} if total > spec["limit"] else {}
    while open_nodes:
        key = ["tree", "node", "j", "feature", "code"]
        cells = rows.mapInArrow(census(spec, tops, open_nodes), "tree int, node int, j int, feature int, code int, w double, s double, rows bigint")
        cells = cells.groupBy(*key).agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("rows").alias("rows"))
        found = cells.groupBy("tree", "node").applyInArrow(
            splitter(spec), "tree int, node int, feature int, rule bigint, gain double, left bigint, right bigint, value double"
        )
        open_nodes = {}
        for r in found.orderBy("tree", "node").collect():
            top, node = tops[r["tree"]], r["node"]
            if r["gain"] <= 0 or top["depth"][node] >= spec["depth"]:
                top["value"][node] = r["value"]
                continue
            gains[r["tree"]][r["feature"]] += r["gain"]
            child = len(top["feature"])
            top["feature"][node], top["rule"][node], top["child"][node] = r["feature"], r["rule"] % (1 << 64), child
            for side, size in enumerate((r["left"], r["right"])):
                more = {"feature": -1, "rule": 0, "child": 0, "path": 2 * top["path"][node] + side, "depth": top["depth"][node] + 1, "rows": size, "value": None}
                for k, v in more.items():
                    top[k].append(v)
                if size > spec["limit"]:
                    open_nodes.setdefault(r["tree"], []).append(child + side)
    return tops, gains


def bundles_of(tops: list[dict], limit: int, trees: int) -> list[list[tuple[int, list[int]]]]:
    """What each task grows: some whole trees, or nodes of one tree that fit together."""
    if all(len(top["feature"]) == 1 for top in tops):
        return [[(t, [0]) for t in range(i, min(i + trees, len(tops)))] for i in range(0, len(tops), trees)]
    out = []
    for t, top in enumerate(tops):
        held = limit + 1
        for node, feature in enumerate(top["feature"]):
            if feature >= 0:
                continue
            size = top["rows"][node] if top["value"][node] is None else 0
            if held + size > limit:
                out.append([(t, [])])
                held = 0
            out[-1][0][1].append(node)
            held += size
    return out


# --- lower nodes ------------------------------------------------------------


def dealer(spec: dict, tops: list[dict], bundles: list, names: tuple[str, ...], some: range):
    """Rows for the bundles that need them, as bytes of their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        category = np.array(spec["arity"]) > 0
        whole = all(len(top["feature"]) == 1 for top in tops)
        trees = {} if whole else {t: arrays(tops[t]) for g in some for t, _ in bundles[g]}
        for batch in batches:
            values = columns(batch, *names)
            codes = codes_of(values[0], len(category))
            parts = {}
            if whole:
                asked = [g for g in some if "label" not in names or any(tops[t]["value"][0] is None for t, _ in bundles[g])]
                parts = dict.fromkeys(asked, b"".join(v.tobytes() for v in values))
            reached = {}
            for t, top in trees.items():
                at = settle(top, codes, category, np.zeros(len(codes), np.int64))
                if "label" in names:  # rows to grow by
                    at = np.where((weights(*values, spec["seed"], t) > 0) & np.isnan(top["value"][at]), at, -1)
                reached[t] = at
            for g in some if trees else ():
                ((t, nodes),) = bundles[g]
                if (rows := np.flatnonzero(np.isin(reached[t], nodes))).size:
                    parts[g] = b"".join(v[rows].tobytes() for v in values)
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(list(parts.values()), pa.binary())], ["bundle", "part"])

    return run


def unpacked(table: pa.Table, kinds: tuple) -> list[np.ndarray]:
    """The columns of ``dealer`` put together."""
    out = [[] for _ in kinds]
    for part in table.column("part").to_pylist():
        many = len(part) // (8 * len(kinds))
        for i, kind in enumerate(kinds):
            out[i].append(np.frombuffer(part, kind, many, 8 * many * i))
    return [np.concatenate(x) if x else np.empty(0, kind) for x, kind in zip(out, kinds)]


def grower(spec: dict, tops: list[dict], bundles: list):
    """The trees of a bundle, from its rows in an order of their own."""

    def run(table: pa.Table) -> pa.Table:
        bundle = table.column("bundle")[0].as_py()
        key, label, n = unpacked(table, (np.int64, float, np.int64))
        order = np.lexsort((label, key))
        key, label, n = key[order], label[order], n[order]
        category = np.array(spec["arity"]) > 0
        codes, found = np.ascontiguousarray(codes_of(key, len(category))), []
        for tree, nodes in bundles[bundle]:
            top = arrays(tops[tree])
            nodes = [x for x in nodes if np.isnan(top["value"][x])]
            if not nodes:
                continue
            w = weights(key, label, n, spec["seed"], tree)
            number = np.full(len(top["feature"]), -1)
            number[nodes] = np.arange(len(nodes))
            at = number[settle(top, codes, category, np.zeros(len(key), np.int64))]
            rows = np.flatnonzero((at >= 0) & (w > 0))
            below = grown(codes[rows], label[rows], w[rows], at[rows], top["path"][nodes], top["depth"][nodes], spec, tree)
            packed = {k: below[k].tobytes() for k in ("feature", "rule", "child", "value")}
            found.append({"bundle": bundle, "tree": tree, "roots": np.array(nodes, np.int32).tobytes(), **packed, "gain": below["gain"].tolist()})
        kinds = [("bundle", pa.int32()), ("tree", pa.int32()), *[(k, pa.binary()) for k in ("roots", "feature", "rule", "child", "value")], ("gain", pa.list_(pa.float64()))]
        return pa.Table.from_pylist(found, pa.schema(kinds))

    return run


def scorer(spec: dict, tops: list[dict], bundles: list):
    """For each key the sum over the trees of a bundle that it reaches there."""

    def run(keys: pa.Table, trees: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "bundle": pa.array([], pa.int32()), "part": pa.array([], pa.float64())})
        bundle = keys.column("bundle")[0].as_py()
        (key,) = unpacked(keys, (np.int64,))
        category = np.array(spec["arity"]) > 0
        codes = np.ascontiguousarray(codes_of(key, len(category)))
        part, records = np.zeros(len(key)), {r["tree"]: r for r in trees.to_pylist()}
        for tree, nodes in bundles[bundle]:
            top = arrays(tops[tree])
            at = settle(top, codes, category, np.zeros(len(key), np.int64))
            ends = np.zeros(len(top["feature"]), bool)
            ends[nodes] = ~np.isnan(top["value"][nodes])
            part[ends[at]] += top["value"][at[ends[at]]]
            if record := records.get(tree):
                kinds = {"roots": np.int32, "feature": np.int8, "rule": np.uint64, "child": np.int32, "value": float}
                below = {k: np.frombuffer(record[k], kind) for k, kind in kinds.items()}
                start = np.full(len(top["feature"]), -1)
                start[below["roots"]] = np.arange(len(below["roots"]))
                here = np.flatnonzero(start[at] >= 0)
                part[here] += below["value"][settle(below, codes[here], category, start[at[here]])]
        return pa.table({"key": key, "bundle": np.full(len(key), bundle, np.int32), "part": part})

    return run


# --- stages -----------------------------------------------------------------


def arities(df: DataFrame, name: str, size: int) -> list[int]:
    """Number of categories of each predictor in a vector column, 0 for numbers."""
    out = [0] * size
    attrs = df.schema[name].metadata.get("ml_attr", {}).get("attrs", {})
    for attr in attrs.get("nominal", []):
        out[attr["idx"]] = attr.get("num_vals") or len(attr["vals"])
    for attr in attrs.get("binary", []):
        out[attr["idx"]] = 2
    return out


def thresholds(values: list[tuple[float, int]], bins: int) -> list[float]:
    """Between which values a predictor is cut: all of them, or in strides of equal counts."""
    values = sorted(values)
    total = sum(n for _, n in values)
    cuts = [(a + b) / 2.0 for (a, _), (b, _) in zip(values, values[1:])]
    most = min(bins, total) - 1
    if len(cuts) <= most:
        return cuts
    stride, out, seen = total / (most + 1), [], values[0][1]
    target = stride
    for cut, (_, n) in zip(cuts, values[1:]):
        if abs(seen - target) < abs(seen + n - target):
            out.append(cut)
            target += stride
        seen += n
    return out


def all_cuts(vectors: DataFrame, arity: list[int], bins: int) -> list[list[float]]:
    """The thresholds of the continuous predictors, of ``x`` in all rows."""
    out = [[] for _ in arity]
    numbers = [i for i, a in enumerate(arity) if not a]
    if not numbers:
        return out
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("x")[i].alias("v")) for i in numbers]))
    counts = vectors.select(pairs.alias("p")).select("p.*").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        sizes = {r["i"]: r["many"] for r in counts.groupBy("i").agg(F.count(F.lit(1)).alias("many")).collect()}
        few = [i for i in numbers if sizes.get(i, 0) <= VALUES]
        found = counts.where(F.col("i").isin(few)).collect() if few else []
    finally:
        counts.unpersist()
    for i in numbers:
        if i in few:
            out[i] = thresholds([(r["v"], r["n"]) for r in found if r["i"] == i], bins)
        else:
            shares = [k / bins for k in range(1, bins)]
            out[i] = sorted(set(vectors.select(F.col("x")[i].alias("v")).approxQuantile("v", shares, 0.01 / bins)))
    return out


def key_of(x: Column, spec: dict) -> Column:
    """The bins of a row's predictors, a byte each: the category, or how many thresholds lie below."""

    def below(value: Column):
        return lambda cut: cut < value

    key = F.lit(0).cast("bigint")
    for i, (arity, cuts) in enumerate(zip(spec["arity"], spec["cuts"])):
        if arity:
            code = x[i].cast("bigint")
        elif cuts:
            code = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), below(x[i]))).cast("bigint")
        else:
            continue
        key = key.bitwiseOR(F.shiftleft(code, 8 * i))
    return key


def stored(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """Written to the shared storage and read again: later plans begin there."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class ForestRegressor(Estimator):
    """A forest to be fitted; vectors of up to seven predictors of at most 256 bins or 64 categories."""

    def __init__(
        self, features: str = "features", label: str = "label", prediction: str = "prediction", trees: int = 20, depth: int = 5,
        bins: int = 32, least: int = 1, tried: int = 2, seed: int = 0, limit: int = LIMIT,
    ):
        super().__init__()
        if not 2 <= bins <= 256 or not 0 <= depth <= 30:
            raise ValueError("bins are 2 to 256, depth is 0 to 30")
        self.spec = {"features": features, "label": label, "prediction": prediction, "trees": trees, "depth": depth, "bins": bins, "least": least, "tried": tried, "seed": seed, "limit": limit}

    def _fit(self, df: DataFrame) -> ForestModel:
        spark = df.sparkSession
        vectors = df.select(vector_to_array(self.spec["features"]).alias("x"), F.col(self.spec["label"]).cast("double").alias("label"))
        if not (head := vectors.select(F.size("x").alias("size")).first()):
            raise ValueError("no rows to fit a forest on")
        arity = arities(df, self.spec["features"], head["size"])
        if len(arity) > 7 or max(arity) > 64 or max(arity) > self.spec["bins"]:
            raise ValueError("more than seven predictors, or a predictor of too many categories")
        spec = self.spec | {"arity": arity, "cuts": all_cuts(vectors, arity, self.spec["bins"]), "tried": min(self.spec["tried"], len(arity))}
        equal = vectors.select(key_of(F.col("x"), spec).alias("key"), "label").groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        rows, folder = stored(equal)
        total = rows.count()
        tops, gains = upper_nodes(rows, total, spec)
        bundles = bundles_of(tops, spec["limit"], max(1, min(BUNDLE, spec["trees"] // (2 * spark.sparkContext.defaultParallelism))))
        # whole trees go at once, since their tasks share the rows; else as many as may be under way
        step = len(bundles) if total <= spec["limit"] else max(1, BATCH // max(1, spec["limit"]))
        path = shared_dir(spark)
        for i in range(0, len(bundles), step):
            some = range(i, min(i + step, len(bundles)))
            parts = rows.mapInArrow(dealer(spec, tops, bundles, ("key", "label", "n"), some), PART)
            stored(parts.repartition(len(some), "bundle").groupBy("bundle").applyInArrow(grower(spec, tops, bundles), TREES), path)
        remove_dir(spark, folder)
        return ForestModel(spec, tops, bundles, path, gains)


class ForestModel(Model, MLReadable, MLWritable):
    """A fitted forest: the upper nodes, and a folder with the others."""

    def __init__(self, spec: dict, tops: list[dict], bundles: list, path: str, gains: list[list[float]], importances: list[float] | None = None):
        super().__init__()
        self.spec, self.tops, self.path, self.gains = spec, tops, path, gains
        self.bundles = [[(t, list(nodes)) for t, nodes in bundle] for bundle in bundles]
        self.importances = importances

    @property
    def getNumTrees(self) -> int:
        return self.spec["trees"]

    @property
    def numFeatures(self) -> int:
        return len(self.spec["arity"])

    def nodes(self) -> DataFrame:
        return SparkSession.active().read.schema(TREES).parquet(self.path)

    @property
    def totalNumNodes(self) -> int:
        below = self.nodes().agg(F.coalesce(F.sum(F.octet_length("feature")), F.lit(0))).first()[0]
        # an upper node that a task grows on is the first one there
        return below + sum(f >= 0 or v is not None for top in self.tops for f, v in zip(top["feature"], top["value"]))

    @property
    def featureImportances(self) -> DenseVector:
        """The gains of each predictor: shares in each tree, and of their sums."""
        if self.importances is None:
            sums = np.array(self.gains)
            gain = [F.sum(F.col("gain")[i]).alias(str(i)) for i in range(self.numFeatures)]
            for r in self.nodes().groupBy("tree").agg(*gain).collect():
                sums[r["tree"]] += r[1:]
            whole = sums.sum(axis=1, keepdims=True)
            shares = (sums / np.where(whole > 0, whole, 1.0)).sum(axis=0)
            self.importances = (shares / (shares.sum() or 1.0)).tolist()
        return DenseVector(self.importances)

    def _transform(self, df: DataFrame) -> DataFrame:
        """Different keys are scored at once and stored; rows look their key up."""
        spec, bundles = self.spec, self.bundles
        rows = df.withColumn("_key", key_of(vector_to_array(spec["features"]), spec))
        keys, folder = stored(rows.select(F.col("_key").alias("key")).distinct())
        pieces = max(1, -(-keys.count() // LIMIT))
        parts = keys.mapInArrow(dealer(spec, self.tops, bundles, ("key",), range(len(bundles))), PART)
        parts = parts.withColumn("piece", F.pmod(F.xxhash64("part"), F.lit(pieces)).cast("int"))
        trees = self.nodes().withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        tasks = len(bundles) * pieces
        parts, trees = (x.repartition(tasks, "bundle", "piece").groupBy("bundle", "piece") for x in (parts, trees))
        sums = parts.cogroup(trees).applyInArrow(scorer(spec, self.tops, bundles), "key bigint, bundle int, part double")
        # in the order of the bundles, so that a sum does not depend on arrival
        ordered = F.sort_array(F.collect_list(F.struct("bundle", "part")))
        mean = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["part"]) / F.lit(float(spec["trees"]))
        scores, _ = stored(sums.groupBy(F.col("key").alias("_key")).agg(mean.alias(spec["prediction"])))
        remove_dir(df.sparkSession, folder)
        return rows.join(scores, "_key", "left").select(*[F.col(f"`{c}`") for c in df.columns], spec["prediction"])

    def write(self) -> MLWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ForestReader()


class ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model = self.model
        more = {"spec": model.spec, "tops": model.tops, "bundles": model.bundles, "gains": model.gains, "importances": model.featureImportances.tolist()}
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, extraMetadata=more)
        model.nodes().write.parquet(f"{path}/trees")


class ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        more = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(more["spec"], more["tops"], more["bundles"], f"{path}/trees", more["gains"], more["importances"])
        model._resetUid(more["uid"])
        return model
