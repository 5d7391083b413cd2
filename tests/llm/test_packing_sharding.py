import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from dockflow.llm import packing, sharding
from tokenizers import Tokenizer

import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_and_places(spark, capacity):
    got = packing.pack(cases.frame(spark), PATH, capacity).collect()
    reader, want = Tokenizer.from_file(PATH), []
    for row in cases.sample():
        ids = np.array([*reader.encode(row[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((row[0], p, at, len(part), zlib.crc32(part.tobytes())))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(want)
    places: dict = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        assert sum(n for _, n in parts) <= capacity
    assert len(places) <= 1.05 * -(-sum(w[3] for w in want) // capacity) + 1


def test_plan_is_near_the_bound():
    r = np.random.default_rng(3)
    for low, high in ((1, 600), (300, 1400), (900, 1100), (1, 2048)):
        counts = Counter(r.integers(low, high + 1, 3000).tolist())
        plan = packing.Plan(dict(counts), 2048)
        total = sum(k * n for k, n in counts.items())
        pairs_only = sum(n for k, n in counts.items() if k > 1024)
        assert plan.sequences <= 1.12 * max(-(-total // 2048), pairs_only) + 1
        assert all(n == 0 for n in plan.left.values()) and plan.taken == dict(counts)
    assert packing.Plan({}, 2048).sequences == 0


def test_one_configuration_is_best():
    value, counts = packing.best_configuration(np.array([0.5, 0.34, 0.2]), np.array([5, 3, 2]), 10)
    assert abs(value - (0.34 * 2 + 0.2 * 2)) < 1e-9 or value >= 1.0
    assert (counts * np.array([5, 3, 2])).sum() <= 10


def walk(sizes, capacity, shards):
    cuts, held, n = [], 0, 1
    for i, s in enumerate(sizes):
        if s > capacity:
            return None
        if held + s > capacity:
            cuts.append(i)
            held, n = 0, n + 1
        held += s
    return cuts if n <= shards else None


@pytest.mark.parametrize(("shards", "cells"), [(1, 1 << 16), (4, 8), (7, 1 << 16), (60, 64)])
def test_smallest_capacity(spark, monkeypatch, shards, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    got = sharding.assign(cases.frame(spark), shards).collect()
    groups: dict = {}
    for row in cases.sample():
        g = groups.setdefault(row[1] or "", [None, 0, 0])
        g[0] = row[0] if g[0] is None else g[0] if row[0] is None else min(g[0], row[0])
        g[1] += len((row[1] or "").encode()) + 16
        g[2] += 1
    sizes = [g[1] for g in sorted(groups.values(), key=lambda g: (g[0] is not None, g[0]))]
    best = next(c for c in range(max(sizes), sum(sizes) + 1) if walk(sizes, c, shards) is not None)
    held, slots, by_text = Counter(), {}, {}
    for r in got:
        held[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        by_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert max(held.values()) == best and max(held) < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())


@pytest.mark.parametrize("cells", [8, 1 << 16])
def test_shards_are_even_and_all_used(spark, monkeypatch, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    r = random.Random(cells)
    rows = [(i, "x" * r.randint(0, 900) + str(i)) for i in range(1500)]
    held = Counter()
    for x in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect():
        held[x["shard"]] += x["size"]
    mean = sum(held.values()) / 40
    assert sorted(held) == list(range(40)) and min(held.values()) > 0.9 * mean and max(held.values()) < 1.1 * mean
    # one group of a third of all bytes takes a shard of its own, the others share the rest
    rows += [(2000 + i, "same " * 900) for i in range(80)]
    total = sum(len(t) + 16 for _, t in rows)
    held = Counter()
    for x in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect():
        held[x["shard"]] += x["size"]
    rest = sorted(held.values())[:-1]
    assert len(held) == 40 and max(held.values()) >= 0.3 * total and min(rest) > 0.8 * sum(rest) / 39


def test_empty_tables(spark):
    assert packing.pack(cases.nothing(spark), PATH).count() == 0
    assert sharding.assign(cases.nothing(spark), 40).count() == 0
