import numpy as np
import xxhash
from dockflow.llm import simhash
from dockflow.llm.components import components

import cases


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < k else [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_rows(spark):
    got = simhash.near_duplicates(cases.frame(spark)).select("doc_id", "fps", "component_id").collect()
    rows = cases.sample()
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    least = {c: min(r[0] for r, x in zip(rows, root, strict=True) if x == c and r[0] is not None) for c in set(root)}
    want = sorted((-1 if r[0] is None else r[0], f, least[c]) for r, f, c in zip(rows, fps, root, strict=True))
    assert sorted((-1 if d is None else d, f[0] % 2**64, c) for d, f, c in got) == want


def test_index_finds_all_close_pairs():
    r = np.random.default_rng(2)
    for n, radius in ((3, 2), (700, 2), (900, 6)):
        x = r.integers(0, 2**63, n // 5 + 1, dtype=np.uint64)[r.integers(0, n // 5 + 1, n)]
        for _ in range(3):
            x ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
        x = np.unique(x)
        x = x[np.argsort(simhash.gray_rank(x))]
        found = {(int(a), int(b)) for p in simhash.close_pairs(x, radius) for a, b in zip(*p, strict=True)}
        far = np.bitwise_count(x[:, None] ^ x[None])
        assert found == {(i, j) for i, j in np.argwhere(far <= radius).tolist() if i < j}


def test_gray_rank_orders_the_gray_sequence():
    n = np.arange(1000, dtype=np.uint64)
    assert np.array_equal(simhash.gray_rank(n ^ (n >> np.uint64(1))), n)


def test_links_over_key_groups_of_any_size(spark):
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 40)
    fps = sorted({int(b) ^ (1 << int(s)) ^ (1 << int(t)) for b in base for s, t in r.integers(0, 62, (30, 2))})
    nodes = spark.createDataFrame([(f, [f]) for f in fps], "node long, fps array<long>")
    found = components(simhash.links(nodes, 2, 6))
    got = {r["node"]: r["component"] for r in found.collect()}
    x = np.array(fps, np.int64)
    root = np.arange(len(x))
    far = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    for _ in range(50):
        root = np.array([root[row].min() for row in far])
    assert [got.get(f, f) for f in fps] == [fps[k] for k in root]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (7, None), (3, 2)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {5000: 5000}


def test_one_row_of_each_group_stays(spark):
    docs = cases.frame(spark)
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    best = simhash.near_duplicates(docs).select("component").distinct().count()
    assert kept.count() == best


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.nothing(spark)).count() == 0
    assert simhash.first_of_each(cases.nothing(spark)).count() == 0
