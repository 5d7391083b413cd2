import random

import numpy as np
from dockflow.llm import jaccard
from pyspark.sql import functions as F

import cases
import corpus_pipeline as pipeline


def near_the_limit(seed=5):
    """Texts of 60 to 300 words in groups: of each a base and copies with some
    words changed, so that the likeness to it lies on both sides of 0.8."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    texts, common = [], [word() for _ in range(40)]
    for k in range(24):
        base = [word() for _ in range(r.randint(60, 300))]
        base += common if k % 3 == 0 else []
        texts.append(base)
        for _ in range(5):
            copy = list(base)
            for i in r.sample(range(len(copy)), max(1, round(len(copy) * r.uniform(0.015, 0.035)))):
                copy[i] = word()
            texts.append(copy)
    return [" ".join(t) for t in texts]


def likeness(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    return {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])}


def brute_components(n, like):
    root = list(range(n))
    for (i, j), s in like.items():
        if s >= 0.8 and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if x == high else x for x in root]
    return root


def test_components_are_those_of_all_pairs_near_the_limit(spark, monkeypatch):
    texts = near_the_limit()
    like = likeness(texts)
    assert sum(0.8 <= s < 0.85 for s in like.values()) >= 20 and sum(0.7 <= s < 0.8 for s in like.values()) >= 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    root = brute_components(len(texts), like)
    for one_in, seen in ((8, 4), (1, 2)):  # the order of shingles changes nothing
        monkeypatch.setattr(jaccard, "ONE_IN", one_in)
        monkeypatch.setattr(jaccard, "SEEN", seen)
        got = {r["doc_id"]: r["component"] for r in jaccard.near_copies(docs).collect()}
        assert len({(got[i], root[i]) for i in got}) == len(set(root)) == len(set(got.values()))
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, None).collect()}
    assert kept == set(root)


def test_prefixes_of_like_sets_meet():
    r = np.random.default_rng(1)
    hashes = np.sort(r.integers(0, 2**63, 200).astype(np.uint64))
    rank = r.permutation(200)
    for _ in range(300):
        shared = np.concatenate([r.choice(hashes, 30, replace=False), r.integers(0, 2**63, 50).astype(np.uint64)])
        a, b = (np.unique(np.concatenate([shared, r.integers(0, 2**63, 10).astype(np.uint64)])) for _ in range(2))
        assert len(np.intersect1d(jaccard.prefix(a, hashes, rank, 0.8), jaccard.prefix(b, hashes, rank, 0.8)))


def test_odd_rows(spark):
    assert jaccard.near_copies(cases.nothing(spark)).count() == 0
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "TWO  words"), (None, "two words"), (6, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in jaccard.near_copies(docs).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5] == got[None] and len(set(got.values())) == 3


def test_clean_documents_stay(spark):
    r = random.Random(8)
    texts = []
    for k in range(60):
        base = [f"b{k}x{i}" for i in range(200)]
        copy = list(base)
        for i in r.sample(range(200), 6):
            copy[i] = f"new{i}"
        texts += [" ".join(base), " ".join(copy)]
    like = likeness(texts)
    near = {j for (i, j), s in like.items() if s >= 0.8}
    assert sum(0.7 <= s < 0.8 for s in like.values()) >= 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x["doc_id"] for x in pipeline.near_duplicates(spark, docs, None).collect()}
    assert len(kept) == len(texts) - len(near)


def one_family(n=16):
    """Texts of one base with three or four words of their own, far apart: those with
    three are alike, the others lie just under 0.8."""
    texts, free = [], iter(range(4, 300, 5))
    for k in range(n):
        copy = [f"w{i}" for i in range(300)]
        for i in [next(free) for _ in range(3 + k % 2)]:
            copy[i] = f"n{k}x{i}"
        texts.append(" ".join(copy))
    return texts


def test_pairs_of_several_groups_are_compared_once(spark, monkeypatch):
    texts = one_family()
    like = likeness(texts)
    assert 0 < sum(s >= 0.8 for s in like.values()) < len(like)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    root, real, made = brute_components(len(texts), like), jaccard.block_pairs, []

    def counted(*args):
        pairs = real(*args)
        made.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(jaccard, "block_pairs", counted)
    for earlier in (32, 1):  # a member that names fewer groups only costs more
        monkeypatch.setattr(jaccard, "EARLIER", earlier)
        got = {r["doc_id"]: r["component"] for r in jaccard.near_copies(docs).collect()}
        assert len({(got[i], root[i]) for i in got}) == len(set(root)) == len(set(got.values()))
    assert made[0][0] == made[0][1] > 0 and made[1][0] >= made[1][1]


def test_index_of_fingerprints_names_near_copies(spark, monkeypatch):
    texts = [" ".join(f"b{k}x{i}" for i in range(900)) for k in range(4)]
    texts += [t + " end" for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = jaccard.nodes_of  # without prefixes only the index finds pairs
    monkeypatch.setattr(jaccard, "nodes_of", lambda *a: real(*a).withColumn("prefix", F.array().cast("array<long>")))
    got = {r["doc_id"]: r["component"] for r in jaccard.near_copies(docs).collect()}
    assert all(got[k] == got[k + 4] for k in range(4)) and len(set(got.values())) == 4


def test_sizes_of_a_small_likeness_may_differ_much(spark):
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(words[:n]) for n in (900, 254, 253, 258)] + [" ".join(words[:250] + [f"z{k}"]) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    like = likeness(texts)
    root = list(range(len(texts)))
    for (i, j), s in like.items():
        if s >= 0.25:
            root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    got = {r["doc_id"]: r["component"] for r in jaccard.near_copies(docs, similarity=0.25).collect()}
    assert len({(got[i], root[i]) for i in got}) == len(set(root)) == len(set(got.values()))
