import hashlib
import random

import cases
import numpy as np
import pytest
from dockflow.llm import queries, substrings


def brute(rows, window):
    """Kept words of each row, in order."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    big = float("inf")
    first = {}
    for d, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, big), big if d is None else d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (big if d is None else d):
                gone |= set(range(i, i + window))
        out.append((d, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


def found(docs, **options):
    rows = substrings.without_repeats(docs, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["kept"]) for r in rows), key=repr)


def mixture(seed):
    r = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(r.randint(3, 60))] for k in range(12)]
    rows = []
    for d in range(90):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(passages) if r.random() < 0.6 else [f"w{r.randrange(30)}" for _ in range(r.randint(1, 20))]
        rows.append((d, r.choice([" ", "\n", "  "]).join(words)))
    rows += [(r.choice([None, 3, 200 + k]), r.choice(rows)[1]) for k in range(15)]
    rows += [(300, "same " * 500), (301, "same " * 40), (302, "same " * 12), (303, "same " * 13)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "start"), [(13, 4), (5, 4), (4, 4), (2, 4), (1, 4), (16, 2)])
def test_equals_brute_force(spark, monkeypatch, window, start):
    rows = mixture(window)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs, window=window, start=start) == brute(rows, window)


def test_blocks_lose_nothing(monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 50)
    pieces = [substrings.word_hashes(t) for _, t in mixture(77)]
    whole = list(substrings.blocks((k, 0, [p[:9], p[9:]]) for k, p in enumerate(pieces)))
    assert len(whole) > 5 and sum(len(w) for _, _, held in whole for w in held) == sum(map(len, pieces))


def test_odd_rows(spark):
    rows = cases.sample()
    assert found(cases.frame(spark)) == brute([(x[0], x[1]) for x in rows], 13)
    assert substrings.without_repeats(cases.nothing(spark)).count() == 0


def test_hashes_of_a_window_depend_on_its_words_alone():
    r = np.random.default_rng(3)
    words = r.integers(0, 2**63, 40).astype(np.uint64)
    for length in (1, 2, 3, 4, 7, 8, 13, 26):
        for lane in (0, 1):
            h = substrings.doubled(words, length, lane)
            assert len(h) == 41 - length
            assert all(substrings.doubled(words[i : i + length], length, lane)[0] == h[i] for i in range(len(h)))
    assert substrings.lengths(13) == [4, 8, 13] and substrings.lengths(3) == [3] and substrings.lengths(16, 2) == [2, 4, 8, 16]


def test_a_passage_in_many_documents_is_sent_once_per_block():
    passage = [f"p{i}" for i in range(20)]
    pieces = [substrings.word_hashes(" ".join([*passage, f"own{k}"])) for k in range(500)]
    run = substrings.claimer(lambda _: ((k, k, [p]) for k, p in enumerate(pieces)), 13, 4, 2)
    sent = [(b, len(h)) for batch in run(iter([])) for b, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if b >= 0]
    assert sum(n for _, n in sent) == 8 + 500  # the passage's windows once, and each document's own


def test_query_columns(spark, tmp_path):
    rows = mixture(5)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_substrings(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows, 13)), key=repr)
