import random

import numpy as np
import pytest
from dockflow.llm import repeats
from dockflow.llm.suffixes import permuted_common_prefixes, suffix_array

import cases


def brute(rows):
    """Kept bytes and removed stretches of each row."""
    first: dict = {}
    for row in rows:
        raw, doc = (row[1] or "").encode(), repeats.LAST_ID if row[0] is None else row[0]
        for i in range(len(raw) - 49):
            x = raw[i : i + 50]
            first[x] = min(first.get(x, doc), doc)
    out = []
    for row in rows:
        raw, doc = (row[1] or "").encode(), repeats.LAST_ID if row[0] is None else row[0]
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < doc:
                gone[i : i + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        spans = [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]
        out.append((row[0], len(raw), spans, bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])))
    return sorted(out, key=str)


def found(rows):
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in rows.collect()), key=str)


def test_suffix_arrays():
    r = np.random.default_rng(0)
    for _ in range(300):
        t = np.concatenate([r.integers(1, r.integers(2, 6), r.integers(1, 60)), [0]]).astype(np.uint8)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        sa = suffix_array(t)
        assert sa.tolist() == want
        common = permuted_common_prefixes(t, sa, len(t))
        for a, b in zip(want, want[1:], strict=False):
            x, y = t[a:].tolist(), t[b:].tolist()
            assert common[b] == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_rows(spark, monkeypatch, hot):
    if hot == 2:  # all shared anchors count as hot: windows are dealt one by one
        source = repeats.cutter
        every = type("Every", (), {"__contains__": lambda self, a: True})()
        monkeypatch.setattr(repeats, "cutter", lambda buckets, shards, hot: source(buckets, shards, every))
    assert found(repeats.without_repeats(cases.frame(spark))) == brute(cases.sample())


def test_overlapping_passages(spark):
    r = random.Random(9)
    pool = "".join(r.choice("abcdé \n中") for _ in range(900))
    rows = []
    for i in range(40):
        parts = []
        for _ in range(r.randint(1, 5)):
            at = r.randint(0, 800)
            parts.append(pool[at : at + r.randint(5, 200)])
            parts.append("".join(r.choice("xyz") for _ in range(r.randint(0, 30))))
        rows.append((r.randint(0, 30), "".join(parts), "en", "s", i, None, None, None, None, None))
    assert found(repeats.without_repeats(cases.frame(spark, rows))) == brute(rows)


def test_hot_anchors_are_counted(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "HOT", 3)
    texts = [f"{'q%d ' % i * 12} the same passage in all of these texts, long enough to be found {'r%d ' % i * 12}" for i in range(5)]
    half = [pa.RecordBatch.from_pydict({"key": list(range(a, b)), "text": texts[a:b]}) for a, b in ((0, 3), (3, 5))]
    asked = [x for h in half for x in repeats.questions(1)(iter([h]))]
    asked = sorted((x.slice(k, 1) for x in asked for k in range(x.num_rows)), key=lambda x: x.column(0)[0].as_py())
    got = [r for x in repeats.answers(iter(asked)) for r in x.to_pylist()]
    assert max(r["texts"] or 0 for r in got) == 5
    assert {r["key"] for r in got if r["texts"] is None} == set(range(5))


def test_long_texts_are_looked_at_in_parts(monkeypatch):
    raw = "".join(random.Random(1).choice("abc ") for _ in range(5000)).encode()
    rows = lambda: sorted((int(s + k), int(h)) for h, _, start, n in repeats.all_segments([(1, raw)]) for h, s, m in zip(h, start, n, strict=True) for k in range(m))
    whole = rows()
    monkeypatch.setattr(repeats, "BUFFER", 1 << 10)
    assert [s for s, _ in rows()] == [s for s, _ in whole] == list(range(len(raw) - 49))


def test_whole_characters_stay(spark):
    shared = "é" * 40
    rows = [(1, "a" + shared, *[None] * 8), (2, "b" + shared[1:] + "中c", *[None] * 8)]
    got = repeats.without_repeats(cases.frame(spark, rows), ["doc_id", "n_chars"], whole_characters=True).collect()
    assert sorted(bytes(r["kept"]).decode() for r in got) == ["a" + shared, "b中c"]


def test_empty_table(spark):
    assert repeats.without_repeats(cases.nothing(spark)).count() == 0
