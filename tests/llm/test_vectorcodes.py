import hashlib
import math
import random

import numpy as np
import pytest
from dockflow.llm import queries, vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, n long, position string, v int, codes int"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "p", 1, 2) for r in rows], SCHEMA).repartition(3)


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error), codebook digest; one vector at a time."""
    kept = []
    for vec_id, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    dims = len(kept[0][1])
    ends = [dims * p // parts for p in range(parts + 1)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(ends, ends[1:], strict=False)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                part = v[ends[p] : ends[p + 1]]
                groups.setdefault(nearest(part, book)[1], []).append(part)
            for e, members in groups.items():
                book[e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, totals = [], {}
    for vec_id, v, label in kept:
        found = [nearest(v[ends[p] : ends[p + 1]], book) for p, book in enumerate(books)]
        out.append((vec_id, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        totals[label] = totals.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, totals[label]) for i, c, e, label in out), key=repr), digest


def result(rows, books):
    got = [(r["vec_id"], "".join(f"{e:02x}" for e in r["codes"]), r["error"], r["label_error"]) for r in rows.collect()]
    return sorted(got, key=repr), vectorcodes.digest(books)


def vectors(n, dims, seed=1, step=16):
    """Components from few values, so that parts share prefixes and distances tie."""
    r = random.Random(seed)
    rows = [(i, [r.randrange(-step, step) / step for _ in range(dims)], r.choice([0, 1, None])) for i in range(n)]
    return rows + [(n + i, rows[0][1], 2) for i in range(n)]  # as many copies


@pytest.mark.parametrize(("n", "dims", "entries", "step"), [(150, 8, 20, 2), (120, 16, 256, 200), (60, 6, 8, 3), (3, 8, 256, 4)])
def test_equals_one_by_one(spark, n, dims, entries, step):
    rows = vectors(n, dims, n, step)
    assert result(*vectorcodes.compress(table(spark, rows), entries=entries)) == plain(rows, entries=entries)


def test_odd_rows(spark):
    r = random.Random(4)
    good = [(k, [r.uniform(-1, 1) for _ in range(8)], k % 2) for k in range(40)]
    good += [good[3], good[3], (None, good[5][1], None), (7, [0.0] * 8, 0), (-5, [-0.0] * 8, 0)]
    odd = [(100, None, 1), (101, [0.5, None] * 4, 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] + [0.0] * 7, 1)]
    odd += [(104, [1.0] * 7, 1), (105, [], 1), (106, [3e38] * 8, 1), (107, [131072.0] + [0.0] * 7, None)]
    assert result(*vectorcodes.compress(table(spark, good + odd), entries=16)) == plain(good, entries=16)
    rows, books = vectorcodes.compress(table(spark, odd[:4]))
    assert rows.count() == 0 and vectorcodes.digest(books) == hashlib.sha256(b"").hexdigest()
    assert vectorcodes.compress(table(spark, [(1, [], 1)]))[0].collect()[0]["error"] == 0
    assert vectorcodes.compress(table(spark, []).limit(0))[0].count() == 0


def test_large_components_stay_exact(spark):
    r = random.Random(6)
    rows = [(k, [r.uniform(-131071, 131071) for _ in range(4)], None) for k in range(60)]
    assert result(*vectorcodes.compress(table(spark, rows), entries=7)) == plain(rows, entries=7)


@pytest.mark.parametrize("strip", [1, 7, 1 << 19])
def test_shared_prefixes_change_no_distance(monkeypatch, strip):
    monkeypatch.setattr(vectorcodes, "STRIP", strip * 10)
    r = np.random.default_rng(2)
    leaves = np.unique(r.integers(-2, 3, (400, 5)), axis=0)
    book = r.integers(-2, 3, (10, 5))
    index, distance = vectorcodes.nearest(leaves, book)
    want = ((leaves[:, None] - book[None]) ** 2).sum(axis=2)
    assert (distance == want.min(axis=1)).all() and (index == want.argmin(axis=1)).all()


def test_bytes_sort_as_numbers():
    r = np.random.default_rng(3)
    v = r.integers(-(2**27), 2**27, (300, 3))
    raw = [x.tobytes() for x in vectorcodes.packed(v)]
    assert sorted(raw) == [x.tobytes() for x in vectorcodes.packed(v[np.lexsort(v.T[::-1])])]
    assert (vectorcodes.unpacked(raw, 3) == v).all()


def test_query_columns(spark, tmp_path):
    rows = vectors(300, 16, 9, 50)
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, digest = plain(rows)
    got = queries.op12_vectorcodes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(*r, digest) for r in want]


def test_decoded_vectors_have_the_stated_error(spark):
    rows = vectors(80, 8, 3, 40)
    coded, books = vectorcodes.compress(table(spark, rows), entries=9)
    of = {r[0]: np.floor(np.array(r[1]) * 1024) for r in rows}
    for r in coded.collect():
        back = vectorcodes.decode(np.array([r["codes"]]), books)[0] * 1024
        assert round(((back - of[r["vec_id"]]) ** 2).sum()) == r["error"]
