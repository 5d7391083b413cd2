import numpy as np
import pytest
from dockflow.llm import repeats
from test_repeats import brute
from test_syncmers_secrets import base_spans

import cases
import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, copies, a near copy, a shared passage, secrets and junk."""
    path = str(tmp_path_factory.mktemp("sf"))
    words = lambda d, n: " ".join(f"w{(i * i * 31 + d * 977 + i) % 5003}" for i in range(n))
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(d, words(d, 120)) for d in range(20)]
    rows += [(20, words(3, 120)), (21, words(4, 120).replace(words(4, 120).split()[60], "changed", 1)), (7, words(7, 120))]
    rows += [(30, f"{words(30, 80)}\n{passage}\n{words(31, 80)}"), (31, f"{words(32, 80)}\n{passage}\n{words(33, 80)}")]
    rows += [(40, words(40, 70) + " password = abcdefgh12345 " + words(41, 30)), (41, "too short"), (42, None), (43, "Again and " * 90)]
    rows = [(d, t, "en", "s", None if t is None else len(t), "w", 1, "r", None, 2) for d, t in rows]
    cases.frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(d, 1, 0) for d in range(10)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, folder))
        steps[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {n: sorted(r["doc_id"] for r in d.collect()) for n, d in steps.items()}
    clean = [*range(20), 30, 31, 40]
    assert ids["quality"] == sorted([*clean, 7, 20, 21])
    assert ids["near_duplicates"] == ids["repeats"] == ids["secrets"] == clean
    before = [tuple(r) for r in steps["near_duplicates"].collect()]
    kept = {r[0]: r[3].decode() for r in brute(before)}
    after = {r["doc_id"]: r for r in steps["repeats"].collect()}
    assert {d: r["text"] for d, r in after.items()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert len(kept[31]) < 1200 < len(next(r[1] for r in before if r[0] == 31))
    texts = {r["doc_id"]: r["text"] for r in steps["secrets"].collect()}
    assert "[SECRET]" in texts[40] and not any(base_spans(t) for t in texts.values())
    assert {d for d, t in texts.items() if t != kept[d]} == {40}
    places: dict = {}
    for r in steps["packing"].collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert set(ids["packing"]) == set(clean)
    assert sorted(map(tuple, pipeline.run(spark, folder).select("doc_id", "piece", "length").collect())) == sorted(
        map(tuple, steps["packing"].select("doc_id", "piece", "length").collect())
    )


def test_empty_tables(spark, tmp_path):
    cases.nothing(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert repeats.removals(cases.nothing(spark)).count() == 0
