import numpy as np
import regex
from dockflow.llm import classifier
from pyspark.sql import functions as F

import cases


def corpus(spark, n=900):
    """Good texts of words in many orders; bad ones with signs and capitals."""
    word = lambda i: F.concat(F.lit("w"), (F.pmod(F.xxhash64("id", i), F.lit(300))).cast("string"))
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), word)
    text = F.array_join(words, " ")
    bad = F.when(F.col("id") % 10 < 1, F.upper(F.array_join(words, "!! "))).otherwise(F.array_join(words, "*** "))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, bad).otherwise(text).alias("text"))


def test_held_out_accuracy_and_no_leak(spark):
    docs = corpus(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("quality"))
    got = classifier.score(docs, labels)
    held = got.where("held_out")
    assert 120 < held.count() < 240
    right = held.where((F.col("score") >= 0.3) == (F.col("doc_id") % 5 != 0)).count()
    assert right >= 0.97 * held.count()
    # labels of held-out rows change nothing
    turned = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, classifier.score(docs, turned).collect())) == sorted(map(tuple, got.collect()))


TEXTS = ["a b c a", "b b", None, "", "c Été ÉTÉ 12 3,4", "news!!! NEWS!! no!!! b", " \n", "中文 b a", "A b Ab 7"]


def plain_words(text):
    out = []
    for part in regex.findall(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+", text or ""):
        if part[0].isalpha():
            if len(part) > 1 and part.isupper():
                out.append("CAPITALS")
            part = part.lower()
        out.append("NUMBER" if part[0].isnumeric() else part)
    return out


def test_words_have_hashes_of_their_own():
    h, sizes = classifier.words_of(TEXTS)
    want = [plain_words(t) for t in TEXTS]
    assert sizes.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    pairs = set(zip(flat, h.tolist(), strict=True))
    assert len(pairs) == len(set(flat)) == len(set(h.tolist()))
    signs, _ = classifier.words_of(["! !! !!! !!!! !!!!! ****** *****"])
    assert len(set(signs.tolist())) == 7  # runs of different length are different words
    many, _ = classifier.words_of([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(15_000))])
    assert len(set(many.tolist())) == 15_000


def plain_contexts(h, near=classifier.REACH):
    index = classifier.index_vectors(h).astype(int)
    assert (np.abs(index).sum(axis=1) == classifier.NONZERO).all() if len(h) else True
    return [sum((index[j] for j in range(max(0, i - near), min(len(h), i + near + 1)) if j != i), np.zeros(classifier.WIDTH, int)) for i in range(len(h))]


def test_word_vectors_are_sums_over_neighbours(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    counts = {r["h"]: r["n"] for r in classifier.word_counts(docs).collect()}
    want, n = {}, {}
    for t in TEXTS:
        h, _ = classifier.words_of([t])
        for x, v in zip(h.tolist(), plain_contexts(h), strict=True):
            want[x], n[x] = want.get(x, 0) + v, n.get(x, 0) + 1
    assert counts == n
    hashes = np.array(sorted(want))[::2]
    got = {int(hashes[r["row"]]): r["vector"] for r in classifier.word_vectors(docs, spark.sparkContext.broadcast(hashes)).collect()}
    assert got == {int(x): want[x].tolist() for x in hashes.tolist() if want[x].any()}


def test_documents_are_pooled_from_all_their_words():
    h, _ = classifier.words_of(TEXTS)
    frequent = np.unique(h)[::2]
    table = np.random.default_rng(1).normal(size=(len(frequent), classifier.WIDTH)).astype(np.float32)
    words = classifier.Words.__new__(classifier.Words)
    words.__setstate__((frequent, table))
    got = classifier.pooled(TEXTS, words)
    place = {x: k for k, x in enumerate(frequent.tolist())}
    for text, row in zip(TEXTS, got, strict=True):
        own, _ = classifier.words_of([text])
        around, vectors = plain_contexts(own), []
        for x in own.tolist():
            local = sum(v for y, v in zip(own.tolist(), around, strict=True) if y == x)
            vectors.append(table[place[x]] if x in place else local / (np.linalg.norm(local) or 1))
        if not vectors:
            assert not row.any()
            continue
        v = np.array(vectors)
        assert np.allclose(row[: classifier.WIDTH], v.mean(axis=0), atol=1e-5)
        assert np.allclose(row[classifier.WIDTH : -2], v.std(axis=0), atol=1e-3)
        assert np.allclose(row[-2:], [np.log1p(len(own)), np.log1p(len(set(own.tolist()))) - np.log1p(len(own))])


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classifier.score(cases.nothing(spark), none).count() == 0
    assert {r["score"] for r in classifier.score(cases.frame(spark), none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (4, 1), (None, 0), (6, None)], "doc_id long, quality int")
    rows = classifier.score(cases.frame(spark), one).collect()
    assert len(rows) == len(cases.sample()) and all(0 <= r["score"] <= 1 for r in rows)
