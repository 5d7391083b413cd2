import math
import re
from collections import Counter

from dockflow.llm import quality
from pyspark.sql import functions as F

import cases


def counted(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    times = Counter(windows)
    again = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_measures(spark):
    rows = quality.measures(cases.frame(spark))
    got = rows.select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(got) == len(cases.sample())
    for text, *found, failed in got:
        assert tuple(found) == counted(text)
        assert failed == (found[0] < 50 or 100 * found[4] > 50 * found[0])


def test_exact_bound(spark):
    cells = [(n, k, a, e) for n in (0, 1, 20, 300, 1000) for k in (0, 1, 5) if k <= n for a in (0.01, 0.05) for e in (0.05, 0.001)]
    rows = spark.createDataFrame(cells, "n long, k long, a double, e double")
    for a in (0.01, 0.05):
        for n, k, _, e, holds in rows.where(F.col("a") == a).withColumn(
            "holds", quality.share_bound_holds(F.col("n"), F.col("k"), a, F.col("e"))
        ).collect():
            tail = sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))
            assert bool(holds) == (k < n * a and tail <= e), (n, k, a, e)


def test_cutoffs_reject_junk_and_keep_clean_texts(spark):
    docs = spark.range(2400).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 4 == 0, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id")).cast("string"), F.lit("***"))), " "))
        .otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id")).cast("string"))), " ")).alias("text"),
        F.when(F.col("id") < 2300, "en").alias("lang"),
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality")).union(spark.createDataFrame([(None, 1), (99999, 1), (1, None)], "doc_id long, quality int"))
    got = quality.judge(docs, labels).groupBy("stratum", (F.col("doc_id") % 4 == 0).alias("junk"), "kept").count().collect()
    # the large stratum has a cutoff; the small one keeps all that pass the base
    assert sorted((r["stratum"] or "", r["junk"], r["kept"], r["count"]) for r in got) == [
        ("", False, True, 75), ("", True, True, 25), ("en", False, True, 1725), ("en", True, False, 575),
    ]
    kept = quality.kept_rows(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 1825


def test_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(cases.nothing(spark), labels).count() == 0
    rows = quality.judge(cases.frame(spark), labels)
    assert rows.count() == len(cases.sample())
    assert rows.where("kept = base_failed").count() == 0  # without labels only the base counts
