"""Documents with all that a table may hold, and plain versions to hold results against."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, h long, row string, key int, shard int"


def sample(seed: int = 1) -> list[tuple]:
    """NULLs in every column, empty, blank and very long texts, copies, near
    copies, repeated rows and ids; further columns with names that operators use."""
    r = random.Random(seed)
    syllables = ["tha", "er", "in", "ou", "sch", "é", "ño", "on", "ti", "re", "x9", "中"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(30)
    base = text(90)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", " \n\t ", "one", "two words", base, base, base, " ".join(near), text(4000), "a" * 3000]
    texts += [text(r.randint(1, 120)) for _ in range(20)]
    texts += [f"{text(20)}\n{passage}\n{text(r.randint(0, 40))}" for _ in range(6)]
    texts += ["again and again " * 40, "Loud*** news### here$$$ " * 25, "line one here\n" * 12 + text(60), "x\ufffdy\x85z\u2028w\x1cv"]
    texts += ["api_key = 'abcDEF123456' and AKIA" + "Q" * 16 + " " + "0123456789abcdef" * 2, "Token: short, PASSWORD=longenough1"]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s1", None]), None, "w", 7, "r", None, 3) for i, t in enumerate(texts)]
    r.shuffle(rows)
    rows += [rows[3], rows[3], (rows[5][0], "same id, other text", "en", None, 3, None, None, None, 1, None)]
    rows += [(None, base, "en", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


def more(df):
    """Further columns, with names of results and with a dot."""
    return df.withColumns({"kept": F.lit("k"), "spans": F.lit(1), "n_bytes": F.lit(2.5), "x.y": F.lit("z")})


def frame(spark, rows=None):
    return more(spark.createDataFrame(sample() if rows is None else rows, SCHEMA)).repartition(3)


def nothing(spark):
    return more(spark.createDataFrame([], SCHEMA))
