"""Quality rules whose cutoffs come with a guarantee.

Each rule rejects a text when a share or mean is over a cutoff.  Per stratum
(language) and rule, cutoffs are tried from the loosest on: a cutoff stands if an
exact binomial bound on labelled good texts says that it rejects at most a given
share of good ones.  Trying stops at the first one that fails (fixed sequence);
the error is divided over all pairs of stratum and rule (Bonferroni), the
allowed share over the rules.  So with probability ``1 - delta`` the rules
together reject at most ``max_false`` of the good texts in every stratum.  A
stratum with too few labels gets no cutoffs and keeps its texts.

Defined cases: NULL and empty texts have no words and fail the base; a NULL
language is a stratum of its own; labels count once per document and value, and
those of unknown documents or without a value don't count; repeated rows are
judged alike; only doc_id, text and the stratum are read, so other columns may
have any names; empty tables give empty results.  Windows of three words are
compared by their 64-bit hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import materialise, words_of

SYMBOLS = "[#*$%&|<>]"

#: Rule: value that must not be over the cutoff, and the cutoffs, loosest first.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05]),
    "repeats": ("n_repeat_words / n_words", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "lines": ("n_dup_lines / n_lines", [0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "marks": ("n_marks / n_words", [1.0, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "length": ("word_chars / n_words", [14.0, 12.0, 10.0, 9.0, 8.0, 7.0, 6.5, 6.0]),
}

MIN_WORDS = 50
MAX_FALSE = 0.05
DELTA = 0.05


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many words lie in a three-word window that occurs again."""
    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        again = F.filter(
            s,
            lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"]))
            | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    # bind the sorted windows once: an array of one element, mapped
    at = F.flatten(F.transform(F.array(order), places))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the counts that the rules use, and the row itself."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select("doc_id", F.col(stratum).alias("stratum"), text.alias("text"), row.alias("row"))
    rows = rows.select("*", words_of(F.col("text")).alias("words"))
    n = F.size("words")
    window = F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(
        window,
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("*", hashes.alias("hashes"), lines.alias("lines"))
    return rows.select(
        "doc_id",
        "stratum",
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("hashes")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    )


def share_bound_holds(n: Column, k: Column, share: float, error: Column | float) -> Column:
    """P(Binomial(n, share) <= k) <= error: seeing k of n, the true share is at
    most ``share`` by the exact one-sided bound."""
    odds = math.log(share / (1 - share))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(-F.abs(a["sum"] - term)))).alias("sum"))

    none = (n * math.log1p(-share)).cast("double")
    tail = F.aggregate(
        F.sequence(F.lit(1).cast("long"), k),
        F.struct(none.alias("term"), none.alias("sum")),
        step,
        lambda a: a["sum"],
    )
    tail = F.when(k == 0, none).otherwise(tail)
    return (k < n * share) & (tail <= F.log(error))


def cutoffs(
    rows: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, delta: float = DELTA
) -> DataFrame:
    """stratum and one column per rule: the strictest cutoff that stands, or NULL."""
    known = labels.select("doc_id", "quality").dropDuplicates()
    good = rows.where(~F.col("base_failed")).join(known.where("quality = 1"), "doc_id")
    counts = [F.count(F.lit(1)).alias("n")]
    for name, (value, grid) in RULES.items():
        counts += [F.count(F.when(F.expr(value) > c, 1)).alias(f"{name}_{j}") for j, c in enumerate(grid)]
    held = good.groupBy("stratum").agg(*counts)
    held = materialise(held)
    error = F.lit(delta / (max(1, held.count()) * len(RULES)))
    chosen = [F.col("stratum")]
    for name, (_, grid) in RULES.items():
        stands = F.array(
            *[
                share_bound_holds(F.col("n"), F.col(f"{name}_{j}"), max_false / len(RULES), error)
                for j in range(len(grid))
            ]
        )
        first_failure = F.array_position(stands, F.lit(False)).cast("int")
        passed = F.when(first_failure == 0, len(grid)).otherwise(first_failure - 1)
        chosen.append(F.get(F.array(*map(F.lit, grid)), passed - 1).alias(f"max_{name}"))
    return held.select(*chosen)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds failed_rules and kept to measures."""
    joined = rows.join(limits.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")), "left")
    failed = F.array_compact(
        F.array(*[F.when(F.expr(value) > F.col(f"max_{name}"), F.lit(name)) for name, (value, _) in RULES.items()])
    )
    # the base rules first: a text without words has no shares
    failed = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed)
    return joined.select(*rows.columns, failed.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The measures of each text with base_failed, failed_rules and kept."""
    rows = materialise(measures(docs, stratum).drop("row"))
    return judged(rows, materialise(cutoffs(rows, labels)))


def kept_rows(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Rows are written with their measures, so that texts needn't move to meet
    their verdicts, and no filter is pushed into the making of the measures.
    """
    rows = materialise(measures(docs, stratum))
    limits = materialise(cutoffs(rows.drop("row"), labels))
    return judged(rows, limits).where("kept").select("row.*")
