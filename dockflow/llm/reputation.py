"""URL filter: fixed rules first, then the reputation of the host.

Labelled outcomes (bad or not) of pages are counted per host.  A host's bad rate
has a beta prior around the rate of its registered domain, the domain's around
that of its suffix, the suffix's around the overall rate.  The strength of the
prior of each level is fitted to the data (moments of the beta-binomial), so
hosts with few labels lean on their domain and hosts with many on themselves.
A page is blocked if the posterior bound says so: its host's bad rate is over
``max_bad`` with probability ``confidence`` or more.

Defined cases: a NULL url or one without ``://`` has an empty host and path, and
is judged as the host of that name; hosts without labels get their domain's
prior, and no label at all lets all pass; outcomes count once per page row, NULL outcomes not at all; repeated rows
are judged alike; only page_id and url are read; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from dockflow.llm.common import materialise

#: Suffixes of two labels under which names are registered; others have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "com.br", "co.jp", "co.nz", "co.za", "com.cn")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_BAD = 0.4
CONFIDENCE = 0.95
LEVELS = ("suffix", "domain", "host")
#: The overall bad rate before any label is seen; it counts for one page.
AT_FIRST = 0.1
#: The strength of a prior stays between these numbers of pages.
WEAKEST, STRONGEST = 0.1, 1e5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where there is no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, UPPER.lower()), F.regexp_extract(url, parts, 2)


def registered(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain of a host."""
    short = F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    labels = F.when(short, 2).otherwise(1)
    suffix = F.when(short, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(labels == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return suffix, domain


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict.  ``rules``: (verdict, host/path),
    a list that a person keeps, tested in place from the longest on."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{tail}")
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def beta_cdf(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(Beta(a, b) <= x) by the continued fraction of the incomplete beta."""
    flip = x > (a + 1) / (a + b + 2)  # the fraction converges fast on one side
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c = np.ones_like(p)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for top in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-12):
            break
    return np.where(flip, 1 - front * h, front * h)


def strength(rows: DataFrame) -> float:
    """Pages that the prior counts for.  ``rows``: n, k and the prior rate of
    each group; the groups' spread beyond the binomial one gives the
    correlation inside a group, and that the strength."""
    spread = (F.col("k") - F.col("n") * F.col("prior")) ** 2
    spread = spread / (F.col("n") * F.col("prior") * (1 - F.col("prior")))
    total = rows.where("n > 0").agg((F.sum(spread) - F.count(F.lit(1))).alias("over"), F.sum(F.col("n") - 1).alias("pairs"))
    over, pairs = total.first()
    if not pairs or over is None or over <= 0:
        return STRONGEST
    within = min(1.0, over / float(pairs))
    return min(STRONGEST, max(WEAKEST, (1 - within) / within))


def host_reputation(pages: DataFrame, outcomes: DataFrame, max_bad: float = MAX_BAD) -> DataFrame:
    """host, n, k, prior and posterior rate, and the probability of a rate over
    ``max_bad``.  ``pages``: host of each page; ``outcomes``: host, bad (boolean)."""
    seen = outcomes.where(F.col("bad").isNotNull()).select("host", F.lit(1).alias("n"), F.col("bad").cast("int").alias("k"))
    rows = pages.select("host", F.lit(0).alias("n"), F.lit(0).alias("k")).unionByName(seen)
    rows = rows.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffix, domain = registered(F.col("host"))
    hosts = materialise(rows.withColumns({"suffix": suffix, "domain": domain}))
    n, k = hosts.agg(F.sum("n"), F.sum("k")).first()
    overall = ((k or 0) + AT_FIRST) / ((n or 0) + 1)
    above = None
    for level in LEVELS:
        keys = list(LEVELS[: LEVELS.index(level) + 1])
        counts = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if above is None:
            counts = counts.withColumn("prior", F.lit(overall))
        else:
            counts = counts.join(above.select(*keys[:-1], F.col("rate").alias("prior")), keys[:-1])
        counts = materialise(counts)
        m = strength(counts)
        above = counts.withColumn("m", F.lit(m)).withColumn(
            "rate", (F.col("m") * F.col("prior") + F.col("k")) / (F.col("m") + F.col("n"))
        )

    @pandas_udf("double")
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(1 - beta_cdf(max_bad, a.to_numpy(float), b.to_numpy(float)))

    a = F.col("m") * F.col("prior") + F.col("k")
    b = F.col("m") * (1 - F.col("prior")) + F.col("n") - F.col("k")
    return above.select("host", "n", "k", "prior", "rate", over(a, b).alias("p_over"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    max_bad: float = MAX_BAD,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior rate.

    ``outcomes``: url, bad (boolean), one row per labelled page.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = outcomes.select(host.alias("host"), "bad")
    hosts = materialise(host_reputation(rows, labelled, max_bad))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("p_over") >= confidence, "block").otherwise("allow"))
    rows = rows.join(hosts.select("host", "n", "rate", "p_over"), "host", "left")
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "n", "rate", "p_over"
    )
