"""The corpus pipeline: stages over documents, each written and read again.

Defined cases: documents with a NULL, empty or blank text fail the quality rules;
NULL ids, repeated rows, ties and very long texts are treated as each operator
says; further columns may have any names and stay as they are, but for n_chars,
which follows the text; empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from dockflow.llm import jaccard, packing, quality, repeats, secrets, simhash
from dockflow.llm.common import discard, materialise, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Shingles of five words, Jaccard of 0.8 or more.
NEAR = {"words": 5, "similarity": 0.8}


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the base or a certified rule go."""
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays, the one of the smallest id."""
    return simhash.one_of_each(docs, jaccard.near_copies(docs, **NEAR))


def repeated_passages(spark, docs, sf_dir):
    """Passages of 50 bytes or more that an earlier document has are cut out."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # its names may be any
    rows = repeats.without_repeats(docs.select(row, "doc_id", "text"), ["row"], whole_characters=True)
    cut = F.size("spans") > 0
    text = F.when(cut, F.decode("kept", "UTF-8")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(cut, F.length(text).cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(F.col(f"row.`{c}`") if new.get(c) is None else new[c]).alias(c) for c in docs.columns])


def secret_scan(spark, docs, sf_dir):
    """Secrets are masked."""
    rows = secrets.masked(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return rows


def pack(spark, docs, sf_dir):
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeats", repeated_passages),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: The stages on fingerprints and suffix arrays have no form in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; each one's rows are written as Parquet."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
