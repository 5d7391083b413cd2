"""Document fingerprints from closed syncmers.

A k-mer of words is an anchor if the smallest hash of its inner substrings lies
at its first or last place.  Whether it is one depends on its own words only, so
the same passage has the same anchors in any document, wherever it stands.  A
fingerprint is all anchors with their places, about one for two words.  Two of
them are compared by position: the likeness is the share of all anchors that both
have at an offset which another shared anchor has too, so a passage counts wherever
it was moved to and a lone chance match does not.  Only SQL functions are used.

Defined cases: NULL and empty texts have no anchors and an empty fingerprint;
blank texts too; two fingerprints without anchors are alike (1.0), one without
and one with are not (0.0); a text with words but no closed syncmer (always one of
fewer words than a k-mer) has one anchor, all its words, so an empty fingerprint
means no words; equal texts have equal fingerprints.  Rows with equal ids follow
each other in the order of their texts, rows with a NULL id come first; a single
document is its own next one.  Only doc_id and text are read; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.llm.common import materialise, words_of

K = 5  # words of a k-mer
INNER = 2  # words of its inner substrings
SKETCH = 32  # the fewest anchors of a long passage that tests expect; no bound
ROWS_PER_CELL = 500


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not at each place of use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def inner_hashes(words: Column) -> Column:
    """Hash of each inner substring, by place."""
    n = F.size(words)
    at = F.when(n >= INNER, F.sequence(F.lit(0), n - INNER)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(INNER)]))


def whole_text(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def anchors(words: Column, inner: Column) -> Column:
    """Hashes of the closed syncmers, NULL at places that have none.

    The place in the array is the place of the k-mer in the document.
    """
    n = F.size(words)
    last = K - INNER  # place of a k-mer's last inner substring

    def anchor(i: Column) -> Column:
        h = [F.get(inner, i + j) for j in range(last + 1)]
        closed = F.least(h[0], h[last]) <= F.least(*h[1:last])
        return F.when(closed, F.xxhash64(*h))

    many = F.transform(F.sequence(F.lit(0), n - K), anchor)
    short = F.array(whole_text(words))
    none = F.array().cast("array<bigint>")
    return F.when(n >= K, many).when(n > 0, short).otherwise(none)


def placed(text: Column) -> Column:
    """All anchors of a text in order: structs of place and hash."""

    def of_words(words: Column) -> Column:
        found = once(inner_hashes(words), lambda inner: anchors(words, inner))
        found = F.transform(found, lambda h, i: F.struct(i.alias("place"), h.alias("hash")))
        whole = F.array(F.struct(F.lit(0).alias("place"), whole_text(words).alias("hash")))
        found = F.filter(found, lambda s: s["hash"].isNotNull())
        return once(found, lambda a: F.when((F.size(a) == 0) & (F.size(words) > 0), whole).otherwise(a))

    return once(words_of(text), of_words)


def sketch(text: Column) -> Column:
    """The hashes of all anchors, by place."""
    return F.transform(placed(text), lambda s: s["hash"])


def as_text(fingerprint: Column) -> Column:
    """For each anchor 8 lowercase hexadecimal digits of the place and 16 of the hash."""
    one = lambda s: F.concat(F.lpad(F.hex(s["place"]), 8, "0"), F.lpad(F.hex(s["hash"]), 16, "0"))
    return F.lower(F.array_join(F.transform(fingerprint, one), ""))


def offsets(a: Column, b: Column) -> Column:
    """Place in ``b`` minus place in ``a`` of each shared anchor.  Of an anchor that
    is there again, the first ones are a pair, then the second ones and so on."""

    def tagged(of: Column, side: int) -> Column:
        return F.transform(of, lambda s: F.struct(s["hash"].alias("hash"), F.lit(side).alias("side"), s["place"].alias("place")))

    def pairs(s: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(s, i)["hash"] == x["hash"], F.lit(False))

        def where(of) -> Column:
            return F.array_compact(F.transform(s, lambda x, i: F.when(of(x, i), i)))

        begins = where(lambda x, i: ~same(x, i - 1) & same(x, i + 1))
        ends = where(lambda x, i: same(x, i - 1) & ~same(x, i + 1))

        def of_run(q: Column) -> Column:
            n = F.size(F.filter(q, lambda x: x["side"] == 0))
            return once(n, lambda n: F.transform(F.slice(q, n + 1, F.least(n, F.size(q) - n)), lambda x, k: x["place"] - F.get(q, k)["place"]))

        runs = F.arrays_zip(begins.alias("begin"), ends.alias("end"))
        return F.flatten(F.transform(runs, lambda r: once(F.slice(s, r["begin"] + 1, r["end"] - r["begin"] + 1), of_run)))

    return once(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), pairs)


def likeness(a: Column, b: Column) -> Column:
    """Share of all anchors (0 to 1) that match by position: another shared anchor
    has the same offset, or one of the texts has a single anchor."""
    few = F.least(F.size(a), F.size(b)) < 2

    def matched(d: Column) -> Column:
        again = F.filter(d, lambda x, i: F.coalesce(F.get(d, i - 1) == x, F.lit(False)) | F.coalesce(F.get(d, i + 1) == x, F.lit(False)))
        return F.when(few, F.size(d)).otherwise(F.size(again))

    none = (F.size(a) == 0) & (F.size(b) == 0)
    apart = ~F.arrays_overlap(a["hash"], b["hash"])  # spares the sort
    shared = once(F.sort_array(offsets(a, b)), matched)
    share = once(shared, lambda n: n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1)))
    return F.when(none, F.lit(1.0)).when(apart, F.lit(0.0)).otherwise(share)


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the following row, by doc_id and text; the last
    row is followed by the first.

    Rows are dealt into cells of ids.  The first row of each cell is also given
    to the cell before, so a cell finds all its followers itself; texts move once.
    """
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * ROWS_PER_CELL // max(n, 1))
    cell = F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / width), F.lit(-1))
    placed = rows.withColumn("_cell", cell.cast("long"))
    # which cells there are, and which one comes before each
    cells = materialise(placed.groupBy("_cell").agg(F.min("doc_id").alias("_first")))
    # numbered by ranges of cells, whose borders are looked up in one small table
    group = F.floor(F.col("_cell") / 1000)
    edges = cells.groupBy(group.alias("_group")).agg(F.max("_cell").alias("_top"))
    over_groups = Window.orderBy("_group")  # a row for each million of places
    edges = edges.withColumn("_under", F.lag("_top").over(over_groups)).select("_group", "_under")
    inside = Window.partitionBy("_group").orderBy("_cell")
    before = cells.withColumn("_group", group).join(edges, "_group")
    before = before.withColumn("_before", F.coalesce(F.lag("_cell").over(inside), F.col("_under")))
    last = cells.agg(F.max("_cell")).first()[0]
    before = before.select("_cell", "_first", F.coalesce("_before", F.lit(last)).alias("_before"), F.col("_before").isNull().alias("_wraps"))
    known = placed.join(before, "_cell")
    leads = (F.col("doc_id") == F.col("_first")) | F.col("doc_id").isNull()
    roles = F.array(
        F.struct(F.col("_cell").alias("to"), F.lit(0).alias("guest")),
        F.when(leads, F.struct(F.col("_before").alias("to"), F.when(F.col("_wraps"), 2).otherwise(1).alias("guest"))),
    )
    dealt = known.select(*rows.columns, F.explode(F.array_compact(roles)).alias("_r"))
    dealt = dealt.select(*rows.columns, F.col("_r.to").alias("_to"), F.col("_r.guest").alias("_guest"))
    order = Window.partitionBy("_to").orderBy("_guest", "doc_id", "text")
    followed = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return followed.where("_guest = 0").drop("_to", "_guest")


def edited(text: Column, following: Column) -> Column:
    """The second half replaced by as much of the following text's begin."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, fingerprint, those of the edited text, and likeness."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # anchors are found where they are compared: only texts move
    rows = with_next(rows, ["text"])
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    texts = {"anchors": "text", "edited_anchors": "edited", "next_anchors": "next_text"}
    rows = rows.withColumns({name: placed(F.col(c)) for name, c in texts.items()})
    return rows.select(
        "doc_id",
        "edited",
        F.length("text").cast("long").alias("n_chars"),
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
