"""Secret scans over a trigram inverted index.

Each rule's regex comes as a small pattern from which both are made: the regular
expression and a Boolean query (AND / OR) of trigrams that every match must
contain.  The index lists, for each trigram of the queries, the documents that
hold it; a query intersects and unites these postings, and the rule's regex runs
on its candidates only.  A rule without a mandatory trigram runs on every text.
Trigrams are compared without case, so a candidate set is never too small.  Only
SQL functions are used.

Defined cases: NULL and empty texts have no secrets; rows with a NULL id are
found by their text like all others; repeated rows are scanned alike; only doc_id and
text are read; empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import materialise
from dockflow.llm.syncmers import once

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# --- patterns: a regex and the trigram query that follows from it ---------------

#: A query: None (any text may match), a trigram, or ("and" | "or", {queries}).
Query = None | str | tuple


def both(a: Query, b: Query) -> Query:
    parts = frozenset(x for x in (a, b) if x is not None)
    return None if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else a if a == b else ("or", frozenset((a, b)))


def trigrams(text: str) -> Query:
    text = text.lower()
    return reduce(both, (text[i : i + 3] for i in range(len(text) - 2)), None)


@dataclass(frozen=True)
class Pattern:
    """``texts``: the strings it can be, where these are few; else None."""

    regex: str
    query: Query
    texts: tuple[str, ...] | None = None

    def __add__(self, other: Pattern) -> Pattern:
        regex = self.regex + other.regex
        if self.texts is not None and other.texts is not None and len(self.texts) * len(other.texts) <= 64:
            texts = tuple(a + b for a in self.texts for b in other.texts)
            return Pattern(regex, reduce(either, map(trigrams, texts)), texts)
        return Pattern(regex, both(self.query, other.query))

    def __or__(self, other: Pattern) -> Pattern:
        texts = None if self.texts is None or other.texts is None else self.texts + other.texts
        return Pattern(f"{self.regex}|{other.regex}", either(self.query, other.query), texts)


def lit(text: str, any_case: bool = False) -> Pattern:
    regex = re.escape(text)
    return Pattern(f"(?i:{regex})" if any_case else regex, trigrams(text), (text,))


def maybe(inner: Pattern) -> Pattern:
    return Pattern(f"(?:{inner.regex})?", None, None if inner.texts is None else ("", *inner.texts))


def group(inner: Pattern, kept: bool = True) -> Pattern:
    return Pattern(f"({inner.regex})" if kept else f"(?:{inner.regex})", inner.query, inner.texts)


def chars(regex: str) -> Pattern:
    """A class with its repetition: nothing mandatory is known of it."""
    return Pattern(regex, None)


@dataclass(frozen=True)
class Rule:
    """A match counts if ``part`` (0: all of it) has ``least`` characters."""

    kind: str
    pattern: Pattern
    part: int = 0
    least: int = 1


WORDS = reduce(Pattern.__or__, (lit(w, any_case=True) for w in ("password", "passwd", "secret", "token")))
KEY = lit("api", any_case=True) + maybe(lit("_")) + lit("key", any_case=True)
QUOTE = chars("[\"']?")

BLOCK = 256  # elements of running totals added up one by one

#: All up to the END line; nothing if there is none before the next key begins.
KEY_BODY = chars("(?:(?:[^-]|-(?!----(?:BEGIN |END [A-Z ]{0,40}PRIVATE KEY-----)))*+-----END [A-Z ]{0,40}PRIVATE KEY-----)?")

#: The kinds in the order that breaks ties of a start; the first three are the base.
#: Runs that are too short can't hold a longer match, so the lengths of ``access``
#: and ``hex`` stand in their patterns.
RULES = (
    Rule("assign", group(WORDS | KEY) + QUOTE + chars(r"\x20*[:=]\x20*") + QUOTE + chars("([A-Za-z0-9+/_.=-]+)"), 2, 8),
    Rule("access", lit("AKIA") + chars("[A-Z0-9]{12,}")),
    Rule("hex", chars("[0-9a-f]{32,}")),
    Rule("private", lit("-----BEGIN ") + chars("[A-Z ]{0,40}") + lit("PRIVATE KEY-----") + KEY_BODY),
    Rule("github", group(lit("ghp_") | lit("gho_") | lit("ghs_") | lit("ghr_") | lit("ghu_"), kept=False) + chars("[A-Za-z0-9]{36,}")),
    Rule("slack", lit("xox") + chars("[abprs]-[A-Za-z0-9-]{10,}")),
    Rule("jwt", lit("eyJ") + chars(r"[A-Za-z0-9_-]{8,}\.") + lit("eyJ") + chars(r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")),
)
BASE = ("assign", "access", "hex")


# --- index --------------------------------------------------------------------


def names(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(names, query[1]))


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """trigram, doc, h: the documents of each wanted trigram, by id and text hash."""
    found = F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains("folded", t))
    folded = docs.select(*key_of(), F.translate("text", UPPER, UPPER.lower()).alias("folded"))
    return folded.select("doc", "h", F.explode(found).alias("trigram")).distinct()


def key_of() -> list[Column]:
    """Stand for a row, which may have a NULL id: equal rows have equal secrets."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.xxhash64("text").alias("h")]


def answer(query: Query, held: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(held, query)
    parts = [answer(q, held) for q in sorted(query[1], key=str)]
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, parts)


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc, h, kinds: the rules whose query the document's postings satisfy."""
    rules = tuple(r for r in rules if r.pattern.query is not None)
    held = index.groupBy("doc", "h").agg(F.collect_set("trigram").alias("held"))  # a few trigrams at most
    kinds = F.array_compact(F.array(*[F.when(answer(r.pattern.query, F.col("held")), F.lit(r.kind)) for r in rules]))
    return held.select("doc", "h", kinds.alias("kinds")).where(F.size("kinds") > 0)


# --- verification -------------------------------------------------------------


def running(values: Column, combine) -> Column:
    """An array of running totals by an associative ``combine``.

    Blocks of ``BLOCK`` elements are added up one by one, the blocks' totals in the
    same way, and theirs again, so no long array is copied per element.
    """

    def short(a: Column) -> Column:
        step = lambda done, x: F.concat(done, F.array(F.coalesce(combine(F.get(done, F.size(done) - 1), x), x)))
        return F.aggregate(a, F.slice(a, 1, 0), step)

    def blocked(a: Column, totals) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(BLOCK)), lambda at: short(F.slice(a, at + 1, BLOCK)))

        def joined(inside: Column) -> Column:
            tops = F.transform(inside, lambda x: F.get(x, F.size(x) - 1))
            onto = lambda before: F.transform(
                inside, lambda x, k: F.when(k == 0, x).otherwise(F.transform(x, lambda y: combine(F.get(before, k - 1), y)))
            )
            return F.flatten(once(totals(tops), onto))

        return once(cut, joined)

    def whole(a: Column) -> Column:
        return F.when(F.size(a) <= BLOCK, short(a)).otherwise(blocked(a, lambda tops: blocked(tops, short)))

    return once(values, whole)


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (kind, begin, end) of the rule's matches, in code points."""
    regex = rule.pattern.regex
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    part = found if rule.part == 0 else F.regexp_extract_all(text, F.lit(regex), F.lit(rule.part))
    between = F.split(text, regex, -1)  # the texts around the matches give their places
    read = F.struct(
        F.transform(found, F.length).alias("size"), F.transform(part, F.length).alias("part"), F.transform(between, F.length).alias("gap")
    )

    def placed(x: Column) -> Column:
        steps = F.transform(x["size"], lambda size, i: size + F.get(x["gap"], i))

        def of_ends(ends: Column) -> Column:
            spans = F.transform(
                ends,
                lambda end, i: F.when(
                    F.get(x["part"], i) >= rule.least,
                    F.struct(F.lit(rule.kind).alias("kind"), (end - F.get(x["size"], i)).alias("begin"), end.alias("end")),
                ),
            )
            return F.array_compact(spans)

        return once(running(steps, lambda a, b: a + b), of_ends)

    return once(read, placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text, row (all columns), spans: array of (kind, begin, end) by
    begin, then kind as listed."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row.alias("row"))
    wanted = sorted(set().union(*(names(r.pattern.query) for r in rules)))
    index = materialise(postings(docs, wanted))
    # written first, so that its size decides whether texts must move to meet it
    chosen = materialise(candidates(index, rules))
    rows = docs.select("doc_id", "text", "row", *key_of()).join(chosen, ["doc", "h"], "left")
    none = F.array().cast("array<struct<kind:string,begin:int,end:int>>")
    parts = []
    for rule in rules:
        if rule.pattern.query is None:
            applies = F.col("text").rlike(rule.pattern.regex)
        else:
            applies = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        parts.append(F.when(applies, spans_of(F.col("text"), rule)).otherwise(none))
    order = F.array(*[F.lit(r.kind) for r in rules])

    def earlier(a: Column, b: Column) -> Column:
        return F.when(a["begin"] != b["begin"], a["begin"] - b["begin"]).otherwise(
            (F.array_position(order, a["kind"]) - F.array_position(order, b["kind"])).cast("int")
        )

    return rows.select("doc_id", "text", "row", F.array_sort(F.concat(*parts), earlier).alias("spans"))


def without_spans(text: Column, spans: Column, mask: str) -> Column:
    """The text with each stretch of overlapping spans (in order, at least one)
    replaced; each character is moved once."""

    def of_reach(reach: Column, spans: Column) -> Column:
        def opens(s: Column, i: Column) -> Column:
            return (i == 0) | (s["begin"] >= F.get(reach, i - 1))

        first = F.array_compact(F.transform(spans, lambda s, i: F.when(opens(s, i), i)))

        def of_first(f: Column) -> Column:
            stretch = lambda i, k: F.struct(
                F.get(spans, i)["begin"].alias("begin"), F.get(reach, F.coalesce(F.get(f, k + 1), F.size(spans)) - 1).alias("end")
            )
            return F.transform(f, stretch)

        return once(first, of_first)

    def of_both(x: Column) -> Column:
        at, chars = x["at"], x["chars"]

        def piece(s: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(at, k - 1)["end"], F.lit(0))
            return F.concat(F.array_join(F.slice(chars, begin + 1, s["begin"] - begin), ""), F.lit(mask))

        end = F.get(at, F.size(at) - 1)["end"]
        rest = F.array_join(F.slice(chars, end + 1, F.size(chars)), "")
        return F.concat(F.array_join(F.transform(at, piece), ""), rest)

    def of_spans(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        at = once(ends, lambda reach: of_reach(reach, spans))
        return once(F.struct(at.alias("at"), F.split(text, "").alias("chars")), of_both)

    return once(spans, of_spans)


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with each stretch of overlapping secrets replaced."""
    rows = scan(docs, rules)
    text = F.when(F.size("spans") > 0, without_spans(F.col("text"), F.col("spans"), mask)).otherwise(F.col("row.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
