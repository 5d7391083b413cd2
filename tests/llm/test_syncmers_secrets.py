import random
import re
import time

from dockflow.llm import secrets, syncmers
from pyspark.sql import functions as F

import cases


def followers(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    return list(zip(order, order[1:] + order[:1], strict=True))


def test_edited_texts_and_likeness(spark):
    got = syncmers.fingerprints(cases.frame(spark)).collect()
    want = []
    for a, b in followers(cases.sample()):
        text, after = a[1] or "", b[1] or ""
        half = len(text) // 2
        want.append((str(a[0]), len(text), text[: len(text) - half] + after[:half]))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited"]) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    long = [r for r in got if r["n_chars"] > 400 and not r["edited"].startswith("a" * 9)]
    assert sum(r["near_edited"] > 0.05 for r in long) >= 0.9 * len(long)


def test_fingerprints_do_not_depend_on_the_place(spark):
    passage = " ".join(f"word{i}" for i in range(200))
    texts = [passage, passage, "other words before " + passage, None, "", "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(syncmers.sketch(F.coalesce("text", F.lit(""))).alias("s"), "text")
    got = rows.collect()
    by_text = {r["text"]: r["s"] for r in got}
    assert len({tuple(r["s"]) for r in got if r["text"] == passage}) == 1
    assert by_text[None] == by_text[""] == [] and len(by_text["a b"]) == 1
    common = set(by_text[passage]) & set(by_text[texts[2]])
    assert len(common) >= 0.8 * syncmers.SKETCH


def test_anchors_are_closed_syncmers(spark):
    text = " ".join(f"w{i * i % 97}" for i in range(60))
    row = spark.createDataFrame([(text,)], "text string").select(F.split("text", " ").alias("w"))
    row = row.select("w", syncmers.inner_hashes(F.col("w")).alias("g")).select("g", syncmers.anchors(F.col("w"), F.col("g")).alias("a")).first()
    last = syncmers.K - syncmers.INNER
    for i, a in enumerate(row["a"]):
        inner = row["g"][i : i + last + 1]
        assert (a is not None) == (min(inner) in (inner[0], inner[last]))


def test_neighbours_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS_PER_CELL", 2)
    ids = [5, 6, 7, 900, 901, 5000, 123456, -40]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["next_text"] for r in syncmers.with_next(rows, ["text"]).collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def pairwise(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string")
    return [r[0] for r in rows.select(syncmers.likeness(syncmers.placed(F.col("a")), syncmers.placed(F.col("b")))).collect()]


def plain_likeness(a, b):
    """``a``, ``b``: (place, hash) of all anchors."""
    places = [{h: [p for p, g in x if g == h] for _, h in x} for x in (a, b)]
    found = [q - p for h in places[0].keys() & places[1].keys() for p, q in zip(places[0][h], places[1][h], strict=False)]
    n = len(found) if min(len(a), len(b)) < 2 else sum(found.count(d) > 1 for d in found)
    return n / max(1, len(a) + len(b) - n) if a or b else 1.0


def test_likeness_is_that_of_all_anchors_by_position(spark):
    word = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    passage = word(0, 60)
    texts = [f"{word(1, 500)} {passage} {word(2, 440)}", f"{word(3, 100)} {passage} {word(4, 840)}", passage, "again and again " * 40, "again and again " * 9, "", None, "one"]
    texts += [" ".join(texts[0].split()[::-1]), " ".join(texts[0].split()[500:] + texts[0].split()[:500])]
    pairs = [(a, b) for a in texts for b in texts]
    rows = spark.createDataFrame(pairs, "a string, b string")
    rows = rows.select(*[syncmers.placed(F.col(c)).alias(c) for c in "ab"])
    rows = rows.select("a", "b", syncmers.likeness(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in rows] == [plain_likeness(r["a"], r["b"]) for r in rows]
    by_pair = {p: r for p, r in zip(pairs, rows, strict=True)}
    assert all(by_pair[t, t]["n"] == 1.0 for t in texts)
    # no sample: a fingerprint grows with its text, and a passage of 60 in 1000 words is seen
    assert len(by_pair[texts[0], texts[1]]["a"]) > 300 and 0.02 < by_pair[texts[0], texts[1]]["n"] < 0.04


def test_texts_of_a_few_words_have_an_anchor(spark):
    texts = [" ".join(f"v{k}y{i}" for i in range(n)) for n in (1, 4, 5, 6) for k in range(30)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(syncmers.placed(F.col("t"))).alias("n"))
    assert min(r["n"] for r in rows.collect()) >= 1
    assert set(pairwise(spark, list(zip(texts, texts[1:], strict=False)))) == {0.0}
    assert set(pairwise(spark, [*zip(texts, texts, strict=True), ("", " ")])) == {1.0}


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


TEXTS = [
    "password = secret:abcdefghijkl", "secret=token=abcdefgh1234", "api_key:'short' apikey=\"longenough99\"", "PASSWD  :  a.b-c_d/e+f=",
    "é中 token=ABCDEFGH tail", "AKIAAKIA" + "X" * 10, "AKIASHORT", "f" * 31 + " " + "e" * 40 + "G" + "0" * 32, "toKen\n=abcdefgh", "ſecret=abcdefgh",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-123456789012", "eyJhbGciOiJ9.eyJzdWIiOiIx.sig-x", "secret=" * 30 + "abcdefgh", "token=abcdefgh " * 50,
]


def test_spans(spark):
    rows = cases.sample() + [(1000 + i, t, *[None] * 8) for i, t in enumerate(TEXTS)]
    got = secrets.scan(cases.frame(spark, rows)).select("doc_id", "text", "spans").collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r["spans"] if s["kind"] in secrets.BASE] == base_spans(r["text"])
    kinds = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in got}
    assert kinds[1010] == {"private"} and "github" in kinds[1011] and "slack" in kinds[1012] and "jwt" in kinds[1013]


def test_queries_follow_from_the_patterns():
    q = {r.kind: r.pattern.query for r in secrets.RULES}
    assert q["hex"] is None and q["access"] == ("and", frozenset({"aki", "kia"}))
    assert secrets.trigrams("ab") is None and secrets.trigrams("ABC") == "abc"
    assert secrets.names(q["assign"]) >= {"pas", "swo", "tok", "api", "key", "i_k"}


def test_candidates_hold_every_match(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    index = secrets.postings(docs, sorted(set().union(*(secrets.names(r.pattern.query) for r in secrets.RULES))))
    chosen = {int(r["doc"]): r["kinds"] for r in secrets.candidates(index, secrets.RULES).collect()}
    for rule in secrets.RULES:
        if rule.pattern.query is not None:
            for i, t in enumerate(TEXTS):
                if re.search(rule.pattern.regex, t, re.A):
                    assert rule.kind in chosen.get(i, [])


def test_masks(spark):
    rows = [(1, "x token=abcdefgh12 y " + "0" * 32 + " z", *[None] * 8), (2, None, *[None] * 8), (3, "secret=" + "a" * 40, *[None] * 8), (4, "clean", *[None] * 8)]
    docs = cases.frame(spark, rows)
    got = secrets.masked(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "x [SECRET] y [SECRET] z", 2: None, 3: "[SECRET]", 4: "clean"}


def test_many_matches_in_one_text(spark):
    """The work grows with the matches, not with their square."""
    digests = [f"{k:032x}" for k in range(100_000)]
    text = " x ".join(digests)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.time()
    got = secrets.scan(docs).select("spans").first()["spans"]
    assert len(got) == 100_000 and all((s["begin"], s["end"]) == (35 * k, 35 * k + 32) for k, s in enumerate(got))
    assert secrets.masked(docs).first()["text"] == " x ".join(["[SECRET]"] * 100_000)
    assert time.time() - begin < 120


def test_overlapping_spans_are_masked_as_one(spark):
    r, rows = random.Random(3), []
    for k in range(200):
        parts = [r.choice(["token=", "secret: ", "AKIA" + "Q" * 14, "0f" * 20, " é中 ", "abcdefgh12", "word ", "password='"]) for _ in range(r.randint(0, 40))]
        rows.append((k, "".join(parts), *[None] * 8))
    docs = cases.frame(spark, rows)
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).select("doc_id", "spans").collect()}
    want = {}
    for k, text, *_ in rows:
        out, at = "", 0
        for s in spans[k]:
            if s["begin"] >= at:
                out += text[at : s["begin"]] + "[SECRET]"
            at = max(at, s["end"])
        want[k] = out + text[at:]
    assert {r["doc_id"]: r["text"] for r in secrets.masked(docs).collect()} == want


def test_private_keys_are_masked_whole(spark):
    key = lambda k: f"-----BEGIN {k}PRIVATE KEY-----\nMIIEabc+/=\n{'Qx7/' * 2000}\n-----END {k}PRIVATE KEY-----"
    head = "-----BEGIN PRIVATE KEY-----"
    long = "-word" * 60_000  # no END line, and no stack that grows with the text
    texts = [f"a {key('RSA ')} b {key('')} c", f"{head}{long}", f"{head} x {key('EC ')} y"]
    docs = cases.frame(spark, [(i, t, *[None] * 8) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["text"] for r in secrets.masked(docs).collect()}
    assert got == {0: "a [SECRET] b [SECRET] c", 1: f"[SECRET]{long}", 2: "[SECRET] x [SECRET] y"}


def test_empty_tables(spark):
    assert secrets.scan(cases.nothing(spark)).count() == 0
    assert syncmers.fingerprints(cases.nothing(spark)).count() == 0
