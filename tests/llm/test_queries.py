"""The columns of each registered query against plain Python."""

import hashlib
import random
import re
import zlib

import cases
import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from dockflow.llm import queries
from test_syncmers_secrets import base_spans
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(2)
    rows = cases.sample() + [(500 + k, cases.sample()[r.randrange(30)][1], "de", "s1", 3, "w", 7, "r", 1, 3) for k in range(12)]
    cases.frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(d, r.choice([0, 1, 1]), r.choice([0, 0, 1])) for d in {x[0] for x in rows if x[0] is not None and x[0] % 2}]
    spark.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    urls = ["https://Example.com/en/1", "http://www.example.com/en/a?q", "https://shop.example.com/en", "x://a.net/es/3#f", "x://b.net/fr/", "nothing", None, "://h", "https://a.co.uk/de/5"]
    pages = [(k, u, "<p>", "x") for k, u in enumerate(urls * 3)]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string").write.parquet(f"{path}/pages.parquet")
    return path, [(x[0], x[1]) for x in rows], pages


def rows_of(spark, folder, name):
    return queries.QUERIES[name](spark, folder[0]).collect()


def by_key(rows):
    return sorted(rows, key=repr)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1(spark, folder):
    reader = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in folder[1]:
        ids = reader.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(reader.decode(ids, skip_special_tokens=False))))
    assert by_key(tuple(r) for r in rows_of(spark, folder, "op1_bpe")) == by_key(want)


def test_op2_equals_its_sql_and_plain_counts(spark, folder):
    got = queries.QUERIES["op2_quality"](spark, folder[0])
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder[0]}/{name}.parquet/*.parquet'")
    want = con.execute("SELECT " + ", ".join(got.columns) + f" FROM ({queries.SQL['op2_quality']})").fetchall()
    rows = got.collect()
    assert by_key(tuple(r) for r in rows) == by_key(want)
    plain = []
    for d, t in folder[1]:
        words = WORD.findall(t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
        repeated = len({i + k for i, g in enumerate(grams) if g in twice for k in range(3)})
        failed = len(words) < 50 or 100 * repeated > 50 * len(words)
        plain.append((d, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, repeated, failed))
    assert by_key(tuple(r)[:7] for r in rows) == by_key(plain)
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_op3_hosts_paths_and_rules(spark, folder):
    rules = {("com", "/"): "allow", ("example.com", "/en/"): "block", ("www.example.com", "/en/"): "allow", ("net", "/es/"): "block", ("net", "/fr/"): "block"}
    got = {r["page_id"]: r for r in rows_of(spark, folder, "op3_urls")}
    assert len(got) == len(folder[2])
    for k, url, *_ in folder[2]:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h) + len(p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fit)[1] if fit else None)
        assert r["verdict"] == max(fit)[2] if fit else r["verdict"] in ("allow", "block")


def test_op4(spark, folder):
    def fingerprint(t):
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(t or "")]
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(d, fingerprint(t)) for d, t in folder[1]]
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2 and root[i] != root[j]:
                old = root[i]
                root = [root[j] if x == old else x for x in root]
    least = {}
    for (d, _), x in zip(fps, root, strict=True):
        least[x] = d if least.get(x) is None else least[x] if d is None else min(least[x], d)
    want = [(d, f"{f:016x}", least[x]) for (d, f), x in zip(fps, root, strict=True)]
    assert by_key(tuple(r) for r in rows_of(spark, folder, "op4_simhash")) == by_key(want)


def test_op5(spark, folder):
    reader = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in folder[1]:
        ids = [*reader.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            want.append((d, p, at, len(part) // 4, zlib.crc32(part)))
    rows = rows_of(spark, folder, "op5_packing")
    assert by_key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == by_key(want)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    assert len(places) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_op6(spark, folder):
    rows = rows_of(spark, folder, "op6_sharding")
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in folder[1]]
    assert by_key((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == by_key(want)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)} and {r["shard"] for r in rows} <= set(range(40))


def test_op7(spark, folder):
    rows = rows_of(spark, folder, "op7_classifier")
    assert len(rows) == len(folder[1])
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op8(spark, folder):
    big, first = float("inf"), {}
    for d, t in folder[1]:
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            first[raw[i : i + 50]] = min(first.get(raw[i : i + 50], big), big if d is None else d)
    want = []
    for d, t in folder[1]:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, int)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < (big if d is None else d):
                gone[i + 1 : i + 51] = 1
        kept = bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g)
        want.append((d, len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), sha(kept)))
    assert by_key(tuple(r) for r in rows_of(spark, folder, "op8_repeats")) == by_key(want)


def test_op9(spark, folder):
    rows = rows_of(spark, folder, "op9_syncmers")
    texts = sorted(((d, t or "") for d, t in folder[1]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    edits = []
    for k, (d, t) in enumerate(texts):
        after, half = texts[(k + 1) % len(texts)][1], len(t) // 2
        edits.append((d, len(t), sha(t[: len(t) - half] + after[:half])))
    assert by_key((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == by_key(edits)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by_text = {}
    for d, t in folder[1]:
        by_text.setdefault(t or "", set()).add(d)
    prints = {}
    for r in rows:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    single = {d for d, p in prints.items() if len(p) == 1}
    assert all(len({next(iter(prints[d])) for d in ds & single}) <= 1 for ds in by_text.values())


def test_op10(spark, folder):
    want = []
    for d, t in folder[1]:
        spans = base_spans(t or "")
        n = [sum(s[0] == kind for s in spans) for kind in ("assign", "access", "hex")]
        want.append((d, *n, sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    rows = rows_of(spark, folder, "op10_secrets")
    assert by_key(tuple(r)[:5] for r in rows) == by_key(want)
    for r in rows:
        kept = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert sha(kept) == r["base_sha256"]
