"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from dockflow.llm import bpe, classifier, conversations, packing, quality, repeats, reputation, secrets, sharding, simhash, substrings, syncmers, vectorcodes
from dockflow.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark, sf):
    rows = bpe.encode_decode(table(spark, sf, "documents"), TOKENIZER)
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_quality(spark, sf):
    rows = quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*first, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def page_outcomes(pages, labels):
    """The outcome of a page is that of the document whose number its path holds:
    bad if it is of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    number = F.expr("try_cast(regexp_extract(url, '://[^?#]*?/([0-9]+)', 1) AS bigint)")
    return pages.select("url", number.alias("doc_id")).join(known, "doc_id").select("url", "bad")


def op3_urls(spark, sf):
    pages = table(spark, sf, "pages")
    outcomes = page_outcomes(pages, table(spark, sf, "labels"))
    rows = reputation.judge(pages, outcomes, URL_RULES)
    return rows.select(
        "page_id", "host", "path", "rule", "verdict", F.col("n").alias("n_labelled"), F.round("rate", 6).alias("bad_rate")
    )


def op4_simhash(spark, sf):
    rows = simhash.near_duplicates(table(spark, sf, "documents"))
    fingerprint = F.lower(F.lpad(F.hex(F.get("fps", F.lit(0))), 16, "0"))
    return rows.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op5_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), TOKENIZER)


SHARDS = 40


def op6_sharding(spark, sf):
    rows = sharding.assign(table(spark, sf, "documents"), SHARDS)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_classifier(spark, sf):
    rows = classifier.score(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return rows.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_repeats(spark, sf):
    rows = repeats.without_repeats(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return rows.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_syncmers(spark, sf):
    rows = syncmers.fingerprints(table(spark, sf, "documents"))
    digest = F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")
    return rows.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def joined_spans(spans):
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def n_spans(kind):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op10_secrets(spark, sf):
    rows = secrets.scan(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    counts = [n_spans(kind).alias(f"n_{kind}") for kind in secrets.BASE]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def op11_substrings(spark, sf):
    rows = substrings.without_repeats(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), digest.alias("kept_sha256"))


def op12_vectorcodes(spark, sf):
    rows, books = vectorcodes.compress(table(spark, sf, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"))


def op13_conversations(spark, sf):
    return conversations.prefix_trie(table(spark, sf, "conversations"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_urls": op3_urls,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_classifier": op7_classifier,
    "op8_repeats": op8_repeats,
    "op9_syncmers": op9_syncmers,
    "op10_secrets": op10_secrets,
    "op11_substrings": op11_substrings,
    "op12_vectorcodes": op12_vectorcodes,
    "op13_conversations": op13_conversations,
}

#: The words of a text, the measures and the certified cutoffs in DuckDB's dialect.
RULES_SQL = ",\n".join(
    f"('{name}', {j}, {cutoff})" for name, (_, grid) in quality.RULES.items() for j, cutoff in enumerate(grid)
)
VALUES_SQL = " UNION ALL ".join(
    f"SELECT id, stratum, '{name}' AS rule, ({value.replace(' / ', ' / CAST(')} AS DOUBLE)) AS value FROM measured WHERE NOT base_failed"
    for name, (value, _) in quality.RULES.items()
)
def codes_sql(parts=vectorcodes.PARTS, entries=vectorcodes.ENTRIES, rounds=vectorcodes.ROUNDS, scale=vectorcodes.SCALE):
    """Rounds of nearest entry and mean; sorts by distance and entry."""
    square = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v, c)])"
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS (SELECT id, p, any_value(v) AS v, min(({square}) * {entries} + entry)::BIGINT AS best"
            f" FROM parts JOIN b{k} USING (p) GROUP BY id, p)"
        )
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT p, best % {entries} AS entry, i, floor(sum(v[i]) / count(*))::BIGINT AS x"
                f" FROM (SELECT p, best, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY ALL)"
            )
            steps.append(
                f"b{k + 1} AS (SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN"
                f" (SELECT p, entry, list(x ORDER BY i) AS c FROM m{k} GROUP BY ALL) m ON b.p = m.p AND b.entry = m.entry)"
            )
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT id, p, w[1 + p * len(w) // {parts} : (p + 1) * len(w) // {parts}] AS v FROM (SELECT *, unnest(range({parts})) AS p FROM kept)),
b0 AS (SELECT p, id - 1 AS entry, v AS c FROM parts WHERE id <= {entries}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, entry, i)) AS digest
          FROM (SELECT p, entry, unnest(c) AS x, unnest(range(len(c))) AS i FROM b{rounds})),
coded AS (SELECT id, string_agg(lpad(printf('%x', best % {entries}), 2, '0'), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM kept JOIN coded USING (id), books"""


SQL: dict[str, str] = {
    "op12_vectorcodes": codes_sql(),
    "op2_quality": rf"""
WITH numbered AS (SELECT row_number() OVER () AS id, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM numbered),
windows AS (SELECT id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
            FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) > 2)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY id),
measured AS (
  SELECT s.id, doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
         len(words) < {quality.MIN_WORDS} OR 100 * coalesce(r.n, 0) > 50 * len(words) AS base_failed
  FROM split s LEFT JOIN repeated r ON s.id = r.id),
rules(rule, j, cutoff) AS (VALUES {RULES_SQL}),
valued AS ({VALUES_SQL}),
good AS (SELECT v.* FROM valued v JOIN measured m ON v.id = m.id
         JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON m.doc_id = l.doc_id),
strata AS (SELECT count(*) AS n FROM (SELECT DISTINCT stratum FROM good)),
counts AS (SELECT stratum, g.rule, j, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
           FROM good g JOIN rules r ON g.rule = r.rule GROUP BY ALL),
tails AS (SELECT c.stratum, c.rule, c.j, c.cutoff, c.n, c.k, sum(exp(lgamma(c.n + 1) - (CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END)
                 - lgamma(c.n - i + 1) + i * ln({quality.MAX_FALSE / len(quality.RULES)}) + (c.n - i) * ln(1 - {quality.MAX_FALSE / len(quality.RULES)}))) AS tail
          FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM counts WHERE k < n * {quality.MAX_FALSE / len(quality.RULES)}) c GROUP BY ALL),
judged AS (SELECT c.stratum, c.rule, c.j, c.cutoff, coalesce(t.tail <= {quality.DELTA} / (s.n * {len(quality.RULES)}), false) AS stands
           FROM counts c CROSS JOIN strata s LEFT JOIN tails t ON c.stratum IS NOT DISTINCT FROM t.stratum AND c.rule = t.rule AND c.j = t.j),
cutoffs AS (SELECT stratum, rule, min(cutoff) AS cutoff
            FROM (SELECT *, bool_and(stands) OVER (PARTITION BY stratum, rule ORDER BY j) AS holds FROM judged) WHERE holds GROUP BY ALL),
failed AS (SELECT v.id, string_agg(v.rule, ',' ORDER BY list_position({list(quality.RULES)}, v.rule)) AS rules
           FROM valued v JOIN cutoffs c ON v.stratum IS NOT DISTINCT FROM c.stratum AND v.rule = c.rule WHERE v.value > c.cutoff GROUP BY v.id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND f.rules IS NULL AS kept, coalesce(f.rules, '') AS failed_rules
FROM measured m LEFT JOIN failed f ON m.id = f.id""",
    "op11_substrings": rf"""
WITH split AS (
  SELECT row_number() OVER () AS id, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
starts AS (
  SELECT id, doc_id, i, list_slice(words, i, i + {substrings.WINDOW - 1}) AS window_words
  FROM (SELECT *, unnest(range(1, len(words) - {substrings.WINDOW - 2})) AS i FROM split WHERE len(words) >= {substrings.WINDOW})),
least AS (SELECT window_words, min(doc_id) AS low FROM starts GROUP BY window_words),
gone AS (SELECT DISTINCT id, i + k AS i FROM starts s JOIN least l ON s.window_words = l.window_words,
         (SELECT unnest(range({substrings.WINDOW})) AS k) WHERE low < doc_id OR (doc_id IS NULL AND low IS NOT NULL)),
kept AS (
  SELECT s.id, count(g.i) AS n, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY s.i) AS text
  FROM (SELECT id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split) s
  LEFT JOIN gone g ON s.id = g.id AND s.i = g.i GROUP BY s.id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept ON split.id = kept.id""",
    "op13_conversations": rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
convs AS (
  SELECT c.conv_id, c.h, c.donor, least(c.h, coalesce(g.n, 0)) AS m FROM (
    SELECT conv_id, conv_id - conv_id % {conversations.SPREAD} AS donor,
           xor(list_reduce(list_concat([4294967295], [ascii(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')]),
             lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) % {conversations.BORROW} AS h
    FROM sizes) c LEFT JOIN sizes g ON g.conv_id = c.donor),
rebuilt AS (
  SELECT c.conv_id, i AS d, role, text FROM convs c JOIN turns t ON t.conv_id = c.donor WHERE i <= h
  UNION ALL SELECT c.conv_id, m + i - h, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE i > h),
keyed AS (SELECT conv_id, d, strlen(text) AS bytes,
            string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rebuilt),
members AS (
  SELECT conv_id, d, bytes, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY d), '') AS above FROM keyed
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM sizes),
nodes AS (SELECT path, min(above) AS above, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved FROM members GROUP BY path),
grown AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN (SELECT above, count(*) AS n FROM nodes GROUP BY above) c ON n.path = c.above),
below AS (SELECT m.path, sum(g.saved) AS saved_tokens, count(*) FILTER (g.n_children = 0) AS n_leaves
          FROM grown g JOIN members m ON m.conv_id = g.conv_id AND m.d <= g.depth GROUP BY m.path),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
         FROM (SELECT conv_id, arg_max(path, d) AS path FROM members GROUP BY conv_id) GROUP BY path)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM grown g JOIN below b ON g.path = b.path LEFT JOIN nodes p ON g.above = p.path LEFT JOIN ends e ON g.path = e.path""",
}
