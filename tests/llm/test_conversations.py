import hashlib
import random
import zlib

import numpy as np
import pytest
from dockflow.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth long, a long, part int, n_bytes string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The nodes, from sets of prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in own.items():
        turns.sort(key=lambda t: (t[0], t[1], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()))
        own[conv] = [(t[2], t[3]) for t in turns]
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))  # the remainder has the sign of c
        rebuilt[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    members, children = {}, {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    for seq in members:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        below = children.get(seq, [])
        leaves[seq] = sum(leaves[b] for b in below) or 1
        own_saved = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        saved[seq] = own_saved + sum(saved[b] for b in below)
    out = []
    for seq, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if rebuilt[c] == seq)
        parent = min(members[seq[:-1]]) if seq else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(seq), parent, len(convs), len(children.get(seq, [])), leaves[seq], saved[seq], digest))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def talk(seed, n=80, turns=14):
    """Conversations over few texts, so that many begin alike; copies, gaps, ties."""
    r = random.Random(seed)
    text = lambda: r.choice(["hi", "hello", "", None, "é中", "yes " * 30])
    rows = []
    for c in r.sample(range(-40, 200), n):
        length = r.choice([1, 2, 5, turns])
        for t in range(length):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "bot", None]) if r.random() < 0.1 else "user", text() if t > 3 else "hi"))
    rows += [(500 + k, t, "user", "the same") for k in range(60) for t in range(6)]
    rows += rows[:5] + [(None, 1, "user", "no id")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_sets_of_prefixes(spark, seed):
    rows = talk(seed)
    assert found(conversations.prefix_trie(table(spark, rows))) == plain(rows)


def test_conversations_over_several_parts_and_segments(spark, monkeypatch):
    rows = [(c, t, "user", f"t{t if t < 2100 or c < 3 else c}") for c in range(7) for t in range(2600 + c)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = conversations.own_paths(table(spark, rows))
        assert own.count() == len(rows)
        got = found(conversations.prefix_trie(table(spark, rows)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == plain(rows)


def test_odd_tables(spark):
    assert conversations.prefix_trie(table(spark, []).limit(0)).count() == 0
    assert conversations.prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0
    single = [(1, None, None, None)]  # h of 1 takes its only turn away
    assert found(conversations.prefix_trie(table(spark, single))) == plain(single)
    long = [(0, 0, "user", "x" * 300_000), (1, 0, "user", "x" * 300_000), (5, 0, None, "x" * 299_999)]
    assert found(conversations.prefix_trie(table(spark, long))) == plain(long)


def test_query_columns(spark, tmp_path):
    rows = talk(9)
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversations(spark, str(tmp_path))
    assert got.columns == COLUMNS and {k for _, k in got.dtypes[:-1]} == {"bigint"}
    assert found(got) == plain(rows)


def sequences(seed, n=400):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        length = r.randint(1, 40)
        out.append([0, *[r.choice([1, 1, 1, 2]) for _ in range(length)]])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_exit_nodes_are_those_of_a_plain_search(seed):
    """Paths are the prefixes themselves here."""
    trie, held = conversations.ZFast(()), []
    for k, seq in enumerate(sequences(seed)):
        paths = [tuple(seq[1 : d + 1]) for d in range(len(seq))]
        node, shared = trie.locate(paths)
        most = max((next((d for d, (x, y) in enumerate(zip(seq[1:], s, strict=False)) if x != y), min(len(seq) - 1, len(s))) for s in held), default=0)
        assert shared == most and node.top <= shared <= node.depth
        trie.insert(k, paths)
        held.append(seq[1:])
    rows = {path: (d, least, total) for _, path, d, least, [total] in trie.expanded(np.ones((len(held), 1), np.int64), np.arange(len(held)))}
    want = {}
    for k, s in enumerate(held):
        for d in range(1, len(s) + 1):
            least, n = want.get(tuple(s[:d]), (k, 0))
            want[tuple(s[:d])] = min(least, k), n + 1
    assert {p: (d, *want[p]) for p, (d, _, _) in rows.items()} == rows and set(rows) == set(want)


@pytest.mark.parametrize("batch", [1, 7, 400])
def test_batches_give_one_trie(batch):
    items = [(k, [tuple(s[1 : d + 1]) for d in range(len(s))]) for k, s in enumerate(sequences(11))]
    trie = conversations.ZFast(())
    for at in range(0, len(items), batch):
        trie.insert_batch(items[at : at + batch])
    one = conversations.ZFast(())
    for item in items:
        one.insert(*item)
    values, least = np.ones((len(items), 1), np.int64), np.arange(len(items))
    assert sorted(trie.expanded(values, least)) == sorted(one.expanded(values, least))


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert conversations.two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: (x & -x, -x))
