"""Suffix-array deduplication: bytes of passages that an earlier document has.

A byte goes if a passage of ``WINDOW`` bytes over it also starts in a document
with a smaller id.  The steps:

1. Each window has an anchor, the substring of ``ANCHOR`` bytes with the smallest
   hash in it, so equal windows have equal anchors.  Neighbouring windows with one
   anchor form a segment.  Anchors that only one document has are left out.
2. The segments of the other anchors are dealt to shards by anchor, so all equal
   windows meet in a shard.  There a suffix array is induced over the different
   segments; neighbours in it that share a window's length of their permuted
   common prefixes have equal windows, and the smallest id among them decides.
3. The windows found are cut from their documents.

Copies: equal texts are one group of the smallest id, found by two hashes of 64
bits; the others lose all their bytes, and only the first one is looked at.

Hot passages: equal segments of one task travel once, for the smallest id; all
others are known to go.  An anchor of very many texts (``HOT``) has its windows
dealt one by one, by their own content, so a short line in a third of all
documents is no group either.

Defined cases: NULL and empty texts have no bytes; texts shorter than a window
lose nothing; a NULL id is larger than all others; rows with equal ids don't
count as earlier than each other; repeated rows get equal results; only doc_id
(whole numbers) and text are read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.llm.common import materialise
from dockflow.llm.suffixes import permuted_common_prefixes, suffix_array

WINDOW = 50
ANCHOR = 20
PLACES = WINDOW - ANCHOR + 1  # of an anchor in a window
BUFFER = 1 << 20  # bytes looked at together
BLOCK = 1 << 21  # segments asked for together
HOT = 1 << 16  # an anchor in fewer texts never counts as hot: its group has some MB
HOT_ANCHORS = 1_000_000  # at most so many are
SHARDS_PER_PARTITION = 8
LAST_ID = np.iinfo(np.int64).max  # a NULL id


def place_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``ANCHOR`` bytes from each place on."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(raw),), (1,))
    n = len(raw) - ANCHOR + 1
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word[8 : n + 8]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += word[ANCHOR - 8 : n + ANCHOR - 8]
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def segments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each segment.

    ``raw``: texts one after another, at most BUFFER bytes; ``ends``: where each
    ends.  No window crosses an end.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < WINDOW:
        return none.view(np.uint64), none, none
    h = place_hashes(raw)
    low = np.uint64(BUFFER - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties go to the left one
    reach = 1
    while 2 * reach <= PLACES:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < PLACES:
        key = np.minimum(key[: len(key) - (PLACES - reach)], key[PLACES - reach :])
    at = (key & low).astype(np.int64)
    crossing = np.zeros(len(at) + 1, np.int64)
    inner = ends[:-1]
    np.add.at(crossing, np.clip(inner - WINDOW + 1, 0, len(at)), 1)
    np.add.at(crossing, np.clip(inner, 0, len(at)), -1)
    at[np.cumsum(crossing[:-1]) > 0] = -1
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    count = np.diff(np.concatenate([first, [len(at)]]))
    real = at[first] >= 0
    first, count = first[real], count[real]
    return h[at[first]], first, count


def all_segments(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hash, text key, first window, number of windows; in pieces.

    Long texts are looked at in parts that overlap by all but one byte of a window.
    """
    texts, keys, begins, size = [], [], [], 0

    def look() -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        h, first, count = segments(raw, ends)
        text = np.searchsorted(ends, first, side="right")
        return h, np.array(keys, np.int64)[text], first - (ends - sizes)[text] + np.array(begins)[text], count

    for key, raw in rows:
        for begin in range(0, max(len(raw) - WINDOW + 1, 0), BUFFER - WINDOW + 1):
            part = raw[begin : begin + BUFFER]
            if size + len(part) > BUFFER:
                yield look()
                texts, keys, begins, size = [], [], [], 0
            texts.append(part)
            keys.append(key)
            begins.append(begin)
            size += len(part)
    if texts:
        yield look()


def split_hash(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An anchor's bucket and the rest of its hash."""
    bucket = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
    return bucket, (h >> np.uint64(32)).astype(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """True at the first row of each run of equal rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def lists(by: np.ndarray, *columns: tuple[np.ndarray, type]) -> tuple[np.ndarray, list[pa.ListArray]]:
    """The different values of ``by``, and the others as a list for each."""
    order = np.argsort(by, kind="stable")
    by = by[order]
    first = np.flatnonzero(changes(by)) if len(by) else np.zeros(0, np.int64)
    cut = pa.array(np.append(first, len(by)), pa.int32())
    return by[first], [pa.ListArray.from_arrays(cut, pa.array(c[order].astype(kind))) for c, kind in columns]


ASK = "bucket int, key array<long>, low array<int>, texts array<int>"


def questions(buckets: int):
    """Which anchors the texts (columns key, text) have, by bucket.

    An anchor that several texts of a block have is told once, with their number;
    these texts need no answer: theirs goes out under the bucket ``-1 - bucket``.
    """

    def rows(bucket, key, low, texts) -> pa.RecordBatch:
        bucket, columns = lists(bucket, (key, np.int64), (low.astype(np.uint32).view(np.int32), np.int32), (texts, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *columns], names=["bucket", "key", "low", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, key = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((key, h))
            h, key = h[order], key[order]
            once = changes(h, key)
            h, key = h[once], key[once]
            bucket, low = split_hash(h, buckets)
            new = changes(h)
            texts = np.bincount(np.cumsum(new) - 1)
            many = np.repeat(texts > 1, texts)
            told = new & many
            # by text, which packs well
            single = np.flatnonzero(~many)
            single = single[np.argsort(key[single], kind="stable")]
            at = np.concatenate([single, np.flatnonzero(told)])
            number = np.concatenate([np.zeros(len(single), np.int64), texts[texts > 1]])
            yield rows(bucket[at], key[at], low[at], number)
            if many.any():
                yield rows(-1 - bucket[many], key[many], low[many], np.zeros(int(many.sum()), np.int64))

        for piece in all_segments((k, (t.as_py() or "").encode()) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)):
            held.append(piece[:2])
            n += len(piece[0])
            if n >= BLOCK:
                yield from flush()
                n = 0
        if n:
            yield from flush()

    return run


ANSWER = "key long, anchor array<long>, texts int"


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text and bucket, its anchors that other texts have; and, with
    ``texts``, anchors of many texts.  Rows come by bucket."""

    def rows(key, anchor) -> pa.RecordBatch:
        key, columns = lists(key, (anchor, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(key), *columns, pa.nulls(len(key), pa.int32())], names=["key", "anchor", "texts"])

    def decide(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        key, low, texts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((key, low))
        key, low, texts = key[order], low[order], texts[order]
        anchor = bucket * (1 << 32) + (low.astype(np.int64) & 0xFFFFFFFF)
        new = changes(low)
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        told = texts > 0
        several = np.logical_or.reduceat(told, begin) | (np.maximum.reduceat(key, begin) != np.minimum.reduceat(key, begin))
        shared = several[group] & ~told
        yield rows(key[shared], anchor[shared])
        sums = np.add.reduceat(np.where(told, texts, 1), begin)
        hot = np.flatnonzero(sums >= HOT)
        if len(hot):
            one = pa.ListArray.from_arrays(pa.array(np.arange(len(hot) + 1), pa.int32()), pa.array(anchor[begin[hot]]))
            number = pa.array(np.minimum(sums[hot], 2**31 - 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), pa.int64()), one, number], names=["key", "anchor", "texts"])

    held, current = [], None
    for batch in batches:
        for k, bucket in enumerate(batch.column(0).to_pylist()):
            key, low, texts = (batch.column(c)[k].values.to_numpy() for c in (1, 2, 3))
            if bucket < 0:
                yield rows(key, (-1 - bucket) * (1 << 32) + (low.astype(np.int64) & 0xFFFFFFFF))
                continue
            if bucket != current and held:
                yield from decide(current, held)
                held = []
            current = bucket
            held.append((key, low, texts))
    if held:
        yield from decide(current, held)


class Shared:
    """Different segments, each with its smallest document and places there."""

    def __init__(self):
        self.seen: dict[bytes, list] = {}
        self.done: list[tuple] = []  # doc_id, h, begin, end of windows that go for sure

    def add(self, text: bytes, shard: int, doc: int, h: int, start: int) -> None:
        entry = self.seen.get(text)
        if entry is None or doc < entry[1]:
            if entry:
                self._gone(len(text), entry)
            self.seen[text] = [shard, doc, [(h, start)]]
        elif doc == entry[1]:
            entry[2].append((h, start))
        else:
            self.done.append((doc, h, start, start + len(text)))

    def _gone(self, size: int, entry: list) -> None:
        self.done += [(entry[1], h, start, start + size) for h, start in entry[2]]


def stretches_to_cut(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, begin and end of each stretch of windows that ones of smaller documents equal."""
    # symbols: 0 ends all, 1 ends a segment, then the bytes that occur
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    code = np.zeros(256, np.uint8)  # at most 254 of the 256 bytes occur in UTF-8
    code[used] = np.arange(len(used)) + 2
    t = np.zeros(len(raw) + len(texts) + 1, np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    t[np.arange(len(raw)) + owner] = code[raw]
    t[ends + np.arange(len(texts))] = 1
    sa = suffix_array(t)
    common = permuted_common_prefixes(t, sa, 4 * WINDOW)
    new = common[sa] < WINDOW
    new[0] = True
    # a suffix that ends before a window's length has no equal neighbour
    segment = np.zeros(len(t), np.int64)
    segment[np.arange(len(raw)) + owner] = owner
    segment[ends + np.arange(len(texts))] = np.arange(len(texts))
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[segment[sa]], begin)
    cut = np.zeros(len(t), bool)
    cut[sa] = least[np.cumsum(new) - 1] < docs[segment[sa]]
    # only whole windows, so no stretch goes on into the next segment
    stop = ends + np.arange(len(texts))
    cut &= stop[segment] - np.arange(len(t)) >= WINDOW
    edge = np.diff(np.concatenate([[0], cut, [0]]).astype(np.int8))
    begin, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    of = segment[begin]
    start = (stop - sizes)[of]
    return of, begin - start, last + WINDOW - start


PIECE = "shard int, doc long, h int, start int, stop int, piece binary"


def merged(rows: list[tuple], more: Iterable[np.ndarray] = ()) -> np.ndarray:
    """Stretches (doc, h, start, stop) with those that touch made one."""
    x = np.concatenate([np.array(rows, np.int64).reshape(-1, 4), *more])
    if not len(x):
        return x
    doc, h, start, stop = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))].T
    shift = np.cumsum(changes(doc, h)) << 32  # so that texts lie apart
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(x), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    return np.stack([doc[first], h[first], start[first], (reach - shift)[last]], axis=1)


def piece_rows(rows: list[tuple], stretches: np.ndarray, shards: int = 1) -> Iterator[pa.RecordBatch]:
    """Pieces, and stretches that are settled (no piece), spread by their text."""
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ["shard", "doc", "h", "start", "stop", "piece"]
    for at in range(0, len(rows), 50_000):
        columns = zip(*rows[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
    if len(stretches):
        columns = [stretches[:, 1] % shards, *stretches.T]
        columns = [pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=False)]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(stretches), pa.binary())], names=names)


def cutter(buckets: int, shards: int, hot: set[int]):
    """Cuts the shared segments out of the texts (columns doc, h, text, anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Shared()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(e[0], e[1], h, s, 0, x) for x, e in shared.seen.items() for h, s in e[2]]
            yield from piece_rows(rows, merged(shared.done), shards)
            shared.__init__()

        for batch in batches:
            docs, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raws = [t.as_py().encode() for t in batch.column(2)]
            wanted = batch.column(3)
            owner = np.repeat(np.arange(len(docs)), wanted.value_lengths().to_numpy())
            mark = lambda row, anchor: anchor ^ row << 20  # noqa: E731  chance matches only add candidates
            wanted = np.unique(mark(owner, wanted.flatten().to_numpy()))
            for h, row, start, count in all_segments(enumerate(raws)):
                bucket, low = split_hash(h, buckets)
                anchor = bucket * (1 << 32) + low
                at = np.flatnonzero(np.isin(mark(row, anchor), wanted))
                to = (anchor[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)
                for k, a, s, n, shard in zip(*[c.tolist() for c in (row[at], anchor[at], start[at], count[at], to)], strict=True):
                    if a in hot:
                        for w in range(s, s + n):
                            x = raws[k][w : w + WINDOW]
                            shared.add(x, xxhash.xxh32_intdigest(x) % shards, docs[k], hashes[k], w)
                    else:
                        shared.add(raws[k][s : s + n + WINDOW - 1], shard, docs[k], hashes[k], s)
                if len(shared.seen) + len(shared.done) > 300_000:
                    yield from flush()
        yield from flush()

    return run


def shard_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches to remove (piece NULL), from pieces that come by shard."""
    current, shared, settled = None, Shared(), []

    def flush() -> Iterator[pa.RecordBatch]:
        rows, texts = shared.done, sorted(shared.seen)
        if texts:
            docs = np.array([shared.seen[x][1] for x in texts], np.int64)
            for k, begin, end in zip(*[x.tolist() for x in stretches_to_cut(texts, docs)], strict=True):
                _, doc, places = shared.seen[texts[k]]
                rows += [(doc, h, s + begin, s + end) for h, s in places]
        yield from piece_rows([], merged(rows, settled))
        shared.__init__()
        settled.clear()

    for batch in batches:
        shards = batch.column(0).to_numpy()
        border = np.flatnonzero(changes(shards)) if len(shards) else shards
        for begin, end in zip(border.tolist(), [*border.tolist()[1:], len(shards)], strict=False):
            if (shard := int(shards[begin])) != current:
                yield from flush()
                current = shard
            part = batch.slice(begin, end - begin)
            done, part = part.filter(part.column(5).is_null()), part.filter(part.column(5).is_valid())
            if done.num_rows:
                settled.append(np.stack([c.to_numpy().astype(np.int64) for c in done.columns[1:5]], axis=1))
            for doc, h, start, piece in zip(*[part.column(c).to_pylist() for c in (1, 2, 3, 5)], strict=True):
                shared.add(piece, shard, doc, h, start)
    yield from flush()


def hashes_of(text) -> list:
    """Two hashes that equal texts share."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit("second")).alias("h2")]


def removals(docs: DataFrame) -> DataFrame:
    """h1, h2 (of the text), first (smallest id of the text), runs (start, stop:
    stretches of bytes to remove from its first document; they may overlap)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(F.octet_length("text") >= WINDOW).select("doc", "text", *hashes_of(F.col("text")))
    asked = rows.select("h1", "text").mapInArrow(questions(parts), ASK)
    replies = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answers, ANSWER)
    replies = materialise(replies)
    total, hottest = replies.agg(F.sum(F.size("anchor")), F.max("texts")).first()
    hot: set[int] = set()
    if hottest:
        limit = max(HOT, int(total) // HOT_ANCHORS)  # so about HOT_ANCHORS reach it at most
        hot = {r[0] for r in replies.where(F.col("texts") >= limit).select(F.get("anchor", F.lit(0))).collect()}
    first = F.coalesce(F.min("doc"), F.lit(int(LAST_ID)))
    groups = materialise(rows.groupBy("h1", "h2").agg(first.alias("first"), F.count(F.lit(1)).alias("n")))
    found = replies.where("texts IS NULL").groupBy(F.col("key").alias("h1")).agg(F.flatten(F.collect_list("anchor")).alias("anchor"))
    found = groups.select("h1", "h2", "first").join(found, "h1")
    pieces = rows.select("h1", "h2", "text").join(found, ["h1", "h2"])
    short = F.col("h1").bitwiseAND(F.lit(2**31 - 1)).cast("int")
    pieces = pieces.select(F.col("first").alias("doc"), short.alias("h"), "text", "anchor")
    pieces = pieces.mapInArrow(cutter(parts, SHARDS_PER_PARTITION * parts, hot), PIECE)
    runs = pieces.repartition("shard").sortWithinPartitions("shard").mapInArrow(shard_runs, PIECE)
    runs = materialise(runs.select("doc", "h", "start", "stop"))
    runs = runs.groupBy(F.col("doc").alias("first"), "h").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    texts = groups.withColumn("h", short).join(runs, ["first", "h"], "left").where("n > 1 OR runs IS NOT NULL")
    return materialise(texts.select("h1", "h2", "first", "runs"))


SPAN = T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType())


def without_repeats(docs: DataFrame, columns: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """doc_id (or ``columns``, whose names are none of the others), n_bytes, spans
    (what is removed, in order) and kept (the other bytes).  With ``whole_characters`` a character of several
    bytes stays if not all of them are to go."""
    columns = columns or ["doc_id"]
    found = removals(docs).withColumnsRenamed({"h1": "_h1", "h2": "_h2", "first": "_first", "runs": "_runs"})
    text = F.coalesce("text", F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID)))
    rows = docs.select(*columns, text.alias("_t"), doc.alias("_d"), *[h.alias(f"_x{k}") for k, h in enumerate(hashes_of(text))])
    rows = rows.join(found, (F.col("_x0") == F.col("_h1")) & (F.col("_x1") == F.col("_h2")), "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("_t").alias("stop")))
    runs = F.when(F.col("_d") > F.col("_first"), whole).otherwise(F.col("_runs"))
    rows = rows.select(*columns, "_t", runs.alias("_runs"))
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cuts, kept = [], [], []
            for text, found in zip(batch.column(n), batch.column(n + 1), strict=True):
                raw = text.as_py().encode()
                spans, rest = [], raw
                if found.is_valid:
                    runs = found.values
                    begin, end = (runs.field(k).to_numpy() for k in (0, 1))
                    order = np.argsort(begin, kind="stable")
                    begin, end = begin[order], np.maximum.accumulate(end[order])
                    first = np.concatenate([[True], begin[1:] > end[:-1]])  # touching ones are one
                    begin = begin[first]
                    end = end[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(end) - 1]])]
                    if whole_characters:
                        border = np.flatnonzero((np.frombuffer(raw + b" ", np.uint8) & 0xC0) != 0x80)
                        begin = border[np.searchsorted(border, begin)]
                        end = border[np.searchsorted(border, end, side="right") - 1]
                        begin, end = begin[begin < end], end[begin < end]
                    spans = [{"start": int(a), "stop": int(b)} for a, b in zip(begin, end, strict=True)]
                    stay = np.concatenate([[0], end]), np.concatenate([begin, [len(raw)]])
                    rest = b"".join(raw[a:b] for a, b in zip(*stay, strict=True))
                sizes.append(len(raw))
                cuts.append(spans)
                kept.append(rest)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            columns_ = [*batch.columns[:n], pa.array(sizes, pa.int64()), pa.array(cuts, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns_, names=[*batch.schema.names[:n], "n_bytes", "spans", "kept"])

    schema = T.StructType(docs.select(*columns).schema.fields)
    return rows.mapInArrow(run, schema.add("n_bytes", "long").add("spans", T.ArrayType(SPAN)).add("kept", "binary"))
