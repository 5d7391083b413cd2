"""Substring dedup on words: level-wise doubling.

A word goes if a window of ``window`` words over it also starts in a document
with a smaller id.  Windows of a few words come first; where a text's window of
one length is repeated in another text, and the next one that meets it is too,
the two are extended to a window of twice that length, until the wanted length
is reached or no candidate is left.  A level has two steps:

1. Each text sends the hashes of its windows to buckets, which tell the texts
   which of them other texts have.  Texts of one task are compared before.
2. The words under windows that may be repeated at the next length stay as
   stretches; all else is not looked at again.

At the last length the windows carry a hash of 128 bits and their document, and
the smallest document of a window keeps it.

Copies: equal texts are one group of the smallest id, found by two hashes of 64
bits; the others lose all their words, and only the first one is looked at.

Hot passages: a window that many texts of a task have is sent once, so a bucket
gets a window at most once for each block of ``BLOCK`` windows.

Defined cases: words are split at ASCII white space and compared as they are;
NULL, empty and blank texts have no words; texts with fewer words than a window
lose nothing; a NULL id is larger than all others; rows with equal ids don't
count as earlier than each other; repeated rows get equal results; only doc_id
(whole numbers) and text are read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import discard, materialise
from dockflow.llm.repeats import LAST_ID, changes, hashes_of, lists

WINDOW = 13
START = 4  # words of the first level
BLOCK = 1 << 20  # windows compared inside a task
TOGETHER = 1 << 18  # words whose candidates are looked up together
SALTS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

Pieces = Iterator[tuple[int, int, list[np.ndarray]]]  # text key, document, hashes of stretches of words


def lengths(window: int, start: int = START) -> list[int]:
    """The window lengths of the levels."""
    found = [min(start, window)]
    while found[-1] < window:
        found.append(min(2 * found[-1], window))
    return found


def word_hashes(text: str | None) -> np.ndarray:
    words = text.encode().split() if text else []  # bytes: ASCII spaces
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def doubled(h: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hashes of all windows of ``length`` words, built from those of half of it."""
    size = 1
    while size < length and len(h):
        step = min(size, length - size)
        a = h[: max(len(h) - step, 0)] * np.uint64(SALTS[lane])
        a ^= a >> np.uint64(29)
        a += h[step:]
        a *= np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(32)
        h = a
        size += step
    return h


def windows(pieces: list[np.ndarray], length: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and piece of each window; none crosses a border."""
    of = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    h = doubled(np.concatenate(pieces), length, lane) if pieces else np.zeros(0, np.uint64)
    n = max(len(of) - length + 1, 0)
    inside = of[:n] == of[length - 1 :] if n else np.zeros(0, bool)
    return h[:n][inside], of[:n][inside]


def texts(batches: Iterator[pa.RecordBatch]) -> Pieces:
    """Whole texts (columns key, doc, text) as pieces."""
    for batch in batches:
        for key, doc, text in zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True):
            yield key, doc, [word_hashes(text)]


STRETCHES = "key long, doc long, words array<long>, sizes array<int>"


def stretches(batches: Iterator[pa.RecordBatch]) -> Pieces:
    """The pieces of STRETCHES."""
    for batch in batches:
        for k, (key, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            words = batch.column(2)[k].values.to_numpy().view(np.uint64)
            cuts = np.cumsum(batch.column(3)[k].values.to_numpy())[:-1]
            yield key, doc, np.split(words, cuts)


def blocks(pieces: Pieces) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    keys, docs, held, size = [], [], [], 0
    for key, doc, several in pieces:
        keys += [key] * len(several)
        docs += [doc] * len(several)
        held += several
        size += sum(map(len, several))
        if size >= BLOCK:
            yield np.array(keys, np.int64), np.array(docs, np.int64), held
            keys, docs, held, size = [], [], [], 0
    if size:
        yield np.array(keys, np.int64), np.array(docs, np.int64), held


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int64)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def rows_of(by: np.ndarray, names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each value of ``by``, the other columns as lists."""
    by, parts = lists(by, *[(c, np.int64) for c in columns])
    return pa.RecordBatch.from_arrays([pa.array(by), *parts], names=names)


ASK = "bucket long, key array<long>, h array<long>, told array<long>"
ASK_NAMES = ["bucket", "key", "h", "told"]


def asker(read: Callable, length: int, buckets: int, targets: int):
    """Which windows the texts have, by bucket.  Windows that several texts of a
    block have are told once; these texts' replies go out at once, as bucket
    -1 - target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, pieces in blocks(read(batches)):
            h, of = windows(pieces, length)
            if not len(h):
                continue
            key = keys[of]
            order = np.argsort(h)
            new = changes(h[order])
            begin = np.flatnonzero(new)
            sorted_key = key[order]
            several = np.maximum.reduceat(sorted_key, begin) != np.minimum.reduceat(sorted_key, begin)
            first, told = order[begin], several
            settled = order[several[np.cumsum(new) - 1]]
            back = np.argsort(first)  # by text, which packs well
            first, told = first[back], told[back]
            yield rows_of(bucket_of(h[first], buckets), ASK_NAMES, key[first], signed(h[first]), told)
            if len(settled):
                settled = np.sort(settled)
                target = bucket_of(key[settled].view(np.uint64), targets)
                yield rows_of(-1 - target, ASK_NAMES, key[settled], signed(h[settled]), np.zeros(len(settled)))

    return run


REPLY = "target long, key array<long>, h array<long>"
REPLY_NAMES = ["target", "key", "h"]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows that come by their first column, of which the others are lists."""
    held, current = [], None
    for batch in batches:
        for k, value in enumerate(batch.column(0).to_pylist()):
            if held and value != current:
                yield current, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            current = value
            held.append([batch.column(c)[k].values.to_numpy() for c in range(1, batch.num_columns)])
    if held:
        yield current, [np.concatenate(x) for x in zip(*held, strict=True)]


def answers(targets: int):
    """The windows of texts that another text has too, by target of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (key, h, told) in groups(batches):
            if bucket >= 0:
                order = np.argsort(h)
                key, h, told = key[order], h[order], told[order]
                new = changes(h)
                begin = np.flatnonzero(new)
                several = np.maximum.reduceat(key, begin) != np.minimum.reduceat(key, begin)
                several |= np.maximum.reduceat(told, begin) > 0
                open_ = several[np.cumsum(new) - 1] & (told == 0)
                key, h = key[open_], h[open_]
            if len(key):
                yield rows_of(bucket_of(key.view(np.uint64), targets), REPLY_NAMES, key, h)

    return run


def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text with all its windows, from replies that come by target."""
    for _, (key, h) in groups(batches):
        yield rows_of(key, ["key", "h"], h)


def candidates(pieces: list[np.ndarray], of: np.ndarray, repeated: list[np.ndarray], length: int, longer: int):
    """The stretches whose windows of ``longer`` words may be repeated: at both
    their ends those of ``length`` words are.  ``of``: the text of each piece,
    ``repeated``: the windows of each text.  Gives the words of the stretches one
    after another, their sizes and texts."""
    words = np.concatenate(pieces)
    piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    n = len(words) - longer + 1
    if n <= 0:
        return words[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    salt = lambda texts: (texts + 1).astype(np.uint64) * np.uint64(SALTS[1])  # noqa: E731  so that all texts are looked up at once
    wanted = np.sort(np.concatenate(repeated) ^ salt(np.repeat(np.arange(len(repeated)), [len(r) for r in repeated])))
    h = doubled(words, length) ^ salt(of[piece[: len(words) - length + 1]])
    known = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
    good = known[:n] & known[longer - length : longer - length + n] & (piece[:n] == piece[longer - 1 :])
    edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + longer - 1
    sizes = end - begin
    at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    return words[at], sizes, of[piece[begin]]


def narrower(read: Callable, length: int, longer: int):
    """Candidates of the next level; rows have the repeated windows in the last column."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pieces = [p for _, _, ps, _ in rows for p in ps]
        of = np.repeat(np.arange(len(rows)), [len(ps) for _, _, ps, _ in rows])
        words, sizes, texts_ = candidates(pieces, of, [r for *_, r in rows], length, longer)
        if not len(sizes):
            return
        first = np.flatnonzero(changes(texts_))
        cut = np.append(first, len(sizes))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        row = texts_[first]
        columns = [pa.array(np.array([rows[r][c] for r in row.tolist()], np.int64)) for c in (0, 1)]
        columns.append(pa.ListArray.from_arrays(pa.array(ends[cut], pa.int32()), pa.array(signed(words))))
        columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(sizes, pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, names=["key", "doc", "words", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for (key, doc, pieces), repeated in zip(read(iter([batch])), batch.columns[-1], strict=True):
                rows.append((key, doc, pieces, repeated.values.to_numpy().view(np.uint64)))
                size += sum(map(len, pieces))
                if size >= TOGETHER:
                    yield from flush(rows)
                    rows, size = [], 0
            if rows:
                yield from flush(rows)

    return run


CLAIM = "bucket long, h array<long>, other array<long>, doc array<long>, key array<long>"
CLAIM_NAMES = ["bucket", "h", "other", "doc", "key"]


def later(h, other, doc, key) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows have a window that a smaller document has; rows by window."""
    order = np.lexsort((doc, other, h))
    h, other, doc, key = (c[order] for c in (h, other, doc, key))
    new = changes(h, other)
    return doc > doc[new][np.cumsum(new) - 1], [h, other, doc, key]


def claimer(read: Callable, length: int, buckets: int, targets: int):
    """The windows of the last length with their documents, by bucket; of a block
    only the smallest document's.  The others' go out at once, as bucket -1 - place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, docs, pieces in blocks(read(batches)):
            h, of = windows(pieces, length)
            if not len(h):
                continue
            other, _ = windows(pieces, length, 1)
            gone, columns = later(signed(h), signed(other), docs[of], keys[of])
            once = changes(*columns)
            place = np.where(gone, -1 - bucket_of(columns[3].view(np.uint64), targets), bucket_of(columns[0].view(np.uint64), buckets))
            yield rows_of(place[once], CLAIM_NAMES, *[c[once] for c in columns])

    return run


def losers(targets: int):
    """The windows of texts that a smaller document has, by target of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, columns in groups(batches):
            if bucket >= 0:
                gone, columns = later(*columns)
                columns = [c[gone] for c in columns]
            h, _, _, key = columns
            if len(key):
                yield rows_of(bucket_of(key.view(np.uint64), targets), REPLY_NAMES, key, h)

    return run


def grouped(rows: DataFrame) -> DataFrame:
    """Rows dealt by their first column and in its order."""
    first = rows.columns[0]
    return rows.repartition(first).sortWithinPartitions(first)


def per_text(replies: DataFrame) -> DataFrame:
    """key, h: one row per text."""
    return grouped(replies).mapInArrow(by_text, "key long, h array<long>")


def gone_windows(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """h1, h2 (of the text), first (smallest id of the text), gone (hashes of the
    windows that its first document loses)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row goes from each bucket to each target: more of the ones, fewer of the others
    buckets, targets = 2 * parts, parts // 2 + 1
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID)))
    rows = docs.where(F.length("text") >= 2 * window - 1).select(doc.alias("doc"), "text", *hashes_of(F.col("text")))
    firsts = materialise(rows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")))
    levels = lengths(window, start)
    source, read = rows.select(F.col("h1").alias("key"), "doc", "text"), texts
    for length, longer in zip(levels, levels[1:], strict=False):
        asked = grouped(source.mapInArrow(asker(read, length, buckets, targets), ASK))
        replies = materialise(asked.mapInArrow(answers(targets), REPLY))
        if read is texts:  # of a group of copies, only the first document stays
            known = firsts.join(per_text(replies).withColumnRenamed("key", "h1"), "h1")
            left = rows.join(known, ["h1", "h2"]).where("doc = first").select(F.col("h1").alias("key"), "doc", "text", "h")
        else:
            left = source.join(per_text(replies), "key")
        before, source, read = source, materialise(left.mapInArrow(narrower(read, length, longer), STRETCHES)), stretches
        discard(replies, before)
    if read is texts:
        source = rows.join(firsts, ["h1", "h2"]).where("doc = first").select(F.col("h1").alias("key"), "doc", "text")
    claims = grouped(source.mapInArrow(claimer(read, window, buckets, targets), CLAIM))
    lost = materialise(claims.mapInArrow(losers(targets), REPLY))
    found = firsts.join(per_text(lost).select(F.col("key").alias("h1"), F.col("h").alias("gone")), "h1", "left")
    found = materialise(found.where("n > 1 OR gone IS NOT NULL").select("h1", "h2", "first", "gone"))
    discard(lost, source, firsts)
    return found


CUT = "doc_id {}, n_words long, spans array<struct<start:int,stop:int>>, kept string"


def cut(text: str | None, gone: np.ndarray | None, whole: bool, window: int) -> tuple[int, list[dict], str]:
    """Number of words, stretches of words that go, and the others joined."""
    words = text.encode().split() if text else []
    n = len(words)
    if whole and n >= window:
        return n, [{"start": 0, "stop": n}], ""
    if whole or gone is None or n < window:
        return n, [], b" ".join(words).decode()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    at = np.flatnonzero(np.isin(doubled(h, window), gone))
    spans, kept, end = [], [], 0
    for run in np.split(at, np.flatnonzero(np.diff(at) > window) + 1) if len(at) else ():
        begin = int(run[0])
        kept += words[end:begin]
        end = int(run[-1]) + window
        spans.append({"start": begin, "stop": end})
    return n, spans, b" ".join(kept + words[end:]).decode()


def without_repeats(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """doc_id, n_words, spans (words that are removed, in order) and kept (the
    other words, joined by one space)."""
    found = gone_windows(docs, window, start)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID)))
    rows = docs.select("doc_id", "text", doc.alias("doc"), *hashes_of(F.col("text")))
    rows = rows.join(found, ["h1", "h2"], "left")
    copy = F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    rows = rows.select("doc_id", "text", copy.alias("copy"), F.when(~copy, F.col("gone")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copied, gone in zip(*batch.columns[1:], strict=True):
                known = gone.values.to_numpy().view(np.uint64) if gone.is_valid else None
                out.append(cut(text.as_py(), known, copied.as_py(), window))
            n, spans, kept = zip(*out, strict=True) if out else ((), (), ())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "spans", "kept"])

    return rows.mapInArrow(run, CUT.format(docs.schema["doc_id"].dataType.simpleString()))
