"""Quality classifier on random-indexing word vectors.

Each word has a sparse random index vector, made from its hash.  A word's vector is
the sum of the index vectors of its neighbours, in whole numbers, so that it does
not depend on the partitions.  Words of at least one in ``1 / SHARE`` occurrences
(there are at most that many) have a vector summed over the whole corpus; a rarer
word, of which the corpus says little, has one summed over the document at hand.
Each word has a vector of its own, and no word is left out.

A document is the weighted mean of its unit word vectors (rare words weigh more),
with the spread around it and two numbers on its length and variety.  A network of
two layers in numpy, fitted on a bounded sample of labelled documents, makes it a
score; the temperature that makes scores probabilities is fitted on a part of the
sample that the network has not seen.

Words: runs of letters without case, runs of numerals as one word, runs of other
signs whole; a run of capitals is preceded by a word that says so.

Bounds: the table of frequent words has at most 1 / SHARE rows of WIDTH numbers
(19 MB), the training sample at most ``sample`` documents (smallest hashes of their
ids).

Defined cases: NULL and empty texts get the score of an empty document; a NULL
id counts as held out; of several labels for a document the largest counts, NULL
labels don't; without labels of both kinds every score is the share of good ones
(0.5 without any); repeated rows get equal scores; only doc_id and text are read
and only doc_id and quality of the labels; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.automaton import Table
from dockflow.llm.bpe import LETTER, NUMERAL, kinds, word_hashes
from dockflow.llm.common import discard, materialise

SHARE = 1e-5  # of all occurrences, from which a word has a vector of the corpus
WIDTH = 48
NONZERO = 4  # of an index vector, one in each of as many stretches
REACH = 2  # neighbours on each side
RARE = 1e-3  # words of this frequency weigh half
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 30
FOLDS = 5
SLICE = 1 << 18  # words looked at together
COUNTED = 1 << 20  # different words of a task that are counted before they are sent
SEEN = 2 * WIDTH + 2  # numbers that the network sees
NUMBER, CAPITALS = 1, 2  # stand for runs of numerals and before runs of capitals


@lru_cache(maxsize=1)
def lower_case() -> np.ndarray:
    """The small letter of each code point that is one."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        small = chr(c).lower()
        if len(small) == 1:
            table[c] = ord(small)
    return table


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and how many each has."""
    whole = "\n".join(t or "" for t in texts)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    kind, small = kinds()[code], lower_case()[code]
    border = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    end = np.append(border[1:], len(code))
    real = kind[border] != 0
    begin, end = border[real], end[real]
    h = word_hashes(small, begin, end)
    h[kind[begin] == NUMERAL] = NUMBER
    capital = np.concatenate([[0], np.cumsum(small != code)])
    loud = (kind[begin] == LETTER) & (end - begin > 1) & (capital[end] - capital[begin] == end - begin)
    h = np.insert(h, np.flatnonzero(loud), CAPITALS)
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    upto = np.concatenate([[0], np.cumsum(1 + loud)])[np.searchsorted(begin, ends)]
    return h, np.diff(upto, prepend=0)


def slices(texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and sizes of about SLICE words at a time, in whole texts."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "") + 1
        if size >= 6 * SLICE:
            yield words_of(held)
            held, size = [], 0
    if held:
        yield words_of(held)


def index_vectors(h: np.ndarray) -> np.ndarray:
    """The sparse vector of each word: one sign in each of NONZERO stretches."""
    part = WIDTH // NONZERO
    index = np.zeros((len(h), WIDTH), np.int8)
    row, bits = np.arange(len(h)), h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(NONZERO):
        own = (bits >> np.uint64(8 + 12 * k)) & np.uint64(0xFFF)
        sign = 1 - 2 * ((own >> np.uint64(11)) & np.uint64(1)).astype(np.int8)
        index[row, k * part + (own % np.uint64(part)).astype(np.int64)] = sign
    return index


def neighbour_sums(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each occurrence, the sum of its neighbours' index vectors in its text."""
    index = index_vectors(h)
    of = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros_like(index)
    for step in range(1, REACH + 1):
        same = (of[step:] == of[:-step]).astype(np.int8)[:, None]
        out[step:] += index[:-step] * same
        out[:-step] += index[step:] * same
    return out


def added_by(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The groups, how many rows each has, and the sums of their rows."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0])) if len(group) else np.zeros(0, np.int64)
    sums = np.add.reduceat(rows[order].astype(np.int64), first, axis=0) if len(first) else np.zeros((0, rows.shape[1]), np.int64)
    return group[order[first]], np.diff(np.append(first, len(group))), sums


def word_counts(docs: DataFrame) -> DataFrame:
    """h, n: the occurrences of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            h, back = np.unique(h, return_inverse=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.bincount(back, n, len(h)).astype(np.int64))], names=["h", "n"])

        for h, _ in slices(t for b in batches for t in b.column(0).to_pylist()):
            held.append(np.unique(h, return_counts=True))
            size += len(held[-1][0])
            if size >= COUNTED:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def word_vectors(docs: DataFrame, frequent) -> DataFrame:
    """row, vector: sums over all texts, for the rows of a table of frequent words
    (a broadcast array of hashes, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        sums = np.zeros((len(known), WIDTH), np.int64)
        for h, sizes in slices(t for b in batches for t in b.column(0).to_pylist()):
            row = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            there = np.flatnonzero(known[row] == h) if len(known) else np.zeros(0, np.int64)
            used, _, found = added_by(row[there], neighbour_sums(h, sizes)[there])
            sums[used] += found
        used = np.flatnonzero(sums.any(axis=1))
        if len(used):
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(sums[used].ravel()), WIDTH).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), vectors], names=["row", "vector"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
            for k, row in enumerate(batch.column(0).to_pylist()):
                rows[row] = rows[row] + v[k] if row in rows else v[k]
        if rows:
            vectors = pa.array([v.tolist() for v in rows.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), vectors], names=["row", "vector"])

    schema = "row int, vector array<long>"
    return docs.select("text").mapInArrow(run, schema).repartition("row").mapInArrow(add, schema)


class Words:
    """The frequent words' hashes, and their unit vectors times weights."""

    def __init__(self, hashes: np.ndarray, table: np.ndarray):
        self.hashes, self.table = hashes, table

    def __getstate__(self) -> tuple:
        return self.hashes, self.table

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)
        self.rows = Table(max(4, (2 * len(self.hashes)).bit_length()))
        self.rows.add(self.hashes, np.arange(len(self.hashes), dtype=np.int32))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    size = np.sqrt((vectors.astype(np.float32) ** 2).sum(axis=1, keepdims=True))
    return vectors / np.where(size > 0, size, 1)


def learnt(docs: DataFrame) -> Words:
    """The words of a corpus."""
    counts = materialise(word_counts(docs))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= SHARE * total).toPandas().sort_values("h")  # at most 1 / SHARE
    discard(counts)
    hashes, n = found["h"].to_numpy(np.int64), found["n"].to_numpy(float)
    frequent = docs.sparkSession.sparkContext.broadcast(hashes)
    vectors = np.zeros((len(hashes), WIDTH))
    for r in word_vectors(docs, frequent).collect():  # the same rows
        vectors[r["row"]] = r["vector"]
    weight = RARE / (RARE + n / max(total, 1))
    return Words(hashes, (unit(vectors) * weight[:, None]).astype(np.float32))


def pooled(texts: list[str | None], words: Words) -> np.ndarray:
    """What the network sees of each document."""
    out = [pooled_slice(h, sizes, words) for h, sizes in slices(iter(texts))]
    return np.concatenate(out) if out else np.zeros((0, SEEN), np.float32)


def pooled_slice(h: np.ndarray, sizes: np.ndarray, words: Words) -> np.ndarray:
    out = np.zeros((len(sizes), SEEN), np.float32)
    if not len(h):
        return out
    of = np.repeat(np.arange(len(sizes)), sizes)
    # the different words of each text, by text
    order = np.lexsort((h, of))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(of[order]) != 0)]))
    word, text, n = h[order[first]], of[order[first]], np.diff(np.append(first, len(h)))
    row = words.rows.find(word)
    vectors = np.zeros((len(word), WIDTH), np.float32)
    known = row >= 0
    vectors[known] = words.table[row[known]]
    rare = np.flatnonzero(~known)
    if len(rare):
        place = np.repeat(np.arange(len(word)), n)  # of each occurrence, in this order
        mine = ~known[place]
        _, _, sums = added_by(place[mine], neighbour_sums(h, sizes)[order[mine]])
        vectors[rare] = unit(sums)
    share = (n / sizes[text]).astype(np.float32)[:, None]
    begin = np.flatnonzero(np.concatenate([[True], np.diff(text) != 0]))
    full = text[begin]
    mean = np.add.reduceat(share * vectors, begin, axis=0)
    out[full, :WIDTH] = mean
    out[full, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(np.add.reduceat(share * vectors**2, begin, axis=0) - mean**2, 0))
    different = np.diff(np.append(begin, len(text)))
    out[full, -2], out[full, -1] = np.log1p(sizes[full]), np.log1p(different) - np.log1p(sizes[full])
    return out


class Network:
    """Two layers and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = self._scaled(x)
        later = np.arange(len(x)) % 5 == 4  # the order is that of a hash
        fit, check = np.flatnonzero(~later), np.flatnonzero(later)
        w = [
            rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN),
            np.zeros(1),
        ]
        moment, square, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(fit)
            for at in range(0, len(order), 128):
                i = order[at : at + 128]
                hidden = np.maximum(x[i] @ w[0] + w[1], 0)
                delta = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30))) - y[i]) / len(i)
                back = np.outer(delta, w[2]) * (hidden > 0)
                steps = [x[i].T @ back + 1e-4 * w[0], back.sum(axis=0), hidden.T @ delta + 1e-4 * w[2], np.array([delta.sum()])]
                t += 1
                for k, g in enumerate(steps):
                    moment[k] = 0.9 * moment[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    w[k] = w[k] - 3e-3 * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        if len(check):
            z = self._logits(x[check])
            tries = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
            loss = [np.logaddexp(0, -np.where(y[check] == 1, z, -z) / s).mean() for s in tries]
            self.temperature = float(tries[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logits(self._scaled(x)) / self.temperature, -500, 500)))


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, words, sample: int = SAMPLE) -> Network:
    """The network for known words (a broadcast value)."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented bound
    chosen = chosen.select(F.col("doc_id").cast("string").alias("key"), F.col("quality").cast("int").alias("y"))
    texts = docs.select(F.col("doc_id").cast("string").alias("key"), "text").join(F.broadcast(chosen), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [v.tobytes() for v in pooled(batch.column(1).to_pylist(), words.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["key", "y", "x"])

    seen = texts.mapInArrow(run, "key string, y int, x binary").dropDuplicates(["key", "x"]).toPandas()
    seen = seen.assign(h=[xxhash.xxh64_intdigest(d, 5) for d in seen["key"]]).sort_values(["h", "x"])
    x = np.array([np.frombuffer(b, np.float32) for b in seen["x"]], float).reshape(len(seen), SEEN)
    return Network(x, seen["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score."""
    docs = docs.select("doc_id", "text")
    context = docs.sparkSession.sparkContext
    words = context.broadcast(learnt(docs))
    network = context.broadcast(fit(docs, labels, words, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = network.value.scores(pooled(batch.column(1).to_pylist(), words.value).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.float64())], names=["doc_id", "score"])

    rows = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
