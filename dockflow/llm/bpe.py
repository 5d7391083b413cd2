"""BPE encoding and decoding.

A word is cut by its longest known tokens, found by one Aho-Corasick pass.  Two
neighbours are kept only if no merge could have crossed the border between them
(the pair-compatibility table); otherwise a shorter token is tried, or the last
one is taken back.  A border that failed is never tried again, so the time is
linear and the result equals that of applying the merges one by one.  The new
words of a block of texts are cut together, a step of all words at a time; long
words are cut one by one.  Decoding reads token texts from one buffer through an
offset table.

Defined cases: a NULL or empty text has no ids and decodes to the empty text;
rows, also repeated ones or such with a NULL id, are handled one by one; other
columns of the input are left out; empty tables give empty results.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from dockflow.llm.automaton import LongestFrom, Table

#: How the vocabulary's splitter reads a text (fixed values): contractions, runs of
#: letters, single numerals, runs of other signs.
KINDS = {1: r"\p{L}+", 2: r"\p{N}+", 3: r"[^\s\p{L}\p{N}]+"}
LETTER, NUMERAL, OTHER = 1, 2, 3
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
END = "</w>"

LAST = 0xE000  # added to the code of a word's last symbol
KEPT = 400_000  # words whose ids are kept from block to block, about 20 MB
PAIRS_BITS = 20  # of the table of known pairs, emptied when it is half full
LONG = 64  # symbols; longer words are cut one by one
BLOCK = 1 << 20  # characters encoded together
BATCH_BYTES = 8 << 20


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point; 0 stands between words."""
    table = np.zeros(0x110000, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    line, place = "".join(map(chr, points)), np.array(points)
    for kind, pattern in KINDS.items():
        for found in regex.finditer(pattern, line):
            table[place[found.start() : found.end()]] = kind
    return table


def words_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of a text's code points."""
    kind = kinds()[code]
    border = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == NUMERAL)) if len(code) else np.zeros(0, np.int64)
    end = np.append(border[1:], len(code))
    real = kind[border] != 0
    begin, end = border[real], end[real]
    # an apostrophe alone takes the letters of a contraction that follow it
    single = np.flatnonzero((code[begin] == ord("'")) & (end - begin == 1) if len(begin) else [])
    single = single[single + 1 < len(begin)]
    single = single[(begin[single + 1] == end[single]) & (kind[np.minimum(end[single], len(code) - 1)] == LETTER)]
    if len(single):
        at, room = begin[single + 1], end[single + 1] - begin[single + 1]
        first, second = code[at], code[np.minimum(at + 1, len(code) - 1)]
        taken = np.zeros(len(single), np.int64)
        for letters in reversed(CONTRACTIONS):
            hit = (first == ord(letters[0])) & (room >= len(letters))
            hit &= (second == ord(letters[-1])) if len(letters) == 2 else True
            taken[hit] = len(letters)
        end[single] += taken
        begin[single + 1] += taken
        there = begin < end
        begin, end = begin[there], end[there]
    return begin, end


BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses


@lru_cache(maxsize=1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE modulo 2**64 and of its inverse."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of 63 bits of each word, from running sums over the text."""
    power, inverse = powers(max(21, int(len(code)).bit_length()))
    c = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    c ^= c >> np.uint64(32)
    c *= np.uint64(0xBF58476D1CE4E5B9)
    c ^= c >> np.uint64(29)
    c *= power[: len(c)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c, dtype=np.uint64)])
    h = (sums[end] - sums[begin]) * inverse[begin]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(1)).view(np.int64)


def byte_symbols() -> dict[int, str]:
    """Printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def with_last_marked(token: str) -> str:
    """The token with its word end folded into the last symbol."""
    if token.endswith(END):
        body = token[: -len(END)]
        return body[:-1] + chr(LAST + ord(body[-1]))
    return token


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            whole = left.removesuffix(END) + right if left.endswith(END) else left + right
            pair = (vocab[left], vocab[right])
            self.merge_rank[pair] = rank
            self.parts.setdefault(vocab[whole], pair)
            self.made_at.setdefault(vocab[whole], rank)
        self._keys = {with_last_marked(token): i for token, i in vocab.items() if token != END}
        self._length = {i: len(key) for key, i in self._keys.items()}
        self._spines: dict[tuple[int, int], list] = {}
        self._find_own()
        self._symbols = byte_symbols()
        self._bytes = {c: b for b, c in self._symbols.items()}
        self._known, self._pairs = {}, Table(PAIRS_BITS)
        self._assigned: set[str] = set()  # characters seen that the tables know
        self._special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self._special_id = specials
        self._reader = Tokenizer.from_file(path)
        self.forget()
        names = {i: token for token, i in (vocab | specials).items()}
        texts = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self._offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self._buffer = np.frombuffer(b"".join(texts), np.uint8)

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """Tokens that touch one end of the token while it is built: token, the
        rank that makes it and the rank that takes it up."""
        known = self._spines.get((token, side))
        if known is None:
            known, taken = [], float("inf")
            while True:
                made = self.made_at.get(token, -1)
                known.append((token, made, taken))
                if made < 0:
                    break
                taken, token = made, self.parts[token][side]
            self._spines[known[0][0], side] = known
        return known

    def _fits(self, pair: tuple[int, int], before: float = float("inf")) -> bool:
        """No merge ranked under ``before`` joins the two across their border."""
        rank = self.merge_rank
        right = self._spine(pair[1], 0)
        for a, a_made, a_taken in self._spine(pair[0], 1):
            for b, b_made, b_taken in right:
                m = rank.get((a, b))
                # of equal pairs the left one merges first
                if m is not None and max(a_made, b_made) < m < before and m < a_taken and m <= b_taken:
                    return False
        return True

    def _find_own(self) -> None:
        """Keep the tokens that their own text leads to, and link each to the
        longest of its prefixes."""
        own: dict[int, bool] = {}
        for i in sorted(self._length, key=lambda t: self.made_at.get(t, -1)):
            if i not in self.parts:
                own[i] = True
            else:
                left, right = self.parts[i]
                own[i] = own[left] and own[right] and self._fits((left, right), self.made_at[i])
        shorter: dict[int, int] = {}
        search = ahocorasick.Automaton()
        symbols = {c: b for b, c in byte_symbols().items()}
        patterns: dict[tuple[int, ...], int] = {}
        for key, i in self._keys.items():
            if not own[i]:
                continue
            search.add_word(key, (i, len(key)))
            prefix = key[:-1]
            while prefix and not own.get(self._keys.get(prefix, -1), False):
                prefix = prefix[:-1]
            shorter[i] = self._keys[prefix] if prefix else -1
            if ord(key[-1]) >= LAST:
                patterns[(*map(symbols.__getitem__, key[:-1]), 256 + symbols[chr(ord(key[-1]) - LAST)])] = i
            else:
                patterns[tuple(map(symbols.__getitem__, key))] = i
        search.make_automaton()
        self._search, self._shorter, self._longest = search, shorter, LongestFrom(patterns)
        size = max(self._length) + 1
        self._sizes, self._next = np.zeros(size, np.int64), np.full(size, -1, np.int32)
        self._sizes[list(self._length)] = list(self._length.values())
        self._next[list(shorter)] = list(shorter.values())

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which neighbours are compatible; known pairs come from a table."""
        keys = left.astype(np.int64) << 32 | right
        found = self._pairs.find(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            if 2 * (self._pairs.n + len(new)) > 1 << PAIRS_BITS:
                self._pairs = Table(max(PAIRS_BITS, (2 * len(new)).bit_length()))
            fits = np.fromiter((self._fits((k >> 32, k & 0xFFFFFFFF)) for k in new.tolist()), np.int32, len(new))
            self._pairs.add(new, fits)
            missing = found < 0
            found[missing] = fits[np.searchsorted(new, keys[missing])]
        return found > 0

    def _cut_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of at most LONG bytes, all cut in step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        longest = self._longest.longest(symbols, ends[order], sizes[order])
        n, width = len(words), int(sizes.max()) + 1
        begin = ends - sizes
        out, failed = np.zeros((n, width), np.int32), np.zeros((n, width), bool)
        row, at, size = np.arange(n), np.zeros(n, np.int64), sizes
        token, last, top = longest[begin], np.full(n, -1, np.int32), np.zeros(n, np.int64)
        tops = np.zeros(n, np.int64)
        while len(row):
            # no token left for this place: it fails, and the token before gets shorter
            lost = np.flatnonzero(token < 0)
            if len(lost):
                if not top[lost].all():
                    raise ValueError("the vocabulary lacks a symbol")
                failed[row[lost], at[lost]] = True
                top[lost] -= 1
                popped = out[row[lost], top[lost]]
                at[lost] -= self._sizes[popped]
                token[lost] = self._next[popped]
                last[lost] = np.where(top[lost] > 0, out[row[lost], np.maximum(top[lost] - 1, 0)], -1)
            some = token >= 0
            end = np.where(some, at + self._sizes[token], 0)
            good = some & ~failed[row, end]
            ask = np.flatnonzero(good & (last >= 0))
            good[ask] = self._fit(last[ask], token[ask])
            token[some & ~good] = self._next[token[some & ~good]]
            put = np.flatnonzero(good)
            out[row[put], top[put]] = token[put]
            top[put] += 1
            at[put] = end[put]
            last[put] = token[put]
            done = at == size
            put = put[~done[put]]
            token[put] = longest[begin[put] + at[put]]
            if done.any():
                tops[row[done]] = top[done]
                stay = ~done
                row, at, size, token, last, top, begin = (x[stay] for x in (row, at, size, token, last, top, begin))
        flat = out[np.arange(width) < tops[:, None]].astype("<u4").tobytes()
        cut = [0, *(4 * np.cumsum(tops)).tolist()]
        return [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _cut(self, word: str) -> list[int]:
        """Token ids of a word of symbols."""
        n = len(word)
        longest = [-1] * n
        for end, (token, size) in self._search.iter(word):
            longest[end - size + 1] = token  # longer ones of a start come later
        length, shorter = self._length, self._shorter
        known = self._known = {} if len(self._known) > 100_000 else self._known

        def fits(pair: tuple[int, int]) -> bool:
            if pair not in known:
                known[pair] = self._fits(pair)
            return known[pair]

        out, failed = [longest[0]], None
        at, token = length[longest[0]], -1
        while at < n or failed and failed[at]:
            if failed is None or not failed[at]:
                token = longest[at]
                last = out[-1] if out else None
                while token >= 0:
                    end = at + length[token]
                    if (failed is None or not failed[end]) and (last is None or fits((last, token))):
                        break
                    token = shorter[token]
                if token >= 0:
                    out.append(token)
                    at = end
                    continue
                failed = failed or bytearray(n + 1)
                failed[at] = 1
            if not out:
                raise ValueError("the vocabulary lacks a symbol")
            # take the last token back and put a shorter one
            token = out.pop()
            begin = at - length[token]
            last = out[-1] if out else None
            token = shorter[token]
            while token >= 0:
                end = begin + length[token]
                if not failed[end] and (last is None or fits((last, token))):
                    break
                token = shorter[token]
            at = begin
            if token >= 0:
                out.append(token)
                at = end
            else:
                failed[at] = 1
        return out

    def _has_young(self, text: str) -> bool:
        """A code point that the tables here don't know."""
        new = set(text).difference(self._assigned)
        young = {c for c in new if unicodedata.category(c) == "Cn"}
        self._assigned |= new - young
        return bool(young)

    def _parts(self, text: str | None) -> list[str | bytes]:
        """A text in normal form, as parts for the block, or as ids already."""
        if not text:
            return []
        if self._special and "<|" in text and (found := self._special.search(text)):
            out, at = [], 0
            while found:
                out += [*self._parts(text[at : found.start()]), array("I", [self._special_id[found[0]]]).tobytes()]
                at = found.end()
                found = self._special.search(text, at)
            return [*out, *self._parts(text[at:])]
        if text.isascii():
            return [text.lower()]
        if self._has_young(text):  # too young for the tables here: let the tokenizer's reader split
            text = self._reader.normalizer.normalize_str(text)
            words = [bytes(map(self._bytes.__getitem__, w)) for w, _ in self._reader.pre_tokenizer.pre_tokenize_str(text)]
            return self._cut_words(words)
        # capital sigma letter by letter: it has no form of its own at a word's end
        return [unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()]

    def _cut_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        out: list[bytes] = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        short.sort(key=lambda k: len(words[k]))  # words of a step are of like length
        for at in range(0, len(short), 1 << 16):
            some = short[at : at + (1 << 16)]
            for k, ids in zip(some, self._cut_all([words[k] for k in some]), strict=True):
                out[k] = ids
        for k, word in enumerate(words):
            if len(word) > LONG:
                marked = word.decode("latin-1").translate(self._symbols)
                out[k] = array("I", self._cut(marked[:-1] + chr(LAST + ord(marked[-1])))).tobytes()
        return out

    def forget(self) -> None:
        """Empty the caches."""
        self._words, self._known = Table(18), {}  # hash of a word: its number
        self._ids, self._begin = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self._spines.clear()

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        held, size = [], 0
        for text in texts:
            held.append(self._parts(text))
            size += len(text or "")
            if size >= BLOCK:
                yield from self._encode_block(held)
                held, size = [], 0
        yield from self._encode_block(held)

    def _encode_block(self, texts: list[list[str | bytes]]) -> Iterator[bytes]:
        parts = iter(self._encode_parts([p for parts in texts for p in parts if isinstance(p, str)]))
        for found in texts:
            if len(found) == 1 and isinstance(found[0], str):
                yield next(parts)
            else:
                yield b"".join([next(parts) if isinstance(p, str) else p for p in found])

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """All words of all parts are found, hashed and looked up together; only new
        ones are cut."""
        if not parts:
            return []
        if self._words.n > KEPT:
            self.forget()
        whole = "\n".join(parts)
        code = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        begin, end = words_of(code)
        h = word_hashes(code, begin, end)
        number = self._words.find(h)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            found = self._cut_words([whole[a:b].encode() for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            known = len(self._begin) - 1
            self._words.add(new, np.arange(known, known + len(new), dtype=np.int32))
            self._ids = np.concatenate([self._ids, np.frombuffer(b"".join(found), "<u4")])
            self._begin = np.concatenate([self._begin, self._begin[-1] + np.cumsum([len(f) // 4 for f in found])])
            number[missing] = known + back
        size = self._begin[number + 1] - self._begin[number]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        ids = self._ids[np.repeat(self._begin[number] - after + size, size) + np.arange(total)].tobytes()
        borders = np.searchsorted(begin, np.cumsum([len(p) + 1 for p in parts]))
        cut = [0, *(4 * np.concatenate([[0], after])[borders]).tolist()]
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, as UTF-8."""
        out = []
        for at in range(0, len(ids), 1 << 20):
            i = np.frombuffer(ids[at : at + (1 << 20)], "<u4")
            begin = self._offsets[i]
            size = self._offsets[i + 1] - begin
            end = np.cumsum(size)
            where = np.arange(end[-1]) + np.repeat(begin - end + size, size)
            out.append(self._buffer[where].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text.

    ``tokenizer`` is the path of a tokenizer file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for batch in batches:
            begin, size, ids, texts = 0, 0, [], []
            for k, found in enumerate(coder.encode_all(batch.column(1).to_pylist())):
                ids.append(found)
                texts.append(coder.decode(found))
                size += len(ids[-1]) + len(texts[-1])
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    n = pa.array([len(i) // 4 for i in ids], pa.int64())
                    columns = [batch.column(0).slice(begin, len(ids)), n]
                    columns += [pa.array(ids, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])
                    begin, size, ids, texts = k + 1, 0, [], []

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
