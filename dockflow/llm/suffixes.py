"""Suffix arrays by induced sorting, in numpy.

The scans over the array go bucket by bucket: all suffixes that a bucket's
entries induce are put to their buckets at once, in order, so the steps in Python
depend on the alphabet and its runs, not on the text's length.
"""

from __future__ import annotations

import numpy as np


def types_of(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), False where larger."""
    n = len(t)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    rise[-1] = 1  # the end
    decided = np.where(rise != 0, np.arange(n), n - 1)
    return rise[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the ordered leftmost-smaller ones.

    If those are only ordered by their first symbols, their substrings come out
    ordered.
    """
    first = t[lms]
    order = np.argsort(first, kind="stable")
    starts = lms[order]
    border = np.searchsorted(first[order], np.arange(symbols + 1))

    def spread(at: np.ndarray, c: int, wanted: bool, to: list[list]) -> np.ndarray:
        """Give the wanted predecessors to their buckets; return those of bucket c."""
        p = at[at > 0] - 1
        p = p[small[p] == wanted]
        ch = t[p]
        own = ch == c
        rest = p[~own]
        ch = ch[~own]
        by = np.argsort(ch, kind="stable")
        ch, rest = ch[by], rest[by]
        cut = np.flatnonzero(ch[1:] != ch[:-1]) + 1
        for part in np.split(rest, cut) if len(rest) else ():
            to[t[part[0]]].append(part)
        return p[own]

    def scan(own: list[np.ndarray], c: int, wanted: bool, to: list[list]) -> np.ndarray:
        """Go through a bucket, which grows meanwhile."""
        done, at = [], np.concatenate(own) if own else lms[:0]
        while len(at):
            done.append(at)
            at = spread(at, c, wanted, to)
        return np.concatenate(done) if done else lms[:0]

    large: list[list] = [[] for _ in range(symbols)]
    larger = []
    for c in range(symbols):
        larger.append(scan(large[c], c, False, large))
        spread(starts[border[c] : border[c + 1]], c, False, large)
    smalls: list[list] = [[] for _ in range(symbols)]
    smalls[0].append(np.array([len(t) - 1], lms.dtype))
    smaller = [lms[:0]] * symbols
    for c in reversed(range(symbols)):
        smaller[c] = scan(smalls[c], c, True, smalls)
        spread(larger[c][::-1], c, True, smalls)
    return np.concatenate([x for c in range(symbols) for x in (larger[c], smaller[c][::-1])])


def words_at(t: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on as one number (zeros after the end)."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(t),), (1,)).copy()


def ordered(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text of names: a rank is the first place of its
    equals, and ranks of twice the length come from pairs of ranks.  Only suffixes
    that still have an equal are sorted again."""
    n, reach = len(names), 1

    def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the group of each place begins, and the places that share theirs."""
        new = np.concatenate([[True], key[1:] != key[:-1]])
        return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)), ~(new & np.append(new[1:], True))

    order = np.argsort(names)
    first, tied = groups(names[order])
    rank = np.empty(n, np.int64)
    rank[order] = first
    at = np.flatnonzero(tied)
    while len(at):
        x = order[at]
        after = np.zeros(len(x), np.int64)
        inside = x + reach < n
        after[inside] = rank[x[inside] + reach] + 1
        key = rank[x] * (n + 2) + after
        by = np.argsort(key)
        x = x[by]
        order[at] = x
        first, tied = groups(key[by])
        rank[x] = at[first]
        at = at[tied]
        reach *= 2
    return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """``t``: symbols as unsigned bytes; the last one is 0 and the only 0."""
    symbols = int(t.max()) + 1
    small = types_of(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        first = induce(t, small, lms, symbols)
        by_substring = first[is_lms[first]]
        # name the substrings: equal ones are neighbours
        size = np.zeros(len(t), np.int64)
        size[lms[:-1]] = np.diff(lms) + 1
        size[lms[-1]] = 1
        a, b = by_substring[1:], by_substring[:-1]
        word = words_at(t)
        masks = np.array([(1 << 8 * m) - 1 for m in range(9)], np.uint64)
        new = size[a] != size[b]
        open_ = np.flatnonzero(~new)
        reach = 0
        while len(open_):
            x, y = a[open_], b[open_]
            left = np.minimum(size[x] - reach, 8)
            differ = ((word[x + reach] ^ word[y + reach]) & masks[left]) != 0
            new[open_[differ]] = True
            open_ = open_[~differ & (left == 8)]
            reach += 8
            open_ = open_[size[a[open_]] > reach]
        name = np.zeros(len(t), np.int64)
        name[by_substring] = np.concatenate([[0], np.cumsum(new)])
        lms = lms[ordered(name[lms])]
    return induce(t, small, lms, symbols)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place, the symbols its suffix shares with the one before it in
    the array, counted up to ``most`` at least.

    Only where the symbols before the two differ must they be compared; each
    place after that shares one symbol less than the place before.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    chained = (before > 0) & (place > 0)
    chained[chained] = t[place[chained] - 1] == t[before[chained] - 1]
    shared = np.zeros(n, np.int64)
    word = words_at(t)
    open_ = np.flatnonzero(~chained & (before >= 0))
    reach = 0
    while len(open_) and reach < most:
        x, y = open_ + reach, before[open_] + reach
        inside = (x < n) & (y < n)
        open_, x, y = open_[inside], x[inside], y[inside]
        differ = word[x] ^ word[y]
        low = differ & (~differ + np.uint64(1))  # the lowest bit in which they differ
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        shared[open_] += same
        open_ = open_[same == 8]
        reach += 8
    start = np.maximum.accumulate(np.where(chained, 0, place))
    return np.maximum(shared[start] - (place - start), 0)
