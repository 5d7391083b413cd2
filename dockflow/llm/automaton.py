"""Lookups for many keys or words at once."""

from __future__ import annotations

import numpy as np


class Table:
    """Whole numbers (0 or more) to small whole numbers (also 0 or more), by open addressing."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).view(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that are not in the table; it grows before it is half full."""
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            there = self.keys >= 0
            old = self.keys[there], self.values[there]
            self.__init__((2 * self.n).bit_length() + 1)
            self.add(*old)
            self.n += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]  # of several for one slot, one stays
            put = self.keys[slots] == keys
            self.values[slots[put]] = values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for unknown keys."""
        slots = self._slots(keys)
        there = self.keys[slots]
        found = np.where(there == keys, self.values[slots], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[left]]
            hit = there == keys[left]
            found[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (there != -1)]
        return found


class LongestFrom:
    """An Aho-Corasick automaton over the reversed patterns: read from its right
    end, a word gives at each place the longest pattern that starts there."""

    SYMBOLS = 512

    def __init__(self, patterns: dict[tuple[int, ...], int]):
        goto: dict[int, int] = {}
        parent, symbol, own = [0], [0], [-1]
        for pattern, value in patterns.items():
            node = 0
            for s in reversed(pattern):
                key = node * self.SYMBOLS + s
                child = goto.get(key)
                if child is None:
                    child = goto[key] = len(own)
                    parent.append(node)
                    symbol.append(s)
                    own.append(-1)
                node = child
            own[node] = value
        depth = np.zeros(len(own), np.int64)
        for node in range(1, len(own)):
            depth[node] = depth[parent[node]] + 1
        fail = [0] * len(own)
        for node in np.argsort(depth, kind="stable")[1:].tolist():
            at, s = parent[node], symbol[node]
            found = 0
            while at:
                at = fail[at]
                found = goto.get(at * self.SYMBOLS + s, 0)
                if found:
                    break
            fail[node] = found
            if own[node] < 0:
                own[node] = own[found]
        self.fail, self.own = np.array(fail, np.int64), np.array(own, np.int32)
        self.goto = Table(max(4, (2 * len(goto)).bit_length()))
        self.goto.add(np.fromiter(goto.keys(), np.int64, len(goto)), np.fromiter(goto.values(), np.int32, len(goto)))
        self.first = np.maximum(self.goto.find(np.arange(self.SYMBOLS)), 0).astype(np.int64)  # from the root

    def longest(self, symbols: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each place of ``symbols``, the value of the longest pattern that
        starts there and ends inside the word (-1: none).  Words are given by where
        they end, the longest first."""
        out = np.full(len(symbols), -1, np.int32)
        state = np.zeros(len(ends), np.int64)
        active = len(ends)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[active - 1] <= step:
                active -= 1
            place = ends[:active] - 1 - step
            s = symbols[place]
            at = state[:active]
            after = np.where(at == 0, self.first[s], self.goto.find(at * self.SYMBOLS + s))
            lost = np.flatnonzero(after < 0)
            while len(lost):
                back = self.fail[state[lost]]
                state[lost] = back
                after[lost] = np.where(back == 0, self.first[s[lost]], self.goto.find(back * self.SYMBOLS + s[lost]))
                lost = lost[after[lost] < 0]
            state[:active] = after
            out[place] = self.own[after]
        return out
