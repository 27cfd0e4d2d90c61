"""A packed Aho-Corasick automaton: all places of many names in many texts, in one pass over the texts.

States and edges are numpy arrays (edges in an open-addressing table), so an automaton is sent to workers as it is, without
objects to build again. Texts are laid end to end and cut into lanes of equal length that advance together, one character a
step; a lane starts early enough to know every name that ends within it.
"""

from __future__ import annotations

import numpy as np

LANES = 8192  # at most so many advance together
LEAST_LANE = 256  # characters
BYTES_A_CHARACTER = 64  # what a character of a name takes at most
NONE = 0x110000  # the number of no character
DENSE = 1 << 20  # states times symbols at most for which a table is made, if texts are longer than it


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Automaton:
    def __init__(self, names: list[str]):
        """names: different, not empty. They are known by their numbers in this list."""
        self.lengths = np.array([len(n) for n in names], np.int64)
        order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        text, begins = points("".join(names)), np.cumsum(self.lengths) - self.lengths
        self.symbols, symbol = np.unique(text, return_inverse=True)
        self.longest, self.width = int(self.lengths.max(initial=0)), len(self.symbols)
        node, live, n, depth, levels, ends = np.zeros(len(names), np.int64), order, 1, 0, [], []
        while len(live):
            keys, which = np.unique(node[live] * self.width + symbol[begins[live] + depth], return_inverse=True)
            node[live] = n + which
            levels.append((keys, n))
            n, depth = n + len(keys), depth + 1
            done = self.lengths[live] == depth
            ends.append(live[done])
            live = live[~done]
        self.name = np.full(n, -1, np.int32)
        for x in ends:
            self.name[node[x]] = x
        self._fill_table(np.concatenate([k for k, _ in levels]) if levels else np.zeros(0, np.int64))
        self.root = np.zeros(self.width + 1, np.int32)  # the last for characters that no name has
        if levels:
            self.root[levels[0][0]] = np.arange(1, 1 + len(levels[0][0]))
        self._link(levels, n)

    def _fill_table(self, keys: np.ndarray) -> None:
        """Edges key -> state; keys are in the order of the states that they lead to, from 1."""
        bits = max(4, int(2 * len(keys) + 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.edge, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.edge[slot[left]] < 0]
            self.edge[slot[free]] = keys[free]
            won = self.edge[slot[left]] == keys[left]
            self.to[slot[left[won]]] = left[won] + 1
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _edge(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state that each edge leads to, -1 without such an edge."""
        keys = state * np.int64(self.width) + symbol
        slot, out, left = self._slot(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(left):
            there = self.edge[slot]
            hit = there == keys
            out[left[hit]] = self.to[slot[hit]]
            on = ~hit & (there >= 0)
            left, keys, slot = left[on], keys[on], (slot[on] + 1) & self.mask
        return out

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one character more (symbol: width for a character that no name has)."""
        out = self.root[symbol].astype(np.int64)
        left = np.flatnonzero((state > 0) & (symbol < self.width))
        at = state[left]
        while len(left):
            to = self._edge(at, symbol[left])
            out[left[to >= 0]] = to[to >= 0]
            at, left = self.fail[at[to < 0]].astype(np.int64), left[to < 0]
            at, left = at[at > 0], left[at > 0]  # at the root the answer stands already
        return out

    def _link(self, levels: list[tuple[np.ndarray, int]], n: int) -> None:
        """fail: the state of the longest proper suffix; other: the next state on that way at which a name ends, 0 if none."""
        self.fail, self.other = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for keys, first in levels[1:]:
            state = slice(first, first + len(keys))
            fail = self._next(self.fail[keys // self.width].astype(np.int64), keys % self.width)
            self.fail[state] = fail
            self.other[state] = np.where(self.name[fail] >= 0, fail, self.other[fail])

    def _table(self) -> np.ndarray:
        """The state after each state and symbol. It doesn't travel: it is made where it is used."""
        own = np.flatnonzero(self.edge >= 0)
        keys = self.edge[own[np.argsort(self.to[own])]]  # by the states that they lead to, so by those that they come from
        before, symbol = np.divmod(keys, self.width)
        out, end = np.zeros((len(self.name), self.width + 1), np.int64), 0
        while end < len(keys):  # level by level: what doesn't go on goes as from the longest proper suffix
            level = slice(end, end := int(np.searchsorted(before, end + 1)))
            new = np.arange(level.start, end) + 1
            out[before[level], symbol[level]] = new
            out[new] = out[self.fail[new]]
        return out.ravel()

    def _symbols(self, text: np.ndarray) -> np.ndarray:
        last = int(self.symbols[-1])
        known = np.full(last + 2, self.width, np.int32)
        known[self.symbols] = np.arange(self.width)
        return known[np.minimum(text, last + 1)]

    def _ends(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, state) of every place at which a name ends, and where texts end among these places."""
        sizes = np.array([len(t) for t in texts], np.int64)
        total, ends = int(sizes.sum()) + len(texts), np.cumsum(sizes + 1)  # one character between texts that no name has
        if not self.width or not total:
            return *(np.zeros(0, np.int64),) * 3, ends
        joined = points("\0".join(texts) + "\0").copy()
        joined[ends - 1] = NONE
        lane = max(LEAST_LANE, 4 * self.longest, -(-total // LANES))
        before = self.longest - 1
        symbol = np.full(before + -(-total // lane) * lane, self.width, np.int32)
        symbol[before : before + total] = self._symbols(joined)
        begin = np.arange(-(-total // lane)) * lane
        named, state, places, states = (self.name >= 0) | (self.other > 0), np.zeros(len(begin), np.int64), [], []
        cells, wide = len(self.name) * (self.width + 1), self.width + 1
        table = self._table() if cells <= min(DENSE, total) else None
        for k in range(before + lane):
            at = symbol[begin + k]
            state = self._next(state, at) if table is None else table[state * wide + at]
            if k >= before:
                hit = np.flatnonzero(named[state])
                places.append(begin[hit] + (k - before))
                states.append(state[hit])
        place = np.concatenate(places)
        return np.searchsorted(ends, place, side="right"), place, np.concatenate(states), ends

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, name) of every occurrence, also of names within names, by text, start and length."""
        text, place, state, ends = self._ends(texts)
        texts_, where, named = [text[:0]], [place[:0]], [state[:0]]
        while len(state):
            own = self.name[state] >= 0
            texts_.append(text[own])
            where.append(place[own])
            named.append(self.name[state[own]].astype(np.int64))
            state = self.other[state].astype(np.int64)
            text, place, state = text[state > 0], place[state > 0], state[state > 0]
        text, place, name = np.concatenate(texts_), np.concatenate(where), np.concatenate(named)
        start = place - self.lengths[name] + 1 - np.concatenate([[0], ends])[text]
        order = np.lexsort((self.lengths[name], start, text))
        return text[order], start[order], name[order]

    def held(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, name): the names that each text holds, each once, by text and name."""
        text, _, state, _ = self._ends(texts)
        each, n = [text[:0]], len(self.name)
        both = np.unique(text * n + state)  # a text's states repeat, so names are read from each once
        text, state = np.divmod(both, n)
        while len(state):
            own = self.name[state] >= 0
            each.append(text[own] * n + self.name[state[own]])
            state = self.other[state].astype(np.int64)
            both = np.unique((text * n + state)[state > 0])
            text, state = np.divmod(both, n)
        return np.divmod(np.unique(np.concatenate(each)), n)

    def longest_first(self, texts: list[str], most: int) -> list[tuple[int, int, int]]:
        """(text, start, name): the longest name at each place, from the left, each after the end of the one before, at most so many a text."""
        text, start, name = self.find(texts)
        last = np.ones(len(text), bool)  # the longest of those that begin together comes last
        last[:-1] = (text[1:] != text[:-1]) | (start[1:] != start[:-1])
        out, now, free, taken = [], -1, 0, 0
        for t, s, k, n in zip(text[last].tolist(), start[last].tolist(), name[last].tolist(), self.lengths[name[last]].tolist()):
            if t != now:
                now, free, taken = t, 0, 0
            if s >= free and taken < most:
                out.append((t, s, k))
                free, taken = s + n, taken + 1
        return out
