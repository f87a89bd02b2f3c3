"""Suffix order with common-prefix values by external induced sorting.

The suffixes that start at leftmost-S positions are sorted first (their substrings get names, the string of names is
sorted in turn); all others are induced from them. Queues keyed by first symbol hold tuples (position, common prefix with
the tuple before) and move to disk when they outgrow memory; since suffixes are met in order, what a queue of one symbol
holds is in order too, so the smallest tuple is always at the front of the smallest symbol.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

NONE = np.int32(1 << 30)
SMALL_ALPHABET = 2048       # names up to here are sorted by induction again, beyond it by doubling their ranks


class BucketQueue:
    """First in, first out per symbol; over `limit` tuples in memory, all of them are moved to files in `folder`."""

    def __init__(self, symbols: int, limit: int, folder: str):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.limit, self.folder, self.held, self.files = limit, folder, 0, 0

    def push(self, symbols: np.ndarray, where: np.ndarray, common: np.ndarray) -> None:
        """Tuples grouped by symbol, in order within each."""
        edges = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1]))).tolist() + [len(symbols)] if len(symbols) else []
        for a, b in zip(edges[:-1], edges[1:]):
            self.parts[symbols[a]].append((where[a:b], common[a:b]))
        self.held += len(symbols)
        if self.held > self.limit:
            self._spill()

    def add(self, symbol: int, where: np.ndarray, common: np.ndarray) -> None:
        self.parts[symbol].append((where, common))
        self.held += len(where)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        for symbol, parts in enumerate(self.parts):
            live = [p for p in parts if not isinstance(p, str)]
            if live:
                path = os.path.join(self.folder, f"{id(self)}-{symbol}-{self.files}.npy")
                self.files += 1
                np.save(path, np.stack([np.concatenate([p[k] for p in live]).astype(np.int64) for k in (0, 1)]))
                self.parts[symbol] = [p for p in parts if isinstance(p, str)] + [path]
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """Everything queued for `symbol`, in order; the queue of it is empty then."""
        got = []
        for part in self.parts[symbol]:
            if isinstance(part, str):
                both = np.load(part)
                os.remove(part)
                got.append((both[0], both[1].astype(np.int32)))
            else:
                self.held -= len(part[0])
                got.append(part)
        self.parts[symbol] = []
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


class SuffixSorter:
    """`text`: non-negative integers that end with the only 0. Common prefixes are counted up to `cap`."""

    def __init__(self, text: np.ndarray, cap: int, limit: int = 1 << 23, folder: str | None = None):
        self.top = folder or tempfile.mkdtemp(prefix="suffix-")
        self.mine = folder is None
        self.n, self.cap, self.limit = len(text), cap, limit
        self.text = self._kept(text.astype(np.int32), "text")
        differ = np.sign(np.diff(text.astype(np.int64), append=-1))       # against the next symbol
        at = np.where(differ != 0, np.arange(self.n), self.n - 1)
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        small = differ[nearest] > 0
        small[-1] = True
        self.small = self._kept(small, "types")                           # S-type: smaller than the suffix behind it
        self.run = self._kept(np.minimum(nearest - np.arange(self.n) + 1, cap).astype(np.int32), "runs")
        self.symbols = int(text.max()) + 1 if self.n else 1

    def _kept(self, array: np.ndarray, name: str) -> np.ndarray:
        """In memory up to the limit, else mapped from a file."""
        if len(array) <= self.limit:
            return array
        path = os.path.join(self.top, f"{id(self)}-{name}")
        array.tofile(path)
        return np.memmap(path, array.dtype, "r")

    def close(self) -> None:
        if self.mine:
            shutil.rmtree(self.top, ignore_errors=True)

    def _names(self, starts: np.ndarray) -> np.ndarray:
        """Ranks of the substrings from each start to the next; at a tie the longer is the smaller, so short ones end in +∞."""
        ends = np.concatenate((starts[1:] + 1, [self.n]))
        rank = np.zeros(len(starts), np.int64)
        open_ = np.arange(len(starts))
        step = 0
        while len(open_):
            key = np.zeros(len(open_), np.uint64)
            for k in range(3):
                at = starts[open_] + 3 * step + k
                inside = at < ends[open_]
                symbol = np.where(inside, self.text[np.minimum(at, self.n - 1)], (1 << 21) - 1)
                key = key << np.uint64(21) | symbol.astype(np.uint64)
            order = np.lexsort((key, rank[open_]))
            open_, key = open_[order], key[order]
            group = rank[open_]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
            head = np.concatenate(([True], group[1:] != group[:-1]))
            place = np.arange(len(open_))
            rank[open_] = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
            size = np.diff(np.append(np.flatnonzero(new), len(open_)))
            step += 1
            goes_on = np.logical_or.reduceat(starts[open_] + 3 * step < ends[open_], np.flatnonzero(new))
            open_ = open_[np.repeat((size > 1) & goes_on, size)]
        return np.unique(rank, return_inverse=True)[1]

    def _seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """The leftmost-S suffixes in order, with their common prefixes."""
        starts = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        if self.n == 1:
            starts = np.zeros(1, np.int64)
        names = self._names(starts)
        count = int(names.max()) + 1
        if count == len(names):
            order = np.argsort(names)
        elif count <= SMALL_ALPHABET:
            inner = SuffixSorter(names, 0, self.limit, self.top)
            order = np.concatenate([where for where, _ in inner.suffixes()])
        else:
            order = _doubled(names)
        seeds = starts[order]
        return seeds, self._prefixes(seeds)

    def _prefixes(self, order: np.ndarray) -> np.ndarray:
        common = np.zeros(len(order), np.int32)
        open_ = np.arange(1, len(order))
        for k in range(self.cap):
            if not len(open_):
                break
            a, b = order[open_ - 1] + k, order[open_] + k
            inside = np.maximum(a, b) < self.n
            open_ = open_[inside][self.text[a[inside]] == self.text[b[inside]]]
            common[open_] = k + 1
        return common

    def _scan(self, where: np.ndarray, common: np.ndarray, kind: bool, state: dict) -> None:
        """Queue the suffixes before `where` that are of type `kind`: one more common symbol than the least common
        prefix met since the last suffix that went to the same queue."""
        if not len(where):
            return
        idx = np.flatnonzero((where > 0) & (self.small[np.maximum(where - 1, 0)] == kind))
        least, seen = state["least"], state["seen"]
        symbol = self.text[where[idx] - 1]
        order = np.argsort(symbol, kind="stable")
        idx, symbol = idx[order], symbol[order]
        if len(idx):
            head = np.concatenate(([True], symbol[1:] != symbol[:-1]))
            out = np.empty(len(idx), np.int32)
            h = np.flatnonzero(head)
            out[h] = np.minimum(least[symbol[h]], np.minimum.accumulate(common)[idx[h]])
            t = np.flatnonzero(~head)
            if len(t):
                out[t] = _range_min(common, idx[t - 1] + 1, idx[t])
            out = np.minimum(out + 1, self.cap)
            out[h[~seen[symbol[h]]]] = 0
            np.minimum(least, common.min(), out=least)
            tail = np.concatenate((symbol[1:] != symbol[:-1], [True]))
            behind = np.append(np.minimum.accumulate(common[::-1])[::-1], NONE)
            least[symbol[tail]] = behind[idx[tail] + 1]
            seen[symbol[h]] = True
            state["queue"].push(symbol, where[idx] - 1, out)
        else:
            np.minimum(least, common.min(), out=least)

    def _state(self) -> dict:
        return {"least": np.full(self.symbols, NONE, np.int32), "seen": np.zeros(self.symbols, bool),
                "queue": BucketQueue(self.symbols, self.limit, self.top)}

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes in ascending order: blocks of (positions, common prefix with the one before)."""
        seeds, seed_common = self._seeds()
        first = self.text[seeds]
        cut = np.searchsorted(first, np.arange(self.symbols + 1))
        used = np.flatnonzero(np.bincount(self.text, minlength=self.symbols))
        state = self._state()
        large = BucketQueue(self.symbols, self.limit, self.top)
        for c in used.tolist():
            last = None
            while True:
                where, common = state["queue"].pop(c)
                if not len(where):
                    break
                large.add(c, where, common)
                last = where[-1]
                self._scan(where, common, False, state)
            where, common = seeds[cut[c] : cut[c + 1]], seed_common[cut[c] : cut[c + 1]].copy()
            if len(where):
                common[0] = 0 if last is None else min(self.run[last], self.run[where[0]])
                self._scan(where, common, False, state)
        state = self._state()
        small = BucketQueue(self.symbols, self.limit, self.top)
        kept = BucketQueue(self.symbols, self.limit, self.top)
        for c in used[::-1].tolist():
            last = None
            if c == 0:
                where, common = np.array([self.n - 1]), np.zeros(1, np.int32)
                small.add(c, where, common)
                last = self.n - 1
                self._scan(where, common, True, state)
            while True:
                where, common = state["queue"].pop(c)
                if not len(where):
                    break
                small.add(c, where, common)
                last = where[-1]
                self._scan(where, common, True, state)
            where, common = large.pop(c)
            if len(where):
                kept.add(c, where, common)
                joint = 0 if last is None else min(self.run[last], self.run[where[-1]])
                self._scan(where[::-1], np.concatenate(([joint], common[:0:-1])).astype(np.int32), True, state)
        for c in used.tolist():
            where, common = kept.pop(c)
            last = where[-1] if len(where) else None
            if len(where):
                yield where, common
            where, common = small.pop(c)
            if len(where):
                joint = 0 if last is None else min(self.run[last], self.run[where[-1]])
                yield where[::-1], np.concatenate(([joint], common[:0:-1])).astype(np.int32)


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low..high]) for many ranges, from minima over powers of two."""
    size = high - low + 1
    level = np.floor(np.log2(size)).astype(np.int64)
    out = np.empty(len(low), values.dtype)
    table = values
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order by doubling ranks; only ranks that are still shared are refined."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    sorted_ = names[order]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.concatenate(([True], sorted_[1:] != sorted_[:-1])), np.arange(n), 0)) + 1
    rank[n] = 0
    open_, k = np.arange(n), 1
    while True:
        size = np.bincount(rank[:n])
        open_ = open_[size[rank[open_]] > 1]
        if not len(open_):
            return np.argsort(rank[:n])
        behind = rank[np.minimum(open_ + k, n)]
        perm = np.lexsort((behind, rank[open_]))
        open_, behind = open_[perm], behind[perm]
        group = rank[open_]
        head = np.concatenate(([True], group[1:] != group[:-1]))
        new = head | np.concatenate(([True], behind[1:] != behind[:-1]))
        place = np.arange(len(open_))
        rank[open_] = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        k *= 2
