"""Suffix sorting of a shard by induction, with queues that go to disk.

Suffixes are L or S type; the leftmost S suffixes (LMS) are sorted first, and
all others are induced from them: L types in ascending, S types in descending
order of first symbol.  The pending suffixes form a priority queue keyed by
(symbol, order of insertion).  It is kept as one run a symbol; a run is a list
of blocks, and once the blocks in memory exceed a budget they are appended to
a file and read back when their symbol comes up.  Within a symbol, whole blocks
are induced at once.

LMS substrings are sorted by the same induction and named; where names repeat,
the string of names is sorted recursively.  A string of names with a large
alphabet is the base of the recursion and is sorted by doubling ranks.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

LARGE_ALPHABET = 4096


class RunQueue:
    """Runs of suffix positions by symbol, in order of insertion; beyond ``budget`` bytes they are on disk."""

    def __init__(self, budget: int):
        self.budget, self.used, self.file, self.end = budget, 0, None, 0
        self.runs: dict[int, list] = defaultdict(list)

    def push(self, symbol: int, block: np.ndarray) -> None:
        self.runs[symbol].append(block)
        self.used += block.nbytes
        if self.used > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        for symbol, run in self.runs.items():
            for i, block in enumerate(run):
                if isinstance(block, np.ndarray):
                    self.file.write(np.ascontiguousarray(block).tobytes())
                    run[i] = (self.end, len(block))
                    self.end += block.size * 4
        self.used = 0

    def pop(self, symbol: int) -> np.ndarray:
        blocks = []
        for block in self.runs.pop(symbol, ()):
            if isinstance(block, tuple):
                self.file.seek(block[0])
                block = np.frombuffer(self.file.read(4 * block[1]), np.int32)
            else:
                self.used -= block.nbytes
            blocks.append(block)
        return np.concatenate(blocks) if len(blocks) > 1 else blocks[0] if blocks else np.zeros(0, np.int32)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last one, a unique smallest symbol, is."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = 1
    place = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def _scatter(queue: RunQueue, symbols: np.ndarray, suffixes: np.ndarray) -> None:
    if not len(suffixes):
        return
    order = np.argsort(symbols, kind="stable")
    symbols, suffixes = symbols[order], suffixes[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(symbols)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        queue.push(int(symbols[a]), suffixes[a:b])


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, budget: int) -> np.ndarray:
    """All suffixes, induced from the LMS suffixes ``seeds`` in their order."""
    alphabet = int(text.max()) + 1
    ascending, descending, small, large = RunQueue(budget), RunQueue(budget), RunQueue(budget), RunQueue(budget)
    _scatter(small, text[seeds], seeds)

    def before(block: np.ndarray, wanted: bool) -> tuple[np.ndarray, np.ndarray]:
        prior = block[block > 0] - 1
        prior = prior[is_s[prior] == wanted].astype(np.int32)
        return prior, text[prior]

    for c in range(alphabet):
        block = ascending.pop(c)
        while len(block):
            large.push(c, block)
            prior, symbols = before(block, False)
            same = symbols == c
            _scatter(ascending, symbols[~same], prior[~same])
            block = prior[same]
        block = small.pop(c)
        if len(block):
            prior, symbols = before(block, False)
            _scatter(ascending, symbols, prior)
    out = []
    for c in reversed(range(alphabet)):
        block = descending.pop(c)
        while len(block):
            out.append(block)
            prior, symbols = before(block, True)
            same = symbols == c
            _scatter(descending, symbols[~same], prior[~same])
            block = prior[same]
        block = large.pop(c)[::-1]
        if len(block):
            out.append(block)
            prior, symbols = before(block, True)
            _scatter(descending, symbols, prior)
    for queue in (ascending, descending, small, large):
        queue.close()
    out.append(np.array([len(text) - 1], np.int32))
    return np.concatenate(out)[::-1]


def _doubling(text: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet by doubling ranks."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:] if width < n else second[: max(0, n - width)]
        key = rank * (n + 1) + second + 1
        known, rank = np.unique(key, return_inverse=True)
        if len(known) == n or width >= n:
            return np.argsort(rank, kind="stable").astype(np.int32)
        width *= 2


def suffix_array(text: np.ndarray, budget: int = 64 << 20) -> np.ndarray:
    """Suffix array of non-negative symbols whose last one is the unique smallest."""
    text = np.asarray(text)
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable").astype(np.int32)
    is_s = s_types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    if len(lms) > 1:
        order = induce(text, is_s, lms, budget)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        length = np.zeros(n, np.int32)
        length[lms] = np.diff(np.append(lms, n - 1)) + 1
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        equal = length[a] == length[b]
        active = np.flatnonzero(equal)
        j = 0
        while len(active):
            x, y = a[active] + j, b[active] + j
            differ = (text[x] != text[y]) | (is_s[x] != is_s[y])
            equal[active[differ]] = False
            j += 1
            active = active[~differ]
            active = active[length[a[active]] > j]
        names = np.zeros(n, np.int64)
        names[order] = np.concatenate([[0], np.cumsum(~equal)])
        reduced = names[lms]
        if equal.any():
            sub = suffix_array(reduced, budget) if reduced.max() < LARGE_ALPHABET and reduced[-1] == 0 and np.count_nonzero(reduced == 0) == 1 else _doubling(reduced)
            lms = lms[sub]
        else:
            lms = order
    return induce(text, is_s, lms, budget)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``most`` symbols, read by words of eight bytes."""
    out = np.full(len(order), most, np.int32)
    out[:1] = 0
    wide = 8 // text.itemsize
    padded = np.append(text, np.zeros(most + wide, text.dtype))
    words = np.ndarray(len(text) + most, "<u8", padded.astype(text.dtype.newbyteorder("<")), strides=(text.itemsize,))
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    active = np.arange(1, len(order))
    for done in range(0, most, wide):
        differ = words[a + done] ^ words[b + done]
        ends = differ != 0
        lowest = differ[ends] & (~differ[ends] + np.uint64(1))
        out[active[ends]] = done + np.log2(lowest.astype(np.float64)).astype(np.int64) // (8 * text.itemsize)
        active, a, b = active[~ends], a[~ends], b[~ends]
        if not len(active):
            break
    out[1:] = np.minimum(out[1:], len(text) - np.maximum(order[:-1], order[1:]))
    return np.minimum(out, most)
