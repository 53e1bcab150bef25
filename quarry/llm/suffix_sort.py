"""External suffix sorting by induction, with common-prefix values.

The suffixes that start a rise after a fall (here: seeds) are sorted first, by naming the substrings between them and
sorting the shorter string of names in the same way. From their order that of all others is induced: a monotone queue
holds (suffix, common prefix with the one before it), by first symbol and then by arrival. Taking symbols in ascending
order and putting the suffix one place to the left of each taken one back in the queue sorts those that fall; descending,
those that rise. The value carried to a neighbour is one more than the least value between the two taken suffixes.

The queue spills to files when it outgrows its memory (``spilled`` counts how often), and the string may be a memory map:
a bucket is all of the order that must be held at a time. Work goes by whole buckets and rounds of a repeated symbol, so it
is done on arrays. What stays in memory in proportion to the string are the seeds, about a third of its places, with their
names: some 20 bytes for each byte of the string.
Prefixes are told apart up to ``cap`` symbols; beyond, the order of equal ones is not defined.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator


class SpillQueue:
    """A monotone priority queue of (suffixes, prefixes) arrays by symbol, each symbol's in the order they were put."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory = folder, memory
        self.held: dict[int, list] = {}
        self.size = 0
        self.spills = 0
        self.files: list[str] = []
        self.spilled: dict[int, list[tuple[str, int, int]]] = {}

    def put(self, symbol: int, suffixes, prefixes) -> None:
        self.held.setdefault(symbol, []).append((suffixes, prefixes))
        self.size += suffixes.nbytes + prefixes.nbytes
        if self.size > self.memory:
            self._spill()

    def _spill(self) -> None:
        handle, path = tempfile.mkstemp(dir=self.folder)
        self.files.append(path)
        self.spills += 1
        with os.fdopen(handle, "wb") as f:
            for symbol in sorted(self.held):
                for suffixes, prefixes in self.held[symbol]:
                    self.spilled.setdefault(symbol, []).append((path, f.tell(), len(suffixes)))
                    f.write(suffixes.astype("<i8").tobytes())
                    f.write(prefixes.astype("<i2").tobytes())
        self.held, self.size = {}, 0

    def take(self, symbol: int):
        """All of a symbol's, in one array each; the first has no one before it."""
        import numpy as np

        found = []
        for path, at, n in self.spilled.pop(symbol, []):
            with open(path, "rb") as f:
                f.seek(at)
                found.append((np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(2 * n), "<i2")))
        own = self.held.pop(symbol, [])
        self.size -= sum(a.nbytes + b.nbytes for a, b in own)
        found += own
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int16)
        suffixes, prefixes = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
        prefixes[0] = 0
        return suffixes, prefixes

    def close(self) -> None:
        for path in self.files:
            os.unlink(path)
        self.files = []


def _seeds(text, block: int = 1 << 20):
    """Where a rise begins after a fall (a suffix rises if it is less than the next one), block by block from the end."""
    import numpy as np

    n, found = len(text), []
    rises = False  # of the suffix after the block, or the last one
    for begin in range((n - 1) // block * block, -1, -block):
        part = np.asarray(text[begin : min(begin + block + 1, n)])  # with the symbol after it
        change = np.flatnonzero(part[:-1] != part[1:])
        size = len(part) - (begin + block < n)
        up = np.full(size, rises, np.bool_)  # the last run goes on after the block, or ends the text
        if len(change):
            run = np.searchsorted(change, np.arange(min(size, int(change[-1]) + 1)))
            up[: len(run)] = (part[change] < part[change + 1])[run]
        if size and begin + size < n and rises and not up[-1]:
            found.append(np.array([begin + size], np.int64))
        found.append(begin + 1 + np.flatnonzero(up[1:] & ~up[:-1]))
        rises = bool(up[0])
    return np.concatenate(found[::-1]) if found else np.empty(0, np.int64)


def _run_length(text, at: int, most: int) -> int:
    """How many equal symbols stand from a place on, ``most`` at most."""
    import numpy as np

    other = np.flatnonzero(np.asarray(text[at : at + most]) != text[at])
    return int(other[0]) if len(other) else min(most, len(text) - at)


def _packed(text, begin, end, ends_text):
    """The symbols from begin in one number that sorts like them: beyond end a filler, greater than all symbols, or less where the text ends."""
    import numpy as np

    bits, count = (9, 7) if text.dtype == np.uint8 else (33, 1)
    value = np.zeros(len(begin), np.uint64)
    filler = np.where(ends_text, 0, (1 << bits) - 1).astype(np.uint64)
    top = len(text) - 1
    for i in range(count):
        at = begin + i
        symbol = text[np.minimum(at, top)].astype(np.uint64) + np.uint64(1)
        value = (value << np.uint64(bits)) | np.where(at < end, symbol, filler)
    return value, count


def _names(text, seeds):
    """(order of the seeds by the substring up to the next seed, a name for each seed in text order, number of names)."""
    import numpy as np

    m = len(seeds)
    end = np.append(seeds[1:] + 1, len(text))
    final = np.zeros(m, np.bool_)
    final[-1] = True
    word, step = _packed(text, seeds, end, final)
    order = np.argsort(word, kind="stable")
    word = word[order]
    fresh = np.concatenate(([True], word[1:] != word[:-1]))
    done = step
    while True:
        group = np.cumsum(fresh) - 1
        active = (np.bincount(group)[group] > 1) & ((end - seeds)[order] >= done)
        if not active.any():
            break
        some, g = order[active], group[active]
        word, _ = _packed(text, seeds[some] + done, end[some], final[some])
        by = np.lexsort((word, g))
        order[active] = some[by]
        word, g = word[by], g[by]
        fresh[active] = np.concatenate(([True], (word[1:] != word[:-1]) | (g[1:] != g[:-1])))
        done += step
    group = np.cumsum(fresh) - 1
    name = np.empty(m, np.int64)
    name[order] = group
    return order, name, int(group[-1]) + 1


def _in_memory(name, cap: int):
    """(order, common prefixes) of a short string's suffixes by doubling, up to cap symbols."""
    import numpy as np

    m = len(name)
    levels, rank, h = [name], name, 1
    order = np.argsort(rank, kind="stable")
    while h < cap and rank[order[-1]] < m - 1:
        key = rank * np.int64(m + 1)
        key[: m - h] += rank[h:] + 1 if h < m else 0
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        h *= 2
        levels.append(rank)
        if h >= m:
            break
    common = np.zeros(m, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        h = 1 << level
        inside = np.maximum(a, b) < m
        x, y = np.where(inside, a, 0), np.where(inside, b, 0)
        same = inside & (levels[level][x] == levels[level][y])
        common[1:] += h * same
        a, b = a + h * same, b + h * same
    return order, np.minimum(common, np.iinfo(np.int64).max)


def _between(values, starts, ends):
    """The least value in each [start, end)."""
    import numpy as np

    if not len(starts):
        return values[:0]
    pairs = np.empty(2 * len(starts), np.int64)
    pairs[::2], pairs[1::2] = starts, ends
    return np.minimum.reduceat(np.append(values, values.dtype.type(0)), pairs)[::2]


class SuffixSorter:
    """Sorts the suffixes of an array of symbols (8-bit, or whole numbers from 0 in 64 bits)."""

    def __init__(self, cap: int, folder: str | None = None, memory: int = 2 << 20, base: int = 8 << 20):
        """memory: bytes of the queue; base: how many names are sorted in memory, a longer string of names by induction again."""
        self.cap, self.folder, self.memory, self.base = cap, folder, memory, base
        self.spilled = 0

    def descending(self, text) -> Iterator[tuple]:
        """(suffixes, common prefix of each with the one before it) of every first symbol, greatest first, in descending order."""
        import numpy as np

        if not len(text):
            return
        seeds = _seeds(text)
        order, common = self._sorted_seeds(text, seeds)
        ranked = seeds[order]
        with tempfile.TemporaryDirectory(dir=self.folder) as folder:
            yield from self._induced(text, ranked, common, folder)

    def ascending(self, text):
        """(order, common prefixes) of all suffixes."""
        import numpy as np

        parts = list(self.descending(text))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order = np.concatenate([p for p, _ in parts])[::-1]
        common = np.concatenate([c for _, c in parts]).astype(np.int64)
        return order, np.concatenate(([0], common[:0:-1]))

    def _sorted_seeds(self, text, seeds):
        import numpy as np

        if len(seeds) < 2:
            return np.zeros(len(seeds), np.int64), np.zeros(len(seeds), np.int16)
        order, name, count = _names(text, seeds)
        if count < len(seeds):
            order, same = _in_memory(name, self.cap) if len(name) <= self.base else self.ascending(name)
        else:
            same = np.zeros(len(seeds), np.int64)
        # Names in common to symbols in common: up to the first different name, and into it.
        m, places = len(seeds), np.append(seeds, len(text))
        common = np.zeros(m, np.int64)
        a, b = order[1:] + same[1:], order[:-1] + same[1:]
        base = places[np.minimum(a, m)] - seeds[order[1:]]
        x, y = places[np.minimum(a, m)], places[np.minimum(b, m)]
        extra = np.zeros(m - 1, np.int64)
        live = np.flatnonzero((base < self.cap) & (np.maximum(x, y) < len(text)))
        while len(live):
            live = live[text[x[live] + extra[live]] == text[y[live] + extra[live]]]
            extra[live] += 1
            live = live[(base[live] + extra[live] < self.cap) & (np.maximum(x[live], y[live]) + extra[live] < len(text))]
        common[1:] = base + extra
        return order, np.minimum(common, self.cap).astype(np.int16)

    def _push(self, queue: SpillQueue, text, suffixes, common, wanted) -> None:
        """Puts the suffix left of each wanted one in the queue, with the value it shares with the one put before it for the same symbol."""
        import numpy as np

        at = np.flatnonzero(wanted)
        if not len(at):
            return
        left = suffixes[at] - 1
        symbol = text[left]
        by = np.argsort(symbol, kind="stable")
        at, left, symbol = at[by], left[by], symbol[by]
        fresh = np.concatenate(([True], symbol[1:] != symbol[:-1]))
        value = np.ones(len(at), np.int64)
        later = np.flatnonzero(~fresh)
        value[later] = 1 + _between(common, at[later - 1] + 1, at[later] + 1).astype(np.int64)
        value = np.minimum(value, self.cap).astype(np.int16)
        starts = np.flatnonzero(fresh)
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
            queue.put(int(symbol[i]), left[i:j], value[i:j])

    def _rounds(self, text, symbol, suffixes, common):
        """A bucket's suffixes with those that they induce in the same bucket: one more of the symbol each round. Also the number of rounds."""
        import numpy as np

        parts, shared, count = [suffixes], [common], 1
        while len(suffixes):
            at = np.flatnonzero((suffixes > 0) & (text[suffixes - 1] == symbol))
            if not len(at):
                break
            value = np.full(len(at), min(count, self.cap), np.int64)
            value[1:] = np.minimum(1 + _between(common, at[:-1] + 1, at[1:] + 1).astype(np.int64), self.cap)
            suffixes, common, count = suffixes[at] - 1, value.astype(np.int16), count + 1
            parts.append(suffixes)
            shared.append(common)
        return np.concatenate(parts), np.concatenate(shared), count

    def _induced(self, text, seeds, seed_common, folder: str) -> Iterator[tuple]:
        import numpy as np

        symbols = np.unique(text)
        cut = np.searchsorted(text[seeds], symbols).tolist() + [len(seeds)]
        queue, falling = SpillQueue(folder, self.memory), SpillQueue(folder, self.memory)
        rounds: dict[int, int] = {}
        n = len(text)
        queue.put(int(text[n - 1]), np.array([n - 1]), np.zeros(1, np.int16))
        for k, c in enumerate(symbols.tolist()):
            suffixes, common, count = self._rounds(text, c, *queue.take(c))
            if len(suffixes):
                rounds[c] = count
                falling.put(c, suffixes, common)
            own, shared = seeds[cut[k] : cut[k + 1]], seed_common[cut[k] : cut[k + 1]].copy()
            if len(own):
                shared[0] = min(count, _run_length(text, int(own[0]), self.cap)) if len(suffixes) else 0
            suffixes, common = np.concatenate((suffixes, own)), np.concatenate((common, shared))
            left = suffixes - 1
            self._push(queue, text, suffixes, common, (left >= 0) & (text[left] > c))
        queue.close()
        queue = SpillQueue(folder, self.memory)
        for c in symbols[::-1].tolist():
            suffixes, common, count = self._rounds(text, c, *queue.take(c))
            fall, shared = falling.take(c)
            if len(fall):
                back = np.concatenate(([0], shared[:0:-1])).astype(np.int16)
                back[0] = min(count, rounds[c], self.cap) if len(suffixes) else 0
                suffixes, common = np.concatenate((suffixes, fall[::-1])), np.concatenate((common, back))
            left = suffixes - 1
            self._push(queue, text, suffixes, common, (left >= 0) & (text[left] < c))
            yield suffixes, common
        queue.close()
        falling.close()
        self.spilled += queue.spills + falling.spills
