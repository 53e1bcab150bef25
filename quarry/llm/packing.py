"""Cost-balanced packing of tokenised documents into sequences.

A piece of n tokens costs n + n * n / capacity: a linear part and the quadratic part of its own attention. Each block of
documents (consecutive rows of a partition, up to a number of tokens) is packed by itself, so nothing is shuffled and a
task holds one block. Whole sequences are cut off documents longer than one. What is left goes, longest first, to the
open sequence of the lowest cost with room for all of it; only where none has, it is cut, and the cheapest takes what it can. The open
sequences hold exactly the block's tokens: full ones, and for the remainder sequences whose lengths are powers of two,
which need no padding.

Defined results: a null text is empty, so its document is the end token alone; a null doc_id is carried; repeated rows
are packed like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import arrow_limits, narrow, uncollected

CAPACITY = 4096
END = 2
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Piece:
    doc: int
    start: int
    length: int
    sequence: int
    offset: int


def cost(length: int, capacity: int = CAPACITY) -> float:
    return length + length * length / capacity


class Open:
    """Open sequences by their room: a heap of (cost, sequence) for each room, under a tree of the least."""

    NONE = (math.inf, -1)

    def __init__(self, capacity: int):
        self.size = 1 << (capacity - 1).bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.least = [self.NONE] * (2 * self.size)

    def put(self, room: int, entry: tuple[float, int]) -> None:
        heapq.heappush(self.heaps[room - 1], entry)
        node, least = self.size + room - 1, self.least
        while node and entry < least[node]:
            least[node] = entry
            node >>= 1

    def take(self, room: int) -> None:
        """Drops the cheapest sequence of exactly this room."""
        heap, node, least = self.heaps[room - 1], self.size + room - 1, self.least
        gone = heapq.heappop(heap)
        least[node] = heap[0] if heap else self.NONE
        node >>= 1
        while node and least[node] == gone:
            a, b = least[2 * node], least[2 * node + 1]
            least[node] = a if a < b else b
            node >>= 1

    def cheapest(self, room: int) -> tuple[float, int] | None:
        """The cheapest sequence with this room or more."""
        node, least = self.size + room - 1, self.least
        found = least[node]
        while node > 1:
            if not node & 1 and least[node + 1] < found:
                found = least[node + 1]
            node >>= 1
        return found if found[1] >= 0 else None


def plan(lengths: list[int], capacity: int = CAPACITY) -> list[Piece]:
    """Pieces of documents of the given lengths."""
    pieces: list[Piece] = []
    sequences = 0
    short: list[tuple[int, int, int]] = []  # length, document, start
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            pieces.append(Piece(doc, start, capacity, sequences, 0))
            sequences += 1
            start += capacity
        if n > start:
            short.append((n - start, doc, start))
    short.sort(key=lambda s: (-s[0], s[1]))
    total = sum(s[0] for s in short)
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    filled = [0] * len(rooms)
    full = cost(capacity, capacity)
    opened = Open(capacity)
    for i, room in enumerate(rooms):
        opened.put(room, (full * (1 - room / capacity), i))  # a smaller sequence counts as filled by what it lacks
    for n, doc, start in short:
        while n:
            spent, i = opened.cheapest(n) or opened.cheapest(1)
            room = rooms[i] - filled[i]
            opened.take(room)
            part = min(n, room)
            pieces.append(Piece(doc, start, part, sequences + i, filled[i]))
            filled[i] += part
            start, n = start + part, n - part
            if part < room:
                opened.put(room - part, (spent + cost(part, capacity), i))
    return pieces


class WordTokens:
    """Token ids of whole texts, as little-endian unsigned 16-bit bytes.

    The tokenizer never joins across ASCII white space, nor do its added tokens hold any, so ids are remembered by the word between such spaces; new words
    are encoded together, and told apart by their offsets. Two generations of a fixed number are remembered: a full one
    becomes the older, from which words still in use move up.
    """

    REMEMBERED = 700_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marker = os.path.commonprefix(self.special)  # one look for most words
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def _move_up(self, words: set[bytes]) -> None:
        if older := self.older:
            self.known.update({w: older[w] for w in words if w in older})

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        """A word in lower case, as the tokenizer takes it, and apart from it the marks at its end (no apostrophes) where an ASCII letter or digit is before them: they are a piece of their own. A word with an added token in it stays as it is, as only the token's own case counts."""
        low = word.lower()
        if self.marker in low and any(t in low for t in self.special):
            return word, b""
        core = low.rstrip(MARKS)
        return (core, low[len(core) :]) if core[-1:].isalnum() else (low, b"")

    def _learn(self, words: list[bytes]) -> None:
        import numpy as np

        for first in range(0, len(words), 200):  # short runs stay in the processor's caches
            some = words[first : first + 200]
            texts = [w.decode() for w in some]
            found = self.tokenizer.encode("\n".join(texts), add_special_tokens=False)
            starts = np.array([a for a, _ in found.offsets], np.int64)
            cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
            data, at = np.array(found.ids, "<u2").tobytes(), 0
            for word, cut in zip(some, cuts, strict=True):
                self.known[word] = data[2 * at : 2 * cut]
                at = cut

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """The ids of each text (in UTF-8) without the end token."""
        split = [(t or b"").split() for t in texts]
        words = set().union(*split)
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > self.REMEMBERED:
            self.known, self.older = {b"": b""}, self.known
            fresh = words
        self._move_up(fresh)
        parts = [(w, *self._parts(w)) for w in fresh.difference(self.known)]
        new = {p for _, *both in parts for p in both}.difference(self.known)
        self._move_up(new)
        if new := new.difference(self.known):
            self._learn(sorted(new))
        known = self.known
        known.update({w: known[core] + known[tail] for w, core, tail in parts})
        get = known.__getitem__
        for words in split:
            yield b"".join(map(get, words))


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pack(docs: DataFrame, path: str, block_tokens: int = 8 << 20, ids: bool = False) -> DataFrame:
    """A row for each piece; with ``ids`` also the piece's token ids. sequence_id holds the partition's number in its upper 32 bits."""
    arrow_limits(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        own = word_tokens(path)
        first = TaskContext.get().partitionId() << 32
        end = END.to_bytes(2, "little")

        def packed(names: list, data: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal first
            pieces = plan([len(d) // 2 for d in data])
            for at in range(0, len(pieces), 5000):
                some = pieces[at : at + 5000]
                parts = [np.frombuffer(data[p.doc], "<u2", p.length, 2 * p.start).astype("<u4") for p in some]
                columns = {
                    "doc_id": pa.array([names[p.doc] for p in some], pa.int64()),
                    "start": pa.array([p.start for p in some], pa.int64()),
                    "length": pa.array([p.length for p in some], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(part.tobytes()) for part in parts], pa.int64()),
                    "doc_tokens": pa.array([len(data[p.doc]) // 2 for p in some], pa.int64()),
                    "sequence_id": pa.array([first + p.sequence for p in some], pa.int64()),
                    "offset": pa.array([p.offset for p in some], pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.array([part.astype(np.int32) for part in parts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            first += max((p.sequence for p in pieces), default=-1) + 1

        names, data, held = [], [], 0
        with uncollected():
            for batch in batches:
                for name, found in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                    names.append(name)
                    data.append(found + end)
                    held += len(found) // 2 + 1
                    if held >= block_tokens:
                        yield from packed(names, data)
                        names, data, held = [], [], 0
            if data:
                yield from packed(names, data)

    return narrow(docs, "doc_id", "text").mapInArrow(told, schema)
