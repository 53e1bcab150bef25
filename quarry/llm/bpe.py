"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece one token is stored: the last token of that prefix's own encoding. It is unique: a token
that ends at the prefix's end is the last one exactly if it may follow the last token of the prefix before it, and two
tokens may be neighbours exactly if encoding their joined bytes gives the two back. So the encoding of a piece is read
off backwards, an append only adds entries, and an edit re-computes entries from the edit on, until they agree again
with the old ones as far back as the longest token reaches.

Defined results: a null text is empty and has no tokens; a null doc_id is carried; repeated rows give repeated results;
an empty table gives no rows; other columns are ignored. The text is taken whole; no text is a special token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import arrow_limits, narrow


class Vocabulary:
    """Ranks of byte strings, with which tokens may be neighbours."""

    REMEMBERED = 1_000_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.joins: dict[int, bool] = {}
        self.span = len(self.bytes)
        #: Tokens that their own bytes encode to; others occur only as whole pieces.
        self.own: dict[bytes, bool] = {}
        self.longest = max(map(len, ranks))
        #: What tokens end with: a token's rank, or -1 for what is no token itself. A byte string that isn't here ends no token.
        self.endings = {token[i:]: -1 for token in ranks for i in range(len(token))} | ranks

    def merge(self, piece: bytes) -> list[int]:
        """Encoding by its definition: the lowest-ranked neighbours join first. Used on joined tokens only, which are short."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, self.span), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == self.span:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def usable(self, token: bytes) -> bool:
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = self.merge(token) == [self.ranks[token]]
        return known

    def neighbours(self, left: int, right: int) -> bool:
        """Asked of a pair that isn't in ``joins`` yet, which remembers a bounded number of them."""
        if len(self.joins) >= self.REMEMBERED:
            self.joins.clear()
        known = self.joins[left * self.span + right] = self.merge(self.bytes[left] + self.bytes[right]) == [left, right]
        return known


class Prefixes:
    """The encoding of a growing or edited byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = []  # the last token of each prefix's encoding
        self.append(data)

    def _extend(self, stop: int) -> None:
        """The entries up to a prefix's end. Being neighbours implies that both tokens are their own encoding; a prefix that is one token is asked."""
        v, data, last = self.vocabulary, self.data, self.last
        ending, joined, span = v.endings.get, v.joins.get, v.span
        for end in range(len(last) + 1, stop + 1):
            fitting = []
            for start in range(end - 1, -1, -1):
                rank = ending(data[start:end])
                if rank is None:
                    break
                if rank >= 0:
                    fitting.append((start, rank))
            for start, rank in reversed(fitting):
                if not start:
                    if v.usable(data[:end]):
                        break
                    continue
                left = last[start - 1]
                fits = joined(left * span + rank)
                if fits or fits is None and v.neighbours(left, rank):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(rank)

    def append(self, data: bytes) -> None:
        self.data += data
        self._extend(len(self.data))

    def become(self, data: bytes) -> None:
        """Another byte string: the entries of the prefix that both share stay."""
        shared = len(commonprefix((self.data, data)))
        self.data = data
        del self.last[shared:]
        self._extend(len(data))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Replaces bytes; how many entries were computed anew. Entries after the edit hold again once a whole longest token's reach of them agrees."""
        old, shift = self.last[stop:], len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        del self.last[start:]
        alike = 0
        for end in range(start + 1, len(self.data) + 1):
            self._extend(end)
            entry = self.last[-1]
            before = end - 1 - shift - stop
            alike = alike + 1 if before >= 0 and old[before] == entry else 0
            if alike >= self.vocabulary.longest:
                self.last += old[before + 1 :]
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(token := self.last[end - 1])
            end -= len(self.vocabulary.bytes[token])
        return found[::-1]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Whole texts to token ids and back. Pieces seen before are remembered, up to a fixed number."""

    REMEMBERED = 600_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Encodes new pieces in their order, so that each starts from the prefix that it shares with the one before."""
        prefixes = Prefixes(self.vocabulary)
        for data, piece in sorted((p.encode(), p) for p in pieces):
            whole = self.vocabulary.ranks.get(data)
            if whole is not None:
                ids = (whole,)
            else:
                prefixes.become(data)
                ids = tuple(prefixes.tokens())
            self.known[piece] = ids, " ".join(map(str, ids))

    def told(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """For each text its ids, and their decimal forms joined by spaces."""
        split = [self.pieces(t) for t in texts]
        fresh = set().union(*split)
        if len(self.known) + len(fresh) > self.REMEMBERED:
            self.known.clear()
        self._learn(fresh.difference(self.known))
        get = self.known.__getitem__
        for pieces in split:
            found = list(map(get, pieces))
            yield list(chain.from_iterable([f[0] for f in found])), " ".join([f[1] for f in found])

    def encode(self, text: str) -> list[int]:
        return next(self.told([text]))[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for a worker's whole life."""
    return Codec(load_ranks(path), pattern)


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of every text."""
    arrow_limits(docs.sparkSession)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [i for i, _ in own.told([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return narrow(docs, "doc_id", "text").mapInArrow(told, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of every list of ids."""
    arrow_limits(encoded.sparkSession)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(i or []) for i in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return narrow(encoded, "doc_id", "ids").mapInArrow(told, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to, in one pass: the ids never leave the worker."""
    arrow_limits(docs.sparkSession)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, digests, decoded = [], [], []
            for ids, decimal in own.told([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids))
                digests.append(hashlib.sha256(decimal.encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow(docs, "doc_id", "text").mapInArrow(told, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
