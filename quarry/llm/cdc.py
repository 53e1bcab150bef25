"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes: each byte shifts the hash by one and adds the byte's own random number, so the 16
bits kept depend on the last 16 bytes. A chunk ends where the upper ones are zero, wherever the text starts: after an
insertion the cuts fall at the same bytes again. Chunks are compared by a 64-bit digest.

A chunk's first place in the order of the input stays. Single short chunks may be alike by idiom or by chance, so a run
of neighbouring chunks that all stand earlier in the input is removed only where it has at least ``min_run`` bytes, is the
whole text, or may be the inside of a repeated passage of more than ``WORDS`` words. Such a passage ends in the chunk after
its run and begins in the chunk before it, or less than ``WINDOW`` bytes before that chunk, where cuts still depend on the
bytes before the passage: these count with the run. So every such passage is found that holds a whole chunk in common.

Defined results: a null text is empty; a null doc_id is carried; of repeated rows the first in the input keeps its text;
an empty table gives no rows; other columns are ignored. The input must be a stored table, as it is read twice and its
rows are numbered in reading order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import postings
from quarry.llm.common import arrow_limits, narrow

#: The upper bits that must be zero at a cut: chunks have 2**BITS bytes on average.
BITS = 4
#: A cut depends on as many bytes before it.
WINDOW = 16
MIN_RUN, WORDS = 400, 50


def gear_table():
    """A random number for each byte, from a fixed seed."""
    import numpy as np

    return np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 16, 256, np.uint16)


def cuts(data: bytes, table, bits: int = BITS):
    """Where chunks end, the text's end included."""
    import numpy as np

    if not data:
        return np.empty(0, np.int64)
    total = table[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:  # the hash over twice as many bytes: the later half's, and the earlier half's shifted by its length
        wider = total.copy()
        wider[span:] += total[:-span] << np.uint16(span)
        total, span = wider, 2 * span
    found = np.flatnonzero(total >> np.uint16(16 - bits) == 0) + 1
    return found if len(found) and found[-1] == len(data) else np.append(found, len(data))


class Chunker:
    """A text's chunk digests, for ``postings.shared``."""

    def __init__(self, bits: int = BITS):
        self.bits, self.table = bits, gear_table()

    def __call__(self, text: str | None):
        import numpy as np
        from xxhash import xxh3_64_intdigest as digest

        data = (text or "").encode()
        ends = cuts(data, self.table, self.bits).tolist()
        found = np.array([digest(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)], np.uint64)
        return found, np.zeros(len(found), np.bool_)


def removed_runs(data: bytes, ends, places: bytes | None, min_run: int):
    """(repeated bytes, [start, end) of the removed runs) for a text, its chunk ends and the places of its shared chunks."""
    import numpy as np

    if not places:
        return 0, []
    place = np.frombuffer(places, np.uint32)
    shared, first = np.zeros(len(ends), np.bool_), np.zeros(len(ends), np.bool_)
    at = place & np.uint32((1 << 31) - 1)
    shared[at] = True
    first[at] = place >> np.uint32(31) == 1
    begins = np.concatenate(([0], ends[:-1]))

    def runs(flags) -> list[tuple[int, int]]:
        """[start, end) bytes of neighbouring chunks with the flag, where they are long enough, all, or a passage."""
        edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))).reshape(-1, 2)
        found = [(int(begins[a]), int(ends[b - 1]), a, b) for a, b in edge.tolist()]
        return [(start, end) for start, end, a, b in found if end - start >= min_run or end - start == len(data) or passage(a, b)]

    def passage(a: int, b: int) -> bool:
        """Whether the chunks, with what may belong to them before and after, have more than ``WORDS`` words."""
        low, high = max(0, int(begins[max(0, a - 1)]) - WINDOW + 1), int(ends[min(b, len(ends) - 1)])
        return high - low > 2 * WORDS and len(data[low:high].split()) > WORDS

    return sum(b - a for a, b in runs(shared)), runs(shared & ~first)


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def deduplicate(docs: DataFrame, bits: int = BITS, min_run: int = MIN_RUN, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_repeated (bytes in runs of repeated chunks, first ones included), n_removed, n_spans and kept_sha256; with ``texts`` also the kept bytes."""
    arrow_limits(docs.sparkSession)
    rows = narrow(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = postings.shared(rows.select("row", "text"), lambda: Chunker(bits), total >> bits)
    both = rows.join(places, "row", "left").select("doc_id", "text", "places")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear_table()
        for batch in batches:
            found = []
            for doc_id, text, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = (text or "").encode()
                ends = cuts(data, table, bits)
                repeated, runs = removed_runs(data, ends, at, min_run)
                kept = without(data, runs)
                found.append((doc_id, len(data), len(ends), repeated, len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            if found:
                kinds = (*[pa.int64()] * 6, pa.string(), *([pa.binary()] if texts else []))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    return both.mapInArrow(told, "doc_id long, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
