"""Exact removal of repeated substrings by suffix arrays.

Every byte covered by a ``length``-byte string that also starts anywhere else, in the same text or another, is removed.

Sharding keeps shards whole: a window of ``length`` bytes is named by the least hash of the 200-byte strings in it, so
equal windows have equal names wherever they stand. Neighbouring windows of one name form a segment. Names are counted
over all texts in blocks (``postings.shared``); a name that occurs once has no repeats. Equal segments are counted, not
copied: with two or more, all their windows repeat (by a 128-bit digest). Names with several different segments go to
shards, one copy of each segment, and a shard's segments are joined into one string whose suffixes are sorted by external
induction (``suffix_sort``): windows repeat where neighbours in that order share ``length`` bytes. The string is a file of
the task's own temporary folder, and so is what the queue can't hold; the folder goes with the task. In memory are the
seeds of a shard with their names, some 20 bytes for each byte, and a bucket. Long runs of one symbol or of a short period
are cut to a period and their ends before (``Windows.periodic``), and a text is named in slabs, so that memory doesn't grow with either. A shard has ``SHARD_BYTES`` on average; a name
that more bytes of different segments share is split by the bytes around its anchor (``_marks``).

Defined results: a null text is empty; a null doc_id is carried; repeated rows are separate texts, so all their bytes go
if they are long enough; an empty table gives no rows; other columns are ignored. The input must be a stored table, as
it is read several times and its rows are numbered in reading order.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import postings
from quarry.llm.cdc import without
from quarry.llm.common import arrow_limits, lean_memory, narrow, spool

LENGTH, ANCHOR = 400, 200
#: Bytes of a shard on average; a name with more bytes of different segments is split.
SHARD_BYTES = 3 << 19
#: Windows of a text that are named at a time, and bytes of pieces that a task holds.
SLAB, HELD = 1 << 22, 1 << 23
#: Digests that a task remembers, so as not to send equal segments' bytes again.
REMEMBERED = 1_000_000
_BASE = 0x9E3779B97F4A7C15


class Windows:
    """A text's segments: the windows (by where they start) of one name each."""

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR):
        import numpy as np

        self.length, self.anchor = length, anchor
        self.numbers = np.random.Generator(np.random.PCG64(2)).integers(0, 1 << 64, 256, np.uint64)
        self.powers = self.inverses = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        import numpy as np

        if len(self.powers) < n:
            size = max(n, 1 << 17)
            self.powers = np.cumprod(np.full(size, _BASE, np.uint64))
            self.inverses = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))

    def anchors(self, data: bytes):
        """A hash of the ``anchor`` bytes from every place, by differences of one running sum."""
        import numpy as np

        n = len(data)
        self._grow(n + 1)
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(self.numbers[np.frombuffer(data, np.uint8)] * self.powers[:n], out=running[1:])
        x = (running[self.anchor :] - running[: -self.anchor]) * self.inverses[: n - self.anchor + 1]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def segments(self, data: bytes):
        """(names, starts, ends, whether a name's anchor stands more than once in the segment), of ``SLAB`` windows at a time."""
        import numpy as np

        parts = [(at, self._segments(data[at : at + SLAB + self.length - 1])) for at in range(0, max(1, len(data) - self.length + 1), SLAB)]
        return tuple(np.concatenate([part[k] + (at if k in (1, 2) else part[k].dtype.type(0)) if k < 3 else part[k] for at, part in parts]) for k in range(4))

    def periodic(self, own: bytes, name: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Of a segment: the windows (from, to) to compare, and those that repeat for sure.

        Where a name's anchors follow at equal distances of no more than their length, the bytes from the first to the last repeat with
        that period. In such a run every window stands a period further on or back, and those after the first period's
        are copies of it; so of a long run only the first period's windows, and those that reach beyond it, are compared.
        """
        import numpy as np

        count = len(own) - self.length + 1
        at = np.flatnonzero(self.anchors(own) == np.uint64(name))
        gap = np.diff(at)
        first = np.flatnonzero(np.concatenate(([True], gap[1:] != gap[:-1]))) if len(gap) else np.empty(0, np.int64)
        last = np.append(first[1:], len(gap))
        long = (at[last] - at[first] >= 3 * self.length) & (gap[first] <= self.anchor) if len(gap) else first.astype(np.bool_)
        kept, sure, begin = [], [], 0
        for i, j in zip(first[long].tolist(), last[long].tolist(), strict=True):
            a, period, end = int(at[i]), int(gap[i]), int(at[j]) + self.anchor - self.length + 1
            if begin < a + period:
                kept.append((begin, a + period))
            sure.append((a, end))
            begin = max(begin, end)
        return [*kept, *([(begin, count)] if begin < count else [])], sure

    def _segments(self, data: bytes):
        import numpy as np

        if len(data) < self.length:
            none = np.empty(0, np.int64)
            return none.astype(np.uint64), none, none, none.astype(np.bool_)
        hashed, width = self.anchors(data), self.length - self.anchor + 1
        n = len(hashed)
        padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = hashed
        padded = padded.reshape(-1, width)
        # The least of any window lies in one block's end and the next one's begin.
        begin = np.minimum.accumulate(padded, 1).ravel()
        end = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(end[: n - width + 1], begin[width - 1 : n])
        starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        ends = np.append(starts[1:], len(least))
        names = least[starts]
        # A name's anchors lie within its windows; where they stand more than once, windows may repeat in the segment.
        order = np.argsort(hashed, kind="stable")
        again = hashed[order]
        twice = np.unique(again[1:][again[1:] == again[:-1]])
        doubled = np.isin(names, twice)
        for k in np.flatnonzero(doubled).tolist():
            doubled[k] = np.count_nonzero(hashed[starts[k] : ends[k] + width - 1] == names[k]) > 1
        return names, starts, ends, doubled

    def __call__(self, text: str | None):
        """Names as tokens: least hashes are small numbers, so they are spread over all again."""
        import numpy as np

        names, _, _, doubled = self.segments((text or "").encode())
        return (names ^ (names >> np.uint64(31))) * np.uint64(_BASE), doubled


def _signed(name: int) -> int:
    return name - (1 << 64) if name >> 63 else name


def _segments(rows: DataFrame, places: DataFrame, length: int, anchor: int) -> DataFrame:
    """The segments whose name is shared: name, digest (hi, lo), doubled, row, start, end and bytes, stored. Of equal segments only a task's first holds its bytes.

    Of a long periodic run only what ``Windows.periodic`` keeps is a segment; a row without a name tells windows that repeat for sure.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_128_intdigest as digest

        windows, seen = Windows(length, anchor), set()
        for batch in batches:
            for row, text, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = (text or "").encode()
                names, starts, ends, doubled = windows.segments(data)
                found = []
                for k in (np.frombuffer(at, np.uint32) & np.uint32((1 << 31) - 1)).tolist():
                    a, b = int(starts[k]), int(ends[k])
                    kept, sure = [(0, b - a)], []
                    if doubled[k] and b - a > 3 * length:
                        kept, sure = windows.periodic(data[a : b + length - 1], int(names[k]))
                    found += [(None, None, None, False, row, a + u, a + v, None) for u, v in sure]
                    for u, v in kept:
                        own = data[a + u : a + v + length - 1]
                        d = digest(own)
                        found.append((_signed(int(names[k])), _signed(d >> 64), _signed(d & (1 << 64) - 1), bool(doubled[k]), row, a + u, a + v, None if d in seen else own))
                        seen.add(d)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["name", "hi", "lo", "doubled", "row", "start", "end", "bytes"])

    return spool(rows.join(places, "row").select("row", "text", "places").mapInArrow(cut, "name long, hi long, lo long, doubled boolean, row long, start int, end int, bytes binary"), "segments", compression="zstd")


_KEY = "name long, hi long, lo long"
_MARKS = f"{_KEY}, windows binary"


def _sorted_marks(segments: DataFrame, total: int, length: int) -> DataFrame:
    """name, hi, lo and the windows (int pairs: from, to) of a segment that repeat, by sorting the suffixes of each shard. A segment comes once."""
    shards = max(1, ceil(total / SHARD_BYTES))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from quarry.llm.suffix_sort import SuffixSorter

        lean_memory()
        keys, ends, size = {}, [], 0
        with tempfile.TemporaryDirectory() as folder:  # the task's own, as its queue's
            path = os.path.join(folder, "shard")
            with open(path, "wb") as f:
                for batch in batches:
                    for name, hi, lo, own in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                        keys[name, hi, lo] = size
                        f.write(own)
                        f.write(b"\xff")  # no byte of UTF-8
                        size += len(own) + 1
                        ends.append(size)
            if not size:
                return
            text = np.memmap(path, np.uint8, "r")
            marked = np.zeros(size, np.bool_)
            for suffixes, common in SuffixSorter(length, folder).descending(text):
                hit = np.flatnonzero(common >= length)
                marked[suffixes[hit]] = True
                marked[suffixes[hit - 1]] = True
            del text
        # The last length - 1 starts of a segment are no windows of it: what follows them is another segment.
        for (name, hi, lo), a, b in zip(keys, keys.values(), ends, strict=True):
            own = marked[a : b - length]
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([hi]), pa.array([lo]), pa.array([edge.tobytes()], pa.binary())], names=["name", "hi", "lo", "windows"])

    return segments.select("name", "hi", "lo", "bytes").repartition(shards, "name").mapInArrow(sort, _MARKS)


def _pair(a: Column, b: Column) -> Column:
    """Two numbers as little-endian 32 bits."""
    return F.concat(*(F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(c, s).bitwiseAND(255)), 2, "0") for s in (0, 8, 16, 24)))) for c in (a, b)))


def _halves(segments: DataFrame, length: int, anchor: int) -> DataFrame:
    """Each segment cut in pieces by where a window's first anchor stands in it: in the first or the second half of what was possible.

    A piece is named by the bytes that all windows of its half share, so equal windows still have equal names.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_64_intdigest as short
        from xxhash import xxh3_128_intdigest as digest

        windows = Windows(length, anchor)
        fields = pa.schema([(c, pa.int64()) for c in ("name", "hi", "lo", "of_name", "of_hi", "of_lo")] + [(c, pa.int32()) for c in ("at", "starts", "place", "least", "most")] + [("bytes", pa.binary())])

        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), fields, strict=True)], schema=fields)

        for batch in batches:
            found, size = [], 0
            for name, hi, lo, own, place, least, most in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                count = len(own) - length + 1
                if place is None:  # a window belongs to the first anchor at or after its start
                    places = np.flatnonzero(windows.anchors(own) == np.uint64(name & (1 << 64) - 1)).tolist()
                    runs = [(0 if i == 0 else places[i - 1] + 1, min(p + 1, count), p, 0, length - anchor) for i, p in enumerate(places)]
                else:
                    runs = [(0, count, place, least, most)]
                for begin, end, p, low, high in runs:
                    middle = (low + high) // 2
                    for u, v in ((low, middle), (middle + 1, high)):
                        a, b = max(begin, p - v), min(end, p - u + 1)
                        if a < b:
                            piece, shared = own[a : b + length - 1], own[p - u : p - v + length]
                            d = digest(piece)
                            found.append((_signed(short(shared, seed=u * (length + 1) + v)), _signed(d >> 64), _signed(d & (1 << 64) - 1), name, hi, lo, a, b - a, p - a, u, v, piece))
                            size += len(piece)
                    if size > HELD:
                        yield made(found)
                        found, size = [], 0
            if found:
                yield made(found)

    return segments.select("name", "hi", "lo", "bytes", "place", "least", "most").mapInArrow(cut, f"{_KEY}, of_name long, of_hi long, of_lo long, at int, starts int, place int, least int, most int, bytes binary")


def _marks(segments: DataFrame, names: DataFrame, length: int, anchor: int) -> DataFrame:
    """name, hi, lo and the repeated windows of the segments (name, hi, lo, bytes, and of pieces place, least, most) of some names.

    names: name, size (bytes of its different segments) and room (0 where it can't be split). A name of more than
    ``SHARD_BYTES`` would be one large shard. Its segments are cut in halves, again and again, until the shared bytes that
    name a piece tell the pieces apart; at the end a piece is one window.
    """
    hot = (F.col("size") > SHARD_BYTES) & (F.col("room") > 0)
    total, any_hot = names.agg(F.sum(F.when(~hot, F.col("size"))), F.max(hot)).first()
    row = F.first(F.struct("bytes", "place", "least", "most")).alias("r")
    # One of equal segments, found by segment, so that a name's many copies don't meet in one task.
    each = lambda of: segments.join(names.where(of).select("name"), "name", "left_semi").groupBy("name", "hi", "lo").agg(row).select("name", "hi", "lo", "r.*")
    cold = _sorted_marks(each(~hot), total or 0, length)
    if not any_hot:
        return cold
    pieces = spool(_halves(each(hot), length, anchor), "pieces", compression="zstd")
    kinds = pieces.groupBy("name", "hi", "lo").agg(F.count("*").alias("n"), F.max("starts").alias("starts"), F.max(F.col("most") - F.col("least")).alias("room"))
    several = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.sum(F.col("starts") + length).alias("size"), F.max("room").alias("room"))
    several = spool(several.where("kinds > 1").drop("kinds"), "several")
    told = spool(kinds.where("n > 1").select("name", "hi", "lo", "n").join(_marks(pieces, several, length, anchor), ["name", "hi", "lo"], "full_outer"), "told-pieces")
    found = pieces.select("name", "hi", "lo", "of_name", "of_hi", "of_lo", "at", "starts").join(told, ["name", "hi", "lo"])
    windows = F.when(F.col("n") > 1, _pair(F.lit(0), F.col("starts"))).otherwise(F.col("windows"))
    gathered = found.groupBy("of_name", "of_hi", "of_lo").agg(F.collect_list(F.struct("at", windows.alias("windows"))).alias("found"))  # of one segment

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            whole = [b"".join((np.frombuffer(f["windows"], "<i4") + np.int32(f["at"])).astype("<i4").tobytes() for f in found) for found in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(whole, pa.binary())], names=["name", "hi", "lo", "windows"])

    return cold.unionByName(gathered.mapInArrow(moved, _MARKS))


def repeated_windows(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """row and ``windows``: a list of binaries of int pairs, the starts (from, to) of the windows that stand elsewhere too. rows: row, text."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = postings.shared(rows.select("row", "text"), lambda: Windows(length, anchor), total // 100)
    told = _segments(rows, places, length, anchor)
    stored, sure = told.where("name is not null"), told.where("name is null")
    kinds = stored.groupBy("name", "hi", "lo").agg(F.count("*").alias("n"), F.max("doubled").alias("doubled"), F.max(F.col("end") - F.col("start")).alias("starts"))
    by_name = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.max(F.col("doubled") & (F.col("n") == 1)).alias("alone"), F.sum(F.col("starts") + length).alias("size"))
    mixed = spool(by_name.where((F.col("kinds") > 1) | F.col("alone")).select("name", "size", F.lit(length - anchor).alias("room")), "mixed")
    none = F.lit(None).cast("int")
    segments = stored.where("bytes is not null").select("name", "hi", "lo", "bytes", none.alias("place"), none.alias("least"), none.alias("most"))
    marks = _marks(segments, mixed, length, anchor)
    # Stored, so that both sides of the next join are dealt out for it and Spark may split a segment with very many copies.
    told = spool(kinds.where("n > 1").select("name", "hi", "lo", "n").join(marks, ["name", "hi", "lo"], "full_outer"), "told")
    found = stored.select("name", "hi", "lo", "row", "start", "end").join(told, ["name", "hi", "lo"])
    windows = F.when(F.col("n") > 1, _pair(F.lit(0), F.col("end") - F.col("start"))).otherwise(F.col("windows"))
    each = found.select("row", "start", windows.alias("windows")).unionByName(sure.select("row", "start", _pair(F.lit(0), F.col("end") - F.col("start")).alias("windows")))
    return each.groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("found"))


def covered(found: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that repeated windows cover."""
    import numpy as np

    if not found:
        return []
    pairs = np.concatenate([np.frombuffer(f["windows"], "<i4").reshape(-1, 2).astype(np.int64) + f["start"] for f in found])
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1] + length - 1)
    first = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] > reach[:-1])))
    last = np.append(first[1:], len(pairs)) - 1
    return list(zip(pairs[first, 0].tolist(), reach[last].tolist(), strict=True))


class Passages:
    """A text's sequences of so many words, as hashes."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, text: str | None):
        import numpy as np
        from xxhash import xxh3_64_intdigest as digest

        h = np.fromiter(map(digest, (text or "").encode().split()), np.uint64)
        n = max(0, len(h) - self.words + 1)
        powers = np.cumprod(np.full(len(h) + 1, _BASE, np.uint64))
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)])))
        x = (running[self.words :] - running[: n]) * np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)) if n else np.empty(0, np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29)), np.zeros(n, np.bool_)


def passages(rows: DataFrame, found: DataFrame, length: int, words: int) -> DataFrame:
    """(row, found): the passages of more than ``words`` words that stand twice, of what repeated windows (found) cover, as struct(start, end).

    Windows of different origin may cover a long run that stands nowhere else as a whole. So the runs' sequences of words + 1
    words are counted, and only those that stand twice go. Of runs whose words aren't told apart by spaces (over 16 bytes on
    average) those of ``LENGTH`` bytes go.
    """
    kind = "row long, start long, text string, whole boolean"
    fields = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = (text or "").encode()
                for a, b in covered(spans, length):
                    n = len(data[a:b].split())
                    whole = b - a >= LENGTH and 16 * n < b - a
                    if n > words or whole:
                        while a < b and data[a] & 0xC0 == 0x80:  # whole characters
                            a += 1
                        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((row, a, data[a:b].decode(errors="ignore"), whole), fields, strict=True)], schema=fields)

    both = rows.select("row", "text").join(found, "row").select("row", "text", "found")
    runs = spool(both.mapInArrow(cut, kind).withColumn("piece", F.monotonically_increasing_id()), "runs", compression="zstd")
    total = runs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = postings.shared(runs.select("piece", "text"), lambda: Passages(words + 1), total // 6)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np

        for batch in batches:
            for row, start, text, whole, at in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                data = text.encode()
                if whole:
                    spans = [(0, len(data))]
                else:
                    edges = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
                    first = np.sort((np.frombuffer(at, np.uint32) & np.uint32((1 << 31) - 1)).astype(np.int64))
                    new = np.flatnonzero(np.concatenate(([True], first[1:] > first[:-1] + words + 1)))
                    spans = [(edges[int(first[i])][0], edges[int(first[j]) + words][1]) for i, j in zip(new, np.append(new[1:], len(first)) - 1, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(spans), pa.int64()), pa.array([start + a for a, _ in spans], pa.int64()), pa.array([start + b for _, b in spans], pa.int64())], names=["row", "start", "end"])

    told = runs.join(places.withColumnRenamed("row", "piece"), "piece", "left").where("whole or places is not null")
    spans = told.select("row", "start", "text", "whole", "places").mapInArrow(keep, "row long, start long, end long")
    return spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))  # of one text


def remove(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), length: int = LENGTH, anchor: int = ANCHOR, texts: bool = False, words: int | None = None) -> DataFrame:
    """The columns, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``texts`` also kept_text, without characters that a removal cut (null where the text is).

    With ``words`` only ``passages`` of more words go.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = narrow(docs, *dict.fromkeys((*columns, "text"))).withColumn("row", F.monotonically_increasing_id())
    found = repeated_windows(rows.select("row", "text"), length, anchor)
    if words is not None:
        found = passages(rows, found, length, words)
    both = rows.join(found, "row", "left").select("text", "found", *(F.col(c).alias(f"own_{k}") for k, c in enumerate(columns)))
    kinds = [rows.schema[c].dataType.simpleString() for c in columns]
    schema = ", ".join(f"own_{k} {t}" for k, t in enumerate(kinds)) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                runs = covered(spans, length) if words is None else sorted((f["start"], f["end"]) for f in spans or [])
                kept = without(data, runs)
                results.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), *([None if text is None else kept.decode(errors="ignore")] if texts else [])))
            if results:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if texts else []))
                made = [pa.array(c, t) for c, t in zip(zip(*results, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=[*(f"own_{k}" for k in range(len(columns))), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if texts else [])])

    made = both.mapInArrow(told, schema)
    return made.select(*(F.col(f"own_{k}").alias(c) for k, c in enumerate(columns)), *made.columns[len(columns) :])

