"""Which tokens of a row occur elsewhere: postings meet in sorted binary blocks, and answers come back by row.

Rows carry a number that a second scan gives them again. A task gathers rows into blocks; a block sends each of its
tokens once, to the task of its hash range, with whether the block itself holds it more than once. The answers are
gathered by block, so every exchange moves binary columns, and a token that any number of rows hold costs one posting
for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import lean_memory

#: Tokens in a block, and for a task that lets them meet: the least of each. Least tokens of a message from a block to a task, on average.
BLOCK_TOKENS, TASK_TOKENS, MESSAGE_TOKENS = 1_000_000, 500_000, 64
_FIELDS = (("bucket", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()), ("places", pa.binary()), ("several", pa.binary()), ("rows", pa.binary()), ("sizes", pa.binary()))
_SCHEMA = "bucket int, block long, tokens binary, places binary, several binary, rows binary, sizes binary"


def sizes(total: int, block: int, task: int) -> tuple[int, int]:
    """(tokens of a block, number of tasks) for a total of tokens.

    Messages are blocks times tasks. So that their number grows with the input and not with its square, blocks grow with the
    total's root and tasks are no more than give a block's messages ``MESSAGE_TOKENS`` on average: from some billions of
    tokens on both have 8 * sqrt(total) tokens, at 1e13 tokens 25 million.
    """
    block = max(block, isqrt(MESSAGE_TOKENS * total))
    return block, max(1, min(ceil(total / task), block // MESSAGE_TOKENS))


def _blocks(rows: Iterator[tuple[int, object, object]], buckets: int, first: int, most: int) -> Iterator[dict]:
    """rows: (row's number, tokens, whether a token alone counts as more than one). A table of each block, and its postings by bucket."""
    import numpy as np

    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    numbers: list[int] = []
    parts: list = []
    doubled: list = []
    size, block = 0, first

    def flush() -> Iterator[dict]:
        token, double = np.concatenate(parts), np.concatenate(doubled)
        order = np.argsort(token, kind="stable")
        token, double = token[order], double[order]
        fresh = np.concatenate(([True], token[1:] != token[:-1]))
        starts = np.flatnonzero(fresh)
        count = np.diff(np.append(starts, len(token)))
        # Later places of a token in this block: known to be shared, and not the first.
        yield {"bucket": block % buckets, "block": block, "places": order[~fresh].astype(np.uint32).tobytes(), "rows": np.array(numbers, np.int64).tobytes(), "sizes": np.array([len(p) for p in parts], np.uint32).tobytes()}
        several = (count > 1) | np.maximum.reduceat(double, starts)
        token, place = token[starts], order[starts].astype(np.uint32)
        cut = np.searchsorted(token, edges).tolist()
        for k, (i, j) in enumerate(zip([0, *cut], [*cut, len(token)], strict=True)):
            if i < j:
                yield {"bucket": k, "block": block, "tokens": token[i:j].tobytes(), "places": place[i:j].tobytes(), "several": several[i:j].tobytes()}

    for number, tokens, double in rows:
        if not len(tokens):
            continue
        numbers.append(number)
        parts.append(tokens)
        doubled.append(double)
        size += len(tokens)
        if size >= most:
            yield from flush()
            block += 1
            numbers, parts, doubled, size = [], [], [], 0
    if numbers:
        yield from flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a task's range the places whose token is shared; bit 31 tells the first of all."""
    import numpy as np

    lean_memory()
    tokens, places, several, blocks = [], [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["rows"] is not None:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("block", "places", "rows", "sizes")}], _ANSWER)
                continue
            tokens.append(np.frombuffer(r["tokens"], np.uint64))
            places.append(np.frombuffer(r["places"], np.uint32))
            several.append(np.frombuffer(r["several"], np.bool_))
            blocks.append(np.full(len(tokens[-1]), r["block"], np.int64))
    if not tokens:
        return
    token, place, double, block = map(np.concatenate, (tokens, places, several, blocks))
    order = np.lexsort((block, token))
    token, place, double, block = token[order], place[order], double[order], block[order]
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    count = np.diff(np.append(starts, len(token)))
    shared = (count > 1) | np.maximum.reduceat(double, starts)
    place[starts] |= np.uint32(1 << 31)
    hit = np.repeat(shared, count)
    place, block = place[hit], block[hit]
    order = np.argsort(block, kind="stable")
    place, block = place[order], block[order]
    ends = np.flatnonzero(np.concatenate((block[1:] != block[:-1], [True]))) + 1 if len(block) else []
    start = 0
    for end in ends:
        yield pa.RecordBatch.from_pylist([{"block": int(block[start]), "places": place[start:end].tobytes()}], _ANSWER)
        start = end


_ANSWER = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("rows", pa.binary()), ("sizes", pa.binary())])


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, places in the row, bit 31: first) from a task's blocks."""
    import numpy as np

    told: dict[int, list[bytes]] = {}
    tables: dict[int, tuple[bytes, bytes]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            told.setdefault(r["block"], []).append(r["places"])
            if r["rows"] is not None:
                tables[r["block"]] = r["rows"], r["sizes"]
    for block, (numbers, sizes) in tables.items():
        place = np.frombuffer(b"".join(told.pop(block)), np.uint32)
        order = np.argsort(place & np.uint32((1 << 31) - 1), kind="stable")
        place = place[order]
        at = (place & np.uint32((1 << 31) - 1)).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64)))
        cut = np.searchsorted(at, begin)
        rows = np.frombuffer(numbers, np.int64)
        own = (place.astype(np.int64) - np.repeat(begin[:-1], np.diff(cut))).astype(np.uint32)  # bit 31 stays, as a row's begin is below it
        some = np.flatnonzero(np.diff(cut))
        for i in range(0, len(some), 2000):
            s = some[i : i + 2000].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows[s]), pa.array([own[cut[k] : cut[k + 1]].tobytes() for k in s], pa.binary())], names=["row", "places"])


def shared(rows: DataFrame, tokens: Callable, total: int) -> DataFrame:
    """(row, places): for each row with shared tokens their places among its tokens as 32-bit numbers; bit 31 is set at a token's first place of all.

    rows: a number for each row, and a text. tokens: a function without arguments that gives, in the worker, a function
    from a text to (64-bit tokens, whether a token alone counts as shared). total: about how many tokens there are.
    """
    most, tasks = sizes(total, BLOCK_TOKENS, TASK_TOKENS)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean_memory()
        of = tokens()
        found = ((n, *of(t)) for batch in batches for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for r in _blocks(found, tasks, TaskContext.get().partitionId() << 20, most):
            yield pa.RecordBatch.from_pylist([r], pa.schema(_FIELDS))

    met = rows.mapInArrow(put, _SCHEMA).repartition(tasks, "bucket").mapInArrow(_meet, "block long, places binary, rows binary, sizes binary")
    return met.repartition(tasks, "block").mapInArrow(_by_row, "row long, places binary")
