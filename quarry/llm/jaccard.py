"""Near-duplicate groups by an exact n-gram Jaccard join with several global token orders.

A document is its set of distinct five-word shingles, as 64-bit hashes. Rows with equal sets form a class; all that
follows works on classes, so copies cost nothing. Two classes link when 100 * intersection >= 75 * union. Then, under
any one order of all tokens, if ``l`` of the first tokens must be shared, the first |x| - ceil(0.75 |x|) + l tokens of
either hold them. The filters use that in turn, each under another order, and only what passes all of them is compared:

1. Order A (by hash), over all documents: a class stays if enough of its first third is shared with any other class.
2. Order B (all tokens, those shared first), among the classes left: three quarters must be shared.
3. The classes left are grouped by their first token under several more orders. Large groups are split by a hash. In a
   task, links that join two groups of linked classes are found by comparing sets; links within one are implied. Only pairs
   are compared that share a prefix token under each of two more orders.
4. The same filter again, where only tokens shared with *another* component count. What is left is split into regions
   that such tokens connect in the prefixes of a rare-first order. A region is compared in blocks, across components
   only, and again only pairs that share prefix tokens under the two orders.

Filters count marks, they never list pairs: postings travel as sorted binary blocks, each block sends a token once, and
a token that a third of all rows hold costs one posting for each block. Every step loses no link, so components are exact.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing and is its own
component; fewer than five words are one shingle; a null doc_id is carried, and its component is the least doc_id that
links reach, null if none has one; repeated rows share a component; an empty table gives no rows; other columns are
ignored. Hashes of 64 bits stand for shingles, of 128 bits for sets (of 64 in the first filter, which thereby could only
miss a link between two sets of the same hash).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_limits, lean_memory, narrow, spool
from quarry.llm.postings import sizes

WIDTH = 5
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Tokens in a block of postings, rows of a block (they are numbered with 16 bits), tokens for a task that counts them; the first and last grow as ``postings.sizes`` tells.
BLOCK_TOKENS, BLOCK_ROWS, TASK_TOKENS = 300_000, 60_000, 300_000
#: The orders under each of which a pair must share a prefix token before it is compared.
PAIR_ORDERS = (11, 12)
#: The largest groups compared in one piece: of the same first token, and of a region.
GROUP, UNIT = 256, 512


def _mix(x, seed: int):
    """A permutation of the 64-bit numbers for each seed: an order of the tokens."""
    import numpy as np

    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of a text's shingles, sorted. Word hashes are remembered up to a fixed number."""

    REMEMBERED = 150_000

    def __init__(self, width: int = WIDTH):
        self.width, self.known = width, {}
        lean_memory()

    def __call__(self, text: str | None):
        import numpy as np
        from xxhash import xxh3_64_intdigest as digest

        words = (text or "").encode().translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.width:
            return np.array([digest(b" ".join(words))], np.uint64)
        known = self.known
        if len(known) > self.REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.width + 1
        total = np.zeros(n, np.uint64)
        for i in range(self.width):  # position matters: each word's hash is permuted by its place
            total = _mix(total + h[i : i + n], i + 1)
        return np.unique(total)


def needed(n: int) -> int:
    """Least tokens that a set of n shares with any partner."""
    return -(-3 * n // 4)


def _required(n: int) -> tuple[int, int]:
    """(prefix, l): the first third or more of n tokens, and how many of them are shared with a partner for sure.

    The prefix is n - needed(n) + l' with l' a twelfth of n. A partner has 0.75 n tokens or more and a prefix for its
    own size; the first l shared tokens lie in both prefixes for the l of the least possible partner.
    """
    least = max(1, needed(n) // 12)
    return min(n, n - needed(n) + max(1, n // 12)), least


def _marks(sets: Iterator[tuple[int, int, object, object]], total: int, whole: bool, first: int) -> Iterator[dict]:
    """Blocks of postings. sets: (identity, class, key that tells sets apart, sorted tokens); whole: all tokens count, not a prefix.

    A row for each block (its classes, their sizes, and their marks from the block itself) and for each bucket of tokens
    one with the postings of one identity (token, row in block, identity) and the tokens that more identities share.
    """
    import numpy as np

    most, buckets = sizes(total, BLOCK_TOKENS, TASK_TOKENS)
    block = first
    rows: list[tuple[int, int, int]] = []
    parts: list = []
    size = 0

    def flush() -> Iterator[dict]:
        token = np.concatenate(parts)
        row = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p) for p in parts])
        own = np.array([r[0] for r in rows], np.int64)
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        sizes = np.diff(np.append(starts, len(token)))
        ident = own[row]
        several = np.minimum.reduceat(ident, starts) != np.maximum.reduceat(ident, starts)
        counted = np.repeat(several, sizes)
        marks = np.bincount(row[counted], minlength=len(rows))
        yield {"bucket": block % buckets, "block": block, "marks": marks.astype(np.int32).tobytes(), "cls": np.array([r[1] for r in rows], np.int64).tobytes(), "n": np.array([r[2] for r in rows], np.int32).tobytes()}
        # Tokens of one identity: a posting for each row. Tokens of several: the token alone, as its rows are marked.
        once = ~counted
        token_1, row_1, ident_1 = token[once], row[once], ident[once]
        token_2 = token[starts[several]]
        edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
        a = np.searchsorted(token_1, edges).tolist()
        b = np.searchsorted(token_2, edges).tolist()
        for k, (i, j, p, q) in enumerate(zip([0, *a], [*a, len(token_1)], [0, *b], [*b, len(token_2)], strict=True)):
            if i < j or p < q:
                yield {"bucket": k, "block": block, "tokens": token_1[i:j].tobytes(), "rows": row_1[i:j].tobytes(), "idents": b"" if (own == [r[1] for r in rows]).all() else ident_1[i:j].tobytes(), "shared": token_2[p:q].tobytes()}

    seen: set = set()
    for ident, cls, key, tokens in sets:
        if key in seen or not len(tokens):
            continue
        seen.add(key)
        n = len(tokens)
        parts.append(tokens if whole else _mix(tokens[: _required(n)[0]], 21))  # a prefix has the least numbers: spread over all buckets again
        rows.append((ident, cls, n))
        size += len(parts[-1])
        if size >= most or len(rows) >= BLOCK_ROWS:
            yield from flush()
            block += 1
            rows, parts, size = [], [], 0
            seen = set()
    if rows:
        yield from flush()


_MARK_FIELDS = (("bucket", pa.int32()), ("block", pa.int64()), ("marks", pa.binary()), ("cls", pa.binary()), ("n", pa.binary()), ("tokens", pa.binary()), ("rows", pa.binary()), ("idents", pa.binary()), ("shared", pa.binary()))
_MARK_SCHEMA = "bucket int, block long, marks binary, cls binary, n binary, tokens binary, rows binary, idents binary, shared binary"
_MET_FIELDS = (("block", pa.int64()), ("marks", pa.binary()), ("cls", pa.binary()), ("n", pa.binary()), ("rows", pa.binary()))
_MET_SCHEMA = "block long, marks binary, cls binary, n binary, rows binary"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of a task's buckets, a row for each block: rows of the block whose token another identity holds too, and how many of theirs."""
    import numpy as np

    lean_memory()
    tokens, rows, idents, blocks, shared = [], [], [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["cls"] is not None:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("block", "marks", "cls", "n")}], pa.schema(_MET_FIELDS))
                continue
            t = np.frombuffer(r["tokens"], np.uint64)
            tokens.append(t)
            row = np.frombuffer(r["rows"], np.uint16)
            rows.append(row.astype(np.int64))
            blocks.append(np.full(len(t), r["block"], np.int64))
            idents.append(np.frombuffer(r["idents"], np.int64) if r["idents"] else (np.int64(r["block"]) << np.int64(16)) + row)
            shared.append(np.frombuffer(r["shared"], np.uint64))
    if not tokens:
        return
    token, row, ident, block = map(np.concatenate, (tokens, rows, idents, blocks))
    if not len(token):
        return
    del tokens, rows, idents, blocks
    order = np.argsort(token, kind="stable")
    token, row, ident, block = token[order], row[order], ident[order], block[order]
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    sizes = np.diff(np.append(starts, len(token)))
    several = np.minimum.reduceat(ident, starts) != np.maximum.reduceat(ident, starts)
    elsewhere = np.unique(np.concatenate(shared))
    if len(elsewhere):
        at = np.searchsorted(elsewhere, token[starts])
        at[at == len(elsewhere)] = 0
        several |= elsewhere[at] == token[starts]
    hit = np.repeat(several, sizes)
    where, counts = np.unique((block[hit] << np.int64(16)) | row[hit], return_counts=True)
    own = where >> np.int64(16)
    ends = np.flatnonzero(np.concatenate((own[1:] != own[:-1], [True]))) + 1 if len(own) else []
    start = 0
    for end in ends:
        yield pa.RecordBatch.from_pylist([{"block": int(own[start]), "rows": (where[start:end] & 0xFFFF).astype(np.uint16).tobytes(), "marks": counts[start:end].astype(np.int32).tobytes()}], pa.schema(_MET_FIELDS))
        start = end


def _enough(whole: bool):
    """Sums a task's blocks; (cls, n) of the classes with marks enough."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tables: dict[int, list] = {}
        early: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                marks = np.frombuffer(r["marks"], np.int32)
                if r["cls"] is not None:
                    tables[r["block"]] = [np.frombuffer(r["cls"], np.int64), np.frombuffer(r["n"], np.int32), marks.copy()]
                else:
                    early.setdefault(r["block"], []).append((np.frombuffer(r["rows"], np.uint16), marks))
        for block, (cls, n, marks) in tables.items():
            for rows, more in early.get(block, []):
                marks[rows] += more
            need = -(-3 * n.astype(np.int64) // 4)
            kept = np.flatnonzero(marks >= (need if whole else np.maximum(1, need // 12)))
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array(cls[kept]), pa.array(n[kept])], names=["cls", "n"])

    return told


def _filtered(blocks: DataFrame, total: int, whole: bool) -> DataFrame:
    """(cls, n) of the classes with marks enough."""
    _, tasks = sizes(total, BLOCK_TOKENS, TASK_TOKENS)
    met = blocks.repartition(tasks, "bucket").mapInArrow(_meet, _MET_SCHEMA)
    return met.repartition(tasks, "block").mapInArrow(_enough(whole), "cls long, n int").groupBy("cls").agg(F.max("n").alias("n"))


def _batches(rows: Iterator[dict], fields, size: int = 64) -> Iterator[pa.RecordBatch]:
    schema, held = pa.schema(fields), []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _digest(tokens) -> tuple[int, int]:
    """(lo, hi) of a set's 128-bit digest, which tells classes apart."""
    from xxhash import xxh3_128_intdigest

    found = xxh3_128_intdigest(tokens.tobytes())
    return (found & (1 << 64) - 1) - (1 << 63), (found >> 64) - (1 << 63)


def members(docs: DataFrame) -> DataFrame:
    """row (in reading order), doc_id, the size of its set and its digest (null for an empty set), stored."""
    arrow_limits(docs.sparkSession)

    def told(batches):
        shingles = Shingler()
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            digests = [_digest(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), batch.column(2)], names=["doc_id", "n_shingles", "lo", "hi", "row"])

    return spool(narrow(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()).mapInArrow(told, "doc_id long, n_shingles long, lo long, hi long, row long"), "members")


def _first_filter(docs: DataFrame, total: int) -> DataFrame:
    """The lower halves (cls) of the digests whose sets pass; here these halves stand for the identities of sets."""
    total = ceil(total * 0.35)

    def put(batches):
        from pyspark import TaskContext

        shingles = Shingler()
        sets = ((d[0], d[0], d, s) for batch in batches for t in batch.column(0).to_pylist() if len(s := shingles(t)) for d in [_digest(s)])
        return _batches(_marks(sets, total, False, TaskContext.get().partitionId() << 24), _MARK_FIELDS)

    return _filtered(narrow(docs, "text").mapInArrow(put, _MARK_SCHEMA), total, False)


def _whole_filter(sets: DataFrame, total: int, ident: str) -> DataFrame:
    """sets: cls, n, tokens and the identity; only tokens that another identity holds count."""

    def put(batches):
        import numpy as np
        from pyspark import TaskContext

        rows = ((i, c, c, np.frombuffer(t, np.uint64)) for batch in batches for i, c, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        return _batches(_marks(rows, total, True, TaskContext.get().partitionId() << 24), _MARK_FIELDS)

    return _filtered(sets.select(F.col(ident).alias("ident"), "cls", "tokens").mapInArrow(put, _MARK_SCHEMA), total, True)


def _sets_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """cls, n and tokens of the chosen classes (cls, lo, hi, doc_id of a document that has it), stored."""
    named = chosen.select(F.col("doc_id").alias("name")).distinct()
    texts = narrow(docs, "doc_id", "text").join(named, F.col("doc_id").eqNullSafe(F.col("name")), "left_semi").select("text")

    def told(batches):
        shingles = Shingler()
        for batch in batches:
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["lo", "hi", "n", "tokens"])

    found = texts.mapInArrow(told, "lo long, hi long, n int, tokens binary").join(chosen.select("cls", "lo", "hi"), ["lo", "hi"])
    return spool(found.groupBy("cls").agg(F.max("n").alias("n"), F.max("tokens").alias("tokens")), "sets")


def _alike(a, b) -> bool:
    """Whether two frozen sets link."""
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _linked_in(classes: list[int], arrays: list) -> Iterator[tuple[int, int]]:
    """Links that span the components of one group; a class is compared with a component until one member links, and only with members that share a prefix token under each of ``PAIR_ORDERS``."""
    sets = [frozenset(a.tolist()) for a in arrays]
    fronts = [_prefixes(a, PAIR_ORDERS) for a in arrays]
    components: list[list[int]] = []
    for i in range(len(classes)):
        mine = [i]
        apart = []
        for c in components:
            if any(_meeting(fronts[i], fronts[j]) and _alike(sets[i], sets[j]) for j in c):
                yield classes[i], classes[c[0]]
                mine = c + mine
            else:
                apart.append(c)
        components = [*apart, mine]


def _meeting(a: list[frozenset], b: list[frozenset]) -> bool:
    """Whether two sets' prefixes meet under every order."""
    return not any(x.isdisjoint(y) for x, y in zip(a, b, strict=True))


def _group_links(sets: DataFrame, order: int) -> DataFrame:
    """Links found among the classes with the same first token under an order."""

    def keyed(batches):
        import numpy as np

        for batch in batches:
            keys = [int(_mix(np.frombuffer(t, np.uint64), order).min() >> np.uint64(1)) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("cls")], names=["key", "cls"])

    keys = spool(sets.select("cls", "tokens").mapInArrow(keyed, "key long, cls long"), "keys")
    counts = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").withColumn("parts", F.ceil(F.col("k") / GROUP).cast("int"))
    grouped = keys.join(counts, "key").select("cls", F.xxhash64("key", F.pmod(F.xxhash64("cls", F.lit(order)), F.col("parts"))).alias("group"))
    together = sets.join(grouped, "cls").select("group", "cls", "tokens").repartition(F.col("group")).sortWithinPartitions("group", "cls")

    def links(batches):
        import numpy as np

        for held in _runs(batches, 3):
            found = list(_linked_in([c for c, _ in held], [np.frombuffer(t, np.uint64) for _, t in held]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return together.mapInArrow(links, "a long, b long")


def components(links: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """(cls, comp): the least class that links reach, for every class with a link. Labels spread along links and jump to
    their label's label; each round is stored, and only a count of changes comes to the driver."""
    both = spool(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = spool(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.col("cls"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("other"))
        spread = labels.join(near, "cls", "left").select("cls", F.col("comp").alias("before"), F.least("comp", F.coalesce("other", "comp")).alias("comp"))
        far = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("root"))
        jumped = spool(spread.join(far, "comp", "left").select("cls", "before", F.least("comp", F.coalesce("root", "comp")).alias("comp")), "labels")
        labels = jumped.select("cls", "comp")
        if not jumped.where("comp <> before").limit(1).count():
            return labels


def _regions(left: DataFrame) -> DataFrame:
    """(cls, region): classes that prefix tokens of different components connect, under the order: tokens of one component, then rare ones.

    Only tokens of several components connect; those of one come first in a prefix, so it is enough to know how many they are.
    """

    def each(batches):
        import numpy as np

        for batch in batches:
            for cls, comp, n, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                tokens = np.frombuffer(t, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), v, k)) for v, k in ((cls, np.int64), (comp, np.int64), (n, np.int32))] + [pa.array(tokens)], names=["cls", "comp", "n", "token"])

    token = left.select("cls", "comp", "n", "tokens").mapInArrow(each, "cls long, comp long, n int, token long")
    sums = token.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    crossing = spool(sums.where("lo <> hi").select("token", "df"), "crossing")  # read again, so that Spark may split a token that very many classes hold
    line = F.sort_array(F.collect_list(F.struct("df", "token")))
    held = token.join(crossing, "token").groupBy("cls", "n").agg(line.alias("line"))
    room = F.greatest(F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1 - (F.col("n") - F.size("line")), F.lit(0)).cast("int")
    prefix = spool(held.select("cls", F.explode(F.slice("line", F.lit(1), room)).alias("t")).select("cls", "t.token"), "prefix")
    first = spool(prefix.groupBy("token").agg(F.min("cls").alias("b")), "first")
    return components(prefix.join(first, "token").where("cls <> b").select(F.col("cls").alias("a"), "b").distinct()).withColumnRenamed("comp", "region")


def _prefixes(tokens, orders: tuple[int, ...]) -> list[frozenset]:
    """The first tokens under several orders of which any partner shares one."""
    import numpy as np

    n = len(tokens)
    room = n - needed(n) + 1
    return [frozenset(tokens[np.argpartition(_mix(tokens, order), room - 1)[:room]].tolist()) for order in orders]


def _across(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links of a unit's rows (cls, comp, block, tokens) that join components; of two blocks only pairs between them are asked.

    A pair is compared if it shares a prefix token under each of two more orders.
    """
    import numpy as np

    root = {comp: comp for _, comp, _, _ in rows}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    rows = sorted(rows, key=lambda r: (len(r[3]), r[0]))
    arrays = [np.frombuffer(r[3], np.uint64) for r in rows]
    sets = [frozenset(a.tolist()) for a in arrays]
    fronts = [_prefixes(a, PAIR_ORDERS) for a in arrays]
    two = len({r[2] for r in rows}) > 1
    for i, (cls, comp, block, _) in enumerate(rows):
        mine = find(comp)
        for j in range(i - 1, -1, -1):
            if 4 * len(sets[j]) < 3 * len(sets[i]):
                break
            if two and rows[j][2] == block:
                continue
            other = find(rows[j][1])
            if other == mine or not _meeting(fronts[i], fronts[j]):
                continue
            if _alike(sets[i], sets[j]):
                yield cls, rows[j][0]
                root[other] = mine


def _pair_links(left: DataFrame) -> DataFrame:
    """Links across components among the classes left (cls, comp, n, tokens). A region is compared in blocks: each class goes to the units of its block with every other."""
    regions = _regions(left)
    counts = regions.groupBy("region").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("blocks"))
    placed = regions.join(counts, "region").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    units = placed.select("cls", "region", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = units.select("cls", "block", F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("unit"))
    together = left.join(keyed, "cls").select("unit", "cls", "comp", "block", "tokens").repartition(F.col("unit")).sortWithinPartitions("unit", "cls")

    def links(batches):
        for held in _runs(batches, 5):
            found = list(_across(held))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return together.mapInArrow(links, "a long, b long")


def _runs(batches, width: int) -> Iterator[list[tuple]]:
    """Rows with the same first column, without it."""
    held, now = [], None
    for batch in batches:
        for key, *rest in zip(*(batch.column(k).to_pylist() for k in range(width)), strict=True):
            if key != now and held:
                yield held
                held = []
            now = key
            held.append(tuple(rest))
    if held:
        yield held


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members, and for each class its digest (lo, hi), the least doc_id and its component's label: cls (the first row that has it), lo, hi, doc_id, comp."""
    arrow_limits(docs.sparkSession)
    told = members(docs)
    classes = spool(told.where("lo is not null").groupBy("lo", "hi").agg(F.min("row").alias("cls"), F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    survivors = spool(_first_filter(docs, total), "survivors")
    sets = _sets_of(docs, classes.join(survivors.select(F.col("cls").alias("lo")), "lo", "left_semi"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    dense = spool(sets.join(_whole_filter(sets.withColumn("ident", F.col("cls")), total, "ident").select("cls"), "cls", "left_semi"), "dense")
    links = None
    for order in (1, 2, 3):
        found = _group_links(dense, order)
        links = found if links is None else links.union(found)
    links = spool(links, "group-links")
    comps = components(links)
    labelled = spool(dense.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "labelled")
    total = labelled.agg(F.sum("n")).first()[0] or 0
    left = spool(labelled.join(_whole_filter(labelled, total, "comp").select("cls"), "cls", "left_semi"), "left")
    more = spool(_pair_links(left), "pair-links")
    if more.limit(1).count():
        comps = components(links.union(more))
    owned = classes.select("cls", "lo", "hi", "doc_id").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    return told, owned


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    told, owned = _classes(docs)
    least = owned.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = owned.join(least, "comp").select("lo", "hi", "component_id")
    return told.join(named, ["lo", "hi"], "left").select("doc_id", "n_shingles", F.when(F.col("lo").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns of one row of each component, that with the least doc_id (a null one last) and then the first read, and of all rows with an empty set.

    docs must be a stored table, as its rows are numbered in reading order twice.
    """
    told, owned = _classes(docs)
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("row"))
    of_class = told.where("lo is not null").groupBy("lo", "hi").agg(F.min(place).alias("place"))
    chosen = of_class.join(owned.select("lo", "hi", "comp"), ["lo", "hi"]).groupBy("comp").agg(F.min("place").alias("place")).select("place.row")
    kept = told.where("lo is null").select("row").union(chosen)
    return narrow(docs, *columns).withColumn("row", F.monotonically_increasing_id()).join(kept, "row", "left_semi").select(*columns)
