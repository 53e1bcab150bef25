"""A Merkle manifest of a dataset, by supersteps over an RDD of tree nodes.

A leaf is the digest of a row's fields. Leaves of a source, in order, and in turn the sources' subroots form trees in which
every three consecutive nodes have a parent. Up: a node sends its digest to its parent, and a parent that has all its
children hashes them and sends on. Down: a parent sends each child the path of siblings from itself to the root, so a leaf
ends up with its proof.

Nodes are kept in blocks of 3^6 = 729 neighbours. Within a block messages are delivered in memory, six levels of the tree
at once; across blocks they are shuffled, so a superstep of the RDD climbs or descends six levels. A block's inside is
hashed again on the way down rather than stored. Every superstep's result is stored. No group is larger than a block, so
a source with a third of all rows is many blocks, and a tree over n leaves takes log(n) / log(729) supersteps each way.

Defined results: a null field is ``-``; a null doc_id comes first in its source and is never tampered with; rows of one
doc_id are ordered by their leaves, so repeated rows are neighbours of equal leaves, each with its own proof; a null source
is a source of its own, first of all and not the empty one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import DOCUMENT, arrow_limits, narrow, spool
from quarry.llm.ordered import numbered

ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
#: A source's field order in a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row, with another text in place of its own if one is given."""
    return F.sha2(F.concat(*(_field(text if c == "text" and text is not None else F.col(c)) for c in FIELDS)), 256)


def without_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def _levels(nodes: list[bytes], climb: int) -> list[list[bytes]]:
    """The levels of a block from its lowest: ``climb`` more, each parent the digest of its children's hexadecimal digests."""
    levels = [nodes]
    for _ in range(climb):
        below = [n.hex().encode() for n in levels[-1]]
        levels.append([sha256(b"".join(below[i : i + ARITY])).digest() for i in range(0, len(below), ARITY)])
    return levels


def _climb(block: int, size: int) -> int:
    """How many levels a block climbs: all of its own, but in a tree that ends within the first block, to its root."""
    if block or size == BLOCK:
        return LEVELS
    climb = 0
    while size > 1:
        size, climb = -(-size // ARITY), climb + 1
    return climb


def _by_block(nodes: DataFrame):
    """An RDD of ((tree, block), (place in the block, digest, what else the node has)). nodes: tree, at, digest and more."""
    return nodes.rdd.map(lambda r: ((r[0], r[1] // BLOCK), (r[1] % BLOCK, bytes(r[2]), r[3:])))


def ascend(nodes: DataFrame) -> list[DataFrame]:
    """Supersteps up: tables of (tree, at, digest), each the blocks' tops of the one before, until every tree has one node. nodes: the leaves (tree, at, digest and more)."""

    def top(item) -> tuple:
        (tree, block), members = item
        digests = [d for _, d, _ in sorted(members, key=lambda m: m[0])]
        return tree, block, _levels(digests, _climb(block, len(digests)))[-1][0]

    tables = [nodes]
    while True:
        above = _by_block(tables[-1].select("tree", "at", "digest")).groupByKey().map(top)
        tables.append(spool(nodes.sparkSession.createDataFrame(above, "tree long, at long, digest binary", verifySchema=False), "merkle-up"))
        if tables[-1].where("at > 0").isEmpty():
            return tables


def _steps(levels: list[list[bytes]], place: int) -> Iterator[bytes]:
    """Of a node in a block, from below: a byte of its place among its siblings and their number (4 * place + siblings), then the siblings' digests."""
    for level in levels[:-1]:
        first = place - place % ARITY
        run = level[first : first + ARITY]
        yield bytes([4 * (place - first) + len(run) - 1]) + b"".join(d for i, d in enumerate(run) if i != place - first)
        place //= ARITY


def unpacked(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place among the siblings, the siblings' digests) of each level, from below."""
    at = 0
    while at < len(path):
        place, others = divmod(path[at], 4)
        at += 1
        yield place, [path[at + 32 * i : at + 32 * (i + 1)] for i in range(others)]
        at += 32 * others


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a node and its path lead to."""
    for place, others in unpacked(path):
        run = [o.hex().encode() for o in others]
        run.insert(place, digest.hex().encode())
        digest = sha256(b"".join(run)).digest()
    return digest


def descend(tables: list[DataFrame], tops, finish, schema: str) -> DataFrame:
    """Supersteps down, stored: ``finish(tree, at, digest, what else the leaf has, path, top)`` of all leaves.

    tables: as ``ascend`` made them. tops: an RDD of (tree, (path, top)) for every tree: the path that continues above its
    root, and a value that all its leaves are told.
    """
    spark = tables[0].sparkSession

    def deliver(told):
        def send(item):
            (tree, block), received = item
            nodes = sorted((m for m in received if m[0] >= 0), key=lambda m: m[0])
            levels = _levels([d for _, d, _ in nodes], _climb(block, len(nodes)))
            for _, above, top in (m for m in received if m[0] < 0):  # one
                for place, digest, more in nodes:
                    yield told(tree, block * BLOCK + place, digest, more, b"".join(_steps(levels, place)) + above, top)

        return send

    sent = tops.map(lambda t: ((t[0], 0), (-1, *t[1])))
    for table in tables[-2:0:-1]:
        down = _by_block(table).union(sent).groupByKey().mapValues(list).flatMap(deliver(lambda tree, at, digest, more, path, top: (tree, at, path, top)))
        stored = spool(spark.createDataFrame(down, "tree long, at long, path binary, top binary", verifySchema=False), "merkle-down")
        sent = stored.rdd.map(lambda r: ((r[0], r[1]), (-1, bytes(r[2]), bytes(r[3]))))
    return spool(spark.createDataFrame(_by_block(tables[0]).union(sent).groupByKey().mapValues(list).flatMap(deliver(finish)), schema, verifySchema=False), "merkle-told")


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the source's place), at, digest, doc_id and ``changed``: the digest after tampering, null where that leaves the row as it is."""
    arrow_limits(docs.sparkSession)
    text = F.col("text")
    tampered = (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0) & F.contains(text, F.lit("\n"))
    made = narrow(docs, *DOCUMENT).select("source", "doc_id", F.unhex(leaf()).alias("digest"), F.when(tampered, F.unhex(leaf(without_breaks(text)))).alias("changed"))
    return numbered(made, "source", ("doc_id", "digest")).select(F.col("group_at").alias("tree"), "at", "digest", "doc_id", "changed")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row: does what is now there (tampered or not) with the leaf's proof still lead to the root?"""
    spark = docs.sparkSession
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    nodes = leaves(docs)
    if nodes.isEmpty():
        return spark.createDataFrame([], schema)
    sources = ascend(nodes)
    roots = sources[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest")
    above = ascend(roots)
    root = bytes(above[-1].first()["digest"])  # one row
    subroots = descend(above, spark.sparkContext.parallelize([(0, (b"", root))], 1), lambda tree, at, digest, more, path, top: (at, path, digest), "tree long, path binary, subroot binary")

    def told(tree, at, digest, more, path, subroot):
        proof = sha256()
        for _, others in unpacked(path):
            for o in others:
                proof.update(o.hex().encode())
        doc_id, changed = more
        folded = fold(digest if changed is None else bytes(changed), path)
        return doc_id, digest.hex(), subroot.hex(), root.hex(), proof.hexdigest(), folded.hex(), folded == root

    return descend(sources, subroots.rdd.map(lambda r: (r[0], (bytes(r[1]), bytes(r[2])))), told, schema)
