"""Ranked lexical search over a stored index by the threshold algorithm.

``build`` stores the index: shards of about a million terms, each with its documents, its vocabulary, for every term a list of
(document, impact) with the greatest impact first, and for every document its (term, impact) pairs, the forward index. A
dictionary tells in how many documents a term stands. An impact is what one occurrence's term gives a document's score before
the term's weight: (10^9 * tf) div (1000 * tf + 8 * m).

``search`` takes every shard once for a block of questions. For a question the lists of its terms are read in turn from the
top; a document met for the first time is scored in full from the forward index. The threshold is what a document could
score that stands in every list where reading has come to; once it is strictly below the k-th score, no document that was not met can be among the
best or tie with them. A task keeps the k best of each question from shard to shard, so that later shards stop sooner;
what tasks have kept is ranked once more. Reading goes in rounds of 32, 64, 128, ... places of each list, to be done on arrays.

Terms are runs of letters and digits of ASCII and of all other characters; only A-Z are lower-cased. A document's m is
25 + (75 * n * N) div L, with n its terms, N the documents with a term, L all terms. A term's weight is
floor(1000 * ln((2 N + 2) / (2 df + 1))).

Defined results: a null or empty text has no terms and is never found; a document with a null doc_id is ranked behind its equals; each
of repeated rows is a document of its own, and equal scores and ids are ranked in any order; a question without terms, or whose terms no
document holds, has no rows; questions are rows of (item_id, text), equal ones being one question, and those of the same id but different
texts each have ranks of their own; empty tables give no rows; other columns are ignored. Texts of any length are cut into pieces
of a megabyte between terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import LARGE_ROWS, arrow_limits, lean_memory, narrow, spool, uncollected

#: Terms of a shard, after which the next one begins with the next document.
SHARD_TERMS = 1 << 20
#: Characters of the questions that meet every shard together, on average.
BLOCK_CHARS = 1 << 21
PIECE = 1 << 20
FIRST_ROUND = 32
#: A-Z to a-z, what stands between terms to a blank; bytes of other characters stay.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32) for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms, in lists of a megabyte's at most or of one term."""
    data = (text or "").encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


@dataclass(frozen=True)
class Index:
    """shards, dictionary (term, df), documents with a term (N) and all terms (L)."""

    shards: DataFrame
    dictionary: DataFrame
    documents: int
    total: int


_SHARD = "documents array<long>, vocabulary binary, list_at binary, list_documents binary, list_impacts binary, row_at binary, row_terms binary, row_impacts binary"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = total = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n = sum(map(len, terms(text)))
            documents, total = documents + (n > 0), total + n
    yield pa.RecordBatch.from_pylist([{"documents": documents, "total": total}])


def _impacts(tf, n, documents: int, total: int):
    """Of (tf, length) pairs. The lengths are multiplied as whole numbers of any size."""
    import numpy as np

    lengths, of = np.unique(n, return_inverse=True)
    m = np.array([25 + 75 * x * documents // total for x in lengths.tolist()], np.int64)[of]
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _shard(ids: list, lengths: list[int], parts: list, vocabulary: dict[bytes, int], documents: int, total: int) -> dict:
    import numpy as np

    size = len(vocabulary)
    rows = np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
    held, tf = np.unique(rows * size + np.concatenate(parts), return_counts=True)
    row, term = held // size, (held % size).astype(np.int32)
    impact = _impacts(tf.astype(np.int64), np.asarray(lengths, np.int64)[row], documents, total).astype(np.int32)
    by = np.lexsort((-impact, term))
    at = lambda x, n: np.concatenate(([0], np.cumsum(np.bincount(x, minlength=n)))).astype(np.int64).tobytes()
    return {
        "documents": ids,
        "vocabulary": b" ".join(vocabulary),
        "list_at": at(term, size),
        "list_documents": row[by].astype(np.int32).tobytes(),
        "list_impacts": impact[by].tobytes(),
        "row_at": at(row, len(ids)),
        "row_terms": term.tobytes(),
        "row_impacts": impact.tobytes(),
    }


def build(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> Index:
    """Stores the index of doc_id and text: one pass for N and L, one for the shards; the dictionary is counted from the shards' vocabularies."""
    arrow_limits(docs.sparkSession)
    rows = narrow(docs, "doc_id", "text")
    told = rows.select("text").mapInArrow(_totals, "documents long, total long").agg(F.sum("documents"), F.sum("total")).first()
    documents, total = told[0] or 0, told[1] or 0

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lean_memory()
        schema = pa.schema([("documents", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("vocabulary", "list_at", "list_documents", "list_impacts", "row_at", "row_terms", "row_impacts"))])

        class Numbers(dict):
            def __missing__(self, term: bytes) -> int:
                self[term] = n = len(self)
                return n

        ids, lengths, parts, known, size = [], [], [], Numbers(), 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                for words in terms(text):
                    parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    n += len(words)
                if not n:
                    continue
                ids.append(i)
                lengths.append(n)
                size += n
                if size >= shard_terms:
                    yield pa.RecordBatch.from_pylist([_shard(ids, lengths, parts, known, documents, total)], schema=schema)
                    ids, lengths, parts, known, size = [], [], [], Numbers(), 0
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(ids, lengths, parts, known, documents, total)], schema=schema)

    shards = spool(rows.mapInArrow(put, _SHARD), "lexical-shards", compression="zstd", **LARGE_ROWS)

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for vocabulary, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(vocabulary.decode().split(" ")), pa.array(np.diff(np.frombuffer(at, np.int64)))], names=["term", "df"])

    few_rows(docs.sparkSession)
    counts = shards.select("vocabulary", "list_at").mapInArrow(count_terms, "term string, df long")
    return Index(shards, spool(counts.groupBy("term").agg(F.sum("df").alias("df")), "lexical-dictionary"), documents, total)


def few_rows(spark) -> None:
    """Shards go to Python one at a time: each has some ten megabytes."""
    arrow_limits(spark, 1)


def _questions(items: DataFrame) -> DataFrame:
    """question (a number), item_id, term, times."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(q, t.decode(), n) for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t, n in Counter(w for words in terms(text) for w in words).items()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["question", "term", "times"])

    return items.select("question", "text").mapInArrow(split, "question long, term string, times long")


class _Shard:
    """A shard with only the terms of a block of questions: their lists, and the documents' pairs of them."""

    def __init__(self, row: dict, wanted: dict[bytes, int]):
        import numpy as np

        self.ids = row["documents"]
        vocabulary = row["vocabulary"].split(b" ")
        self.place = {t: i for i, t in enumerate(vocabulary) if t in wanted}
        self.list_at = np.frombuffer(row["list_at"], np.int64)
        self.list_documents = np.frombuffer(row["list_documents"], np.int32)
        self.list_impacts = np.frombuffer(row["list_impacts"], np.int32)
        row_terms = np.frombuffer(row["row_terms"], np.int32)
        asked = np.zeros(len(vocabulary), np.bool_)
        asked[list(self.place.values())] = True
        some = np.flatnonzero(asked[row_terms])
        self.row_at = np.searchsorted(some, np.frombuffer(row["row_at"], np.int64))
        self.row_terms = row_terms[some]
        self.row_impacts = np.frombuffer(row["row_impacts"], np.int32)[some].astype(np.int64)
        self.weight = np.zeros(len(vocabulary), np.int64)
        self.met = np.zeros(len(self.ids), np.bool_)

    def scores(self, documents):
        """Looks all pairs of the documents up in the forward index."""
        import numpy as np

        begin, size = self.row_at[documents], self.row_at[documents + 1] - self.row_at[documents]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size)
        sums = np.concatenate(([0], np.cumsum(self.weight[self.row_terms[at]] * self.row_impacts[at])))
        return sums[ends] - sums[ends - size]

    def best(self, asked: list[tuple[int, int]], k: int, floor: list[tuple[int, object]]) -> tuple[list[tuple[int, object]], int]:
        """The k best (score, id) of the shard's documents and of ``floor``, and how many places of lists were read. asked: (term's place, weight)."""
        import numpy as np

        places = np.array([p for p, _ in asked])
        weights = np.array([w for _, w in asked], np.int64)
        begins, ends = self.list_at[places], self.list_at[places + 1]
        self.weight[places] = weights
        self.met[:] = False
        kept, depth, step, read = floor, 0, FIRST_ROUND, 0
        while True:
            some = [self.list_documents[a:b] for a, b in zip((begins + depth).tolist(), np.minimum(begins + depth + step, ends).tolist(), strict=True) if a < b]
            if not some:
                break
            found = np.concatenate(some)
            read += len(found)
            fresh = np.unique(found[~self.met[found]])
            depth, step = depth + step, step * 2
            if len(fresh):
                self.met[fresh] = True
                score = self.scores(fresh)
                least = max(1, kept[-1][0] if len(kept) == k else 1)
                good = np.flatnonzero(score >= least)
                if len(good) > k:  # equal scores may matter, lower ones don't
                    good = good[score[good] >= np.partition(score[good], -k)[-k]]
                kept = ranked([*kept, *((int(score[g]), self.ids[fresh[g]]) for g in good)], k)
            if len(kept) == k:
                here = begins + depth
                live = here < ends
                if int((weights[live] * self.list_impacts[here[live]]).sum()) < kept[-1][0]:
                    break
        self.weight[places] = 0
        return kept, read


def ranked(found: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item (item_id, text)."""
    spark = items.sparkSession
    arrow_limits(spark)
    asked = spool(narrow(items, "item_id", "text").distinct().withColumn("question", F.monotonically_increasing_id()), "questions")
    chars = asked.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, ceil(chars / BLOCK_CHARS))
    weight = F.floor(1000 * F.log((F.lit(2.0 * index.documents) + 2) / (2 * F.col("df") + 1)))
    weighed = _questions(asked).join(index.dictionary, "term").select("question", F.struct("term", (F.col("times") * weight).alias("weight")).alias("t")).groupBy("question").agg(F.collect_list("t").alias("terms"))  # of one question
    stored = spool(weighed.join(asked.select("question", "item_id"), "question").withColumn("block", F.pmod(F.xxhash64("question"), F.lit(blocks))), "weighed-questions")

    def meet(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        lean_memory()
        questions = [(q["question"], q["item_id"], [(t["term"].encode(), t["weight"]) for t in q["terms"] if t["weight"]]) for q in sent.value.to_pylist()]
        wanted = dict.fromkeys((t for _, _, ts in questions for t, _ in ts), 1)
        kept: dict[int, list] = {}
        with uncollected():
            for batch in batches:
                for row in batch.to_pylist():
                    shard = _Shard(row, wanted)
                    for q, _, ts in questions:
                        here = [(shard.place[t], w) for t, w in ts if t in shard.place]
                        if here:
                            kept[q], _ = shard.best(here, k, kept.get(q, []))
        found = [(q, item, doc, score) for q, item, _ in questions for score, doc in kept.get(q, [])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["question", "item_id", "doc_id", "score"])

    few_rows(spark)
    parts = []
    for b in range(blocks):  # a block is BLOCK_CHARS on average, so it may be sent to every task, once and not with every shard
        sent = spark.sparkContext.broadcast(stored.where(F.col("block") == b).select("question", "item_id", "terms").toArrow())
        parts.append(index.shards.mapInArrow(lambda batches, sent=sent: meet(batches, sent), "question long, item_id long, doc_id long, score long"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("question").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
