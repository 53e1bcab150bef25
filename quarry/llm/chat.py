"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, with all turns before it as context and only that reply trainable.

The template writes a turn as opening, role, line feed, text, closing. Texts and roles may hold control strings; these are
escaped by one more backslash after their first character, so ``</s>`` becomes ``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``. Taking one backslash
away again gives the text back, and no control string is left in an escaped text.

``expand`` puts the formatted turns in order, ``written`` makes the examples of them and stores these whole: every reply's row of turns up to
its own, the mask on that reply. Turns meet the replies of a block of 64 places, so a long conversation's examples are made in many tasks, and an
example's text is stored in parts of a million characters or so, each of whole turns. What follows a conversation's last reply is in no example and
is stored beside them. Written out, the examples of n turns are n squared over two turns; they are stored compressed, and beginnings repeat.
``digests`` reads the stored examples.

Defined results: turns are ordered by turn (null first), then role and text, so repeated rows follow one another; a null text or role is
an empty one; a role other than ``assistant`` is context; a conversation without a reply has its rows but no example; a null
conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_limits, narrow, spool
from quarry.llm.ordered import numbered


@dataclass(frozen=True)
class Template:
    """controls: strings that may not stand in a text as they are; each is one of ``<`` and ``[`` and then something without either."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"
    reply: str = "assistant"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

    def __post_init__(self):
        if any(c[0] not in "<[" or set(c[1:]) & set("<[\\") for c in self.controls) or self.opening not in self.controls or self.closing.rstrip("\n") not in self.controls:
            raise ValueError("a control string is < or [ and then neither of them nor a backslash; opening and closing are control strings")

    def _pattern(self, more: str) -> str:
        return rf"([<\[]){more}(\\*)({'|'.join(dict.fromkeys(re.escape(c[1:]) for c in self.controls))})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(""), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\"), "$1$2$3")

    def head(self, role: Column) -> Column:
        """The opening and the role, which is one line: its line feeds are written as in a URL."""
        line = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
        return F.concat(F.lit(self.opening), self.escape(line), F.lit("\n"))

    def role(self, piece: Column) -> Column:
        line = self.unescape(F.substring_index(F.substr(piece, F.lit(len(self.opening) + 1)), "\n", 1))
        return F.replace(F.replace(line, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))

    def text(self, piece: Column) -> Column:
        begin = F.instr(piece, "\n") + 1
        return self.unescape(F.substr(piece, begin, F.char_length(piece) - len(self.closing) - begin + 1))


PLAIN = Template()


def expand(turns: DataFrame, template: Template = PLAIN) -> DataFrame:
    """The formatted turns, stored: conv_id, conv (its place among all), at (the turn's place from 0), piece, start and stop of the piece, and for an example (a reply) loss_start and loss_stop, else null."""
    arrow_limits(turns.sparkSession)
    plain = narrow(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    made = plain.select("conv_id", "turn", "role", "text", template.head(F.col("role")).alias("head"), template.escape(F.col("text")).alias("body"))
    sized = made.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat("head", "body", F.lit(template.closing)).alias("piece"),
        F.char_length("head").cast("long").alias("head"),
        F.char_length("body").cast("long").alias("body"),
        (F.char_length("head") + F.char_length("body") + len(template.closing)).cast("long").alias("size"),
    )
    placed = numbered(sized, "conv_id", ("turn", "role", "text"), "size")
    begin = F.when(F.col("role") == template.reply, F.col("before") + F.col("head"))
    return spool(placed.select("conv_id", F.col("group_at").alias("conv"), "at", "piece", F.col("before").alias("start"), (F.col("before") + F.col("size")).alias("stop"), begin.alias("loss_start"), (begin + F.col("body")).alias("loss_stop")), "formatted", compression="zstd")


def examples(expanded: DataFrame) -> DataFrame:
    """conv_id, at, context_stop, loss_start, loss_stop and stop of every example."""
    return expanded.where("loss_start is not null").select("conv_id", "at", F.col("start").alias("context_stop"), "loss_start", "loss_stop", "stop")


def parse(expanded: DataFrame, template: Template = PLAIN) -> DataFrame:
    """conv_id, at, role and text of the turns, loss (the text under the loss mask, null outside examples), all unescaped, and stop."""
    piece = F.col("piece")
    masked = F.substr(piece, (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int"))
    return expanded.select("conv_id", "at", template.role(piece).alias("role"), template.text(piece).alias("text"), template.unescape(masked).alias("loss"), "stop")


def render(expanded: DataFrame) -> DataFrame:
    """conv_id, at, context, rest of every example whole: all turns before it, and its own piece. A task keeps one conversation's text at a time and gives one example after another; what it gives grows with the square of a conversation's length."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = [], []
        for batch in batches:
            for conv, at, piece, reply in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if last != [conv]:
                    last, parts = [conv], []
                if reply is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([at], pa.int64()), pa.array(["".join(parts)]), pa.array([piece])], names=["conv_id", "at", "context", "rest"])
                parts.append(piece)

    rows = expanded.select("conv_id", "at", "piece", "loss_start").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return rows.mapInArrow(whole, "conv_id long, at long, context string, rest string")


#: Places of replies that turns meet together, and characters of an example's part.
BLOCK, PART = 64, 1 << 20


def written(expanded: DataFrame, part: int = PART) -> DataFrame:
    """The examples, stored: conv, conv_id, example (its reply's place), part, text, longest (whether no other of the conversation is longer), and, in the part with the reply, loss_start and loss_stop within the part's text.

    Turns after the last reply are an example null, without a mask.
    """
    place = lambda c: F.floor(F.col(c) / BLOCK)
    replies = expanded.where("loss_start is not null").select("conv", F.col("at").alias("example"), place("at").alias("block"))
    last = replies.groupBy("conv").agg(F.max("example").alias("last"))
    turns = expanded.join(last, "conv", "left")
    met = turns.where("at <= last").withColumn("block", F.explode(F.sequence(place("at"), place("last")))).join(replies, ["conv", "block"]).where("at <= example")
    left = turns.where("last is null or at > last").withColumn("block", F.lit(-1).cast("long")).withColumn("example", F.lit(None).cast("long"))
    whole = lambda rows: rows.groupBy("conv", "block", "conv_id", "example", F.floor(F.col("start") / part).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),  # of one part
        F.min("start").alias("begin"),
        F.first("last").alias("last"),
        F.max(F.when(F.col("at") == F.col("example"), F.col("loss_start"))).alias("loss_start"),
        F.max(F.when(F.col("at") == F.col("example"), F.col("loss_stop"))).alias("loss_stop"),
    )
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    longest = F.col("example").isNull() | (F.col("example") == F.col("last"))
    made = whole(met).unionByName(whole(left)).select("conv", "conv_id", "example", "part", text.alias("text"), longest.alias("longest"), *((F.col(c) - F.col("begin")).alias(c) for c in ("loss_start", "loss_stop")))
    return spool(made, "examples", compression="zstd")


def digests(expanded: DataFrame, template: Template = PLAIN) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of every turn), loss_chars and loss_sha256 (texts under the mask), and formatted_chars (of all examples), read from the examples as written out.

    Turns are those of a conversation's longest example and what follows its last reply. A digest takes them one after another, so a
    conversation is one task's; they stream by and are never held together.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last, state = [], None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def close() -> None:
            n, turns, chars, loss, total = state
            rows.append((last[0], n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return made

        for batch in batches:
            for conv, role, text, loss, size in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if last != [conv]:
                    if last:
                        close()
                    last, state = [conv], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if role is not None:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += size
            if len(rows) >= 1000:
                yield flush()
        if last:
            close()
        if rows:
            yield flush()

    stored, none = written(expanded), F.lit(None).cast("string")
    pieces = F.split("text", re.escape(template.closing))  # in no escaped text
    turns = stored.where("longest").select("conv", "conv_id", "example", "part", F.posexplode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("i", "piece"))
    piece = F.concat("piece", F.lit(template.closing))
    masked = F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int"))
    read = turns.select("conv", "conv_id", F.lit(0).alias("kind"), "example", "part", "i", template.role(piece).alias("role"), template.text(piece).alias("text"), none.alias("loss"), F.lit(0).cast("long").alias("size"))
    under = stored.where("example is not null").select("conv", "conv_id", F.lit(1).alias("kind"), "example", "part", F.lit(0).alias("i"), none.alias("role"), none.alias("text"), template.unescape(masked).alias("loss"), F.char_length("text").cast("long").alias("size"))
    order = ["conv", "kind", F.col("example").asc_nulls_last(), "part", "i"]
    rows = read.unionByName(under).repartition("conv").sortWithinPartitions(*order).select("conv_id", "role", "text", "loss", "size")
    return rows.mapInArrow(told, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
