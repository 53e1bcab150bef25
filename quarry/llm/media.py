"""Media columns: payloads kept as grey images in tar archives, read through a custom Spark data source.

A payload, padded with zeros to whole rows of 64 samples, is stored as an 8-bit grey PNG (lossless; the same text
always gives the same bytes). Each writing task makes one tar archive and, beside it, an index of member offsets; both
get their final names, which depend only on the task's number, when complete, so a repeated task replaces its own files.

The ``quarry_media`` data source lists the archive folders and plans byte ranges of the archives as partitions: a member
belongs to the range in which it starts. A range is read as a stream of Arrow batches; each member is fetched by its
offset, and a member that fails is fetched again by itself.

Defined results: a null text is empty (64 zero samples); a null doc_id is carried; repeated rows give repeated members;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.llm.common import arrow_limits, narrow, shared_dir

WIDTH = 64
SCHEMA = "doc_id long, n_bytes long, media binary"
#: Fixed values of the public PNG format.
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes) -> bytes:
    """Zeros appended up to a positive multiple of the width."""
    return data + b"\0" * (WIDTH - len(data) if not data else -len(data) % WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey PNG of 64 columns, a sample for each byte."""
    import numpy as np

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with its filter: 0, none
    lines[:, 1:] = rows
    return PNG_MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of such a PNG, its checksums verified."""
    import numpy as np

    if media[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, packed, shape = 8, [], (0, 0)
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a line is filtered")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Whole-number image statistics: samples, their sum, how often neighbours differ in a row, and a histogram of eight grey bands."""
    import numpy as np

    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bands = np.bincount(image.ravel() >> 5, minlength=8)
    return f"n={image.size};sum={int(image.sum(dtype=np.int64))};edges={np.count_nonzero(image[:, 1:] != image[:, :-1])};bands={','.join(map(str, bands))}"


def write_archives(docs: DataFrame, folder: str) -> None:
    """An archive of members for each task, named by doc_id and unpadded size."""
    arrow_limits(docs.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{root}/media-{task.partitionId():06d}.tar"
        own = f".{task.taskAttemptId()}.part"
        store.create_dir(root)
        offsets, at, out = [], 0, None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = out or store.open_output_stream(name + own)
                data = (text or "").encode()
                media = encode(pad(data))
                info = tarfile.TarInfo(f"{'none' if doc_id is None else doc_id}.{len(data)}.png")
                info.size = len(media)
                block = info.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % 512)
                out.write(block)
                offsets.append(at)
                at += len(block)
        if out:
            out.write(b"\0" * 1024)
            out.close()
            with store.open_output_stream(f"{name}.idx{own}") as f:
                f.write(json.dumps(offsets).encode())
            store.move(f"{name}.idx{own}", f"{name}.idx")
            store.move(name + own, name)
        yield pa.RecordBatch.from_arrays([pa.array([len(offsets)], pa.int64())], names=["members"])

    narrow(docs, "doc_id", "text").mapInArrow(put, "members long").agg(F.sum("members")).first()


class Range(InputPartition):
    """The members of an archive that start from one byte place up to another."""

    def __init__(self, path: str | None, start: int = 0, stop: int = 0):
        self.path, self.start, self.stop = path, start, stop


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders = options["path"].split(",")
        self.span = int(options.get("rangebytes", options.get("rangeBytes", 8 << 20)))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        found: list[InputPartition] = []
        for folder in self.folders:
            store, root = fs.FileSystem.from_uri(folder)
            for info in sorted(store.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
                if info.path.endswith(".tar"):
                    found += [Range(f"{folder.rstrip('/')}/{info.base_name}", at, at + self.span) for at in range(0, info.size, self.span)]
        return found or [Range(None)]

    def _member(self, store, path: str, stream, at: int):
        """(name, bytes) of the member at an offset; another try opens the archive anew."""
        for left in reversed(range(self.tries)):
            try:
                stream = stream or store.open_input_file(path)
                stream.seek(at)
                info = tarfile.TarInfo.frombuf(stream.read(512), "utf-8", "strict")
                media = stream.read(info.size)
                if len(media) != info.size:
                    raise OSError(f"{path} ends within the member at {at}")
                return stream, info.name, media
            except (OSError, tarfile.TarError):
                if not left:
                    raise
                stream = None
        raise AssertionError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        from pyarrow import fs

        if partition.path is None:
            return
        store, path = fs.FileSystem.from_uri(partition.path)
        with store.open_input_stream(f"{path}.idx") as f:
            offsets = json.loads(f.read())
        stream, rows, size = None, [], 0
        for at in offsets[bisect_left(offsets, partition.start) : bisect_left(offsets, partition.stop)]:
            stream, name, media = self._member(store, path, stream, at)
            own, n, _ = name.split(".")
            rows.append((None if own == "none" else int(own), int(n), media))
            size += len(media)
            if size > 4 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "media"])


class MediaSource(DataSource):
    """``spark.read.format("quarry_media").load(folder)``; several folders are joined by commas. Options: rangeBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "quarry_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def describe(media: DataFrame) -> DataFrame:
    """The payload's digests and features, from the stored bytes."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, stored in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = decode(stored)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(told, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """Stores every text, reads the archives back and describes each member."""
    spark = docs.sparkSession
    write_archives(docs, folder := shared_dir(spark, "media"))
    spark.dataSource.register(MediaSource)
    return describe(spark.read.format("quarry_media").option("rangeBytes", range_bytes).load(folder))
