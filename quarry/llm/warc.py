"""WARC archives as seekable Zstandard bundles.

Each task writes one bundle: records gathered into independent Zstandard frames, then a seek table in a skippable frame
at the end (the public "seekable format"). The index maps a record's identifier to its bundle, frame number and offset
in the decompressed frame; a reader takes the frame's place from the footer, so it fetches only the frames it needs.
A bundle gets its final name only when complete, and a repeated task writes a bundle of its own: the index, written
once by Spark, names the complete ones.

Records with equal payloads of at least ``min_bytes`` bytes: that with the largest page_id is a response, the others
are revisits of it. Only (page_id, digest) pairs are grouped; the payloads are dealt out by page_id, never by digest,
so a group of copies of any size is spread evenly.

Defined results: a null html is an empty payload; a null page_id is carried, and never chosen as the response unless
the whole group has none (then all are responses); repeated rows with the largest page_id are all responses; an empty
table writes no bundle and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_limits, narrow, shared_dir, spool

#: Fixed values of the public seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX_SCHEMA = "page_id long, bundle string, frame int, at int, length int"
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    own = name.removeprefix("<urn:page:").removesuffix(">")
    return None if own == "none" else int(own)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at a place, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    url = head.get("WARC-Target-URI")
    revisit = head["WARC-Type"] == "revisit"
    row = {
        "page_id": _id(head["WARC-Record-ID"]),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": head["WARC-Type"],
        "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(body),
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(body),
        "refers_to": _id(head["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else body,
    }
    if not revisit and f"sha1:{row['payload_digest']}" != head["WARC-Payload-Digest"]:
        raise ValueError(f"{row['page_id']}: the payload doesn't have its digest")
    return row, end + 4 + len(block) + 4


class Bundle:
    """Writes frames and the seek table. ``out`` is any binary stream."""

    def __init__(self, out, level: int = 3, frame_bytes: int = 256 << 10):
        import zstandard

        self.out, self.pack, self.frame_bytes = out, zstandard.ZstdCompressor(level=level).compress, frame_bytes
        self.pending: list[bytes] = []
        self.size, self.frames = 0, []

    def add(self, data: bytes) -> tuple[int, int]:
        """Adds a record; its frame number and offset in the frame."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self._flush()
        at = self.size
        self.pending.append(data)
        self.size += len(data)
        return len(self.frames), at

    def _flush(self) -> None:
        packed = self.pack(b"".join(self.pending))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.pending, self.size = [], 0

    def close(self) -> None:
        if self.pending:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))


def seek_table(stream, size: int) -> list[tuple[int, int]]:
    """(place, bytes) of each frame in a bundle, from its footer."""
    stream.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    stream.seek(size - 9 - 8 * count)
    frames, at = [], 0
    for packed, _ in struct.iter_unpack("<II", stream.read(8 * count)):
        frames.append((at, packed))
        at += packed
    return frames


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = 256 << 10) -> DataFrame:
    """Writes the bundles under folder; returns the index, already stored."""
    spark = pages.sparkSession
    arrow_limits(spark)
    rows = narrow(pages, "page_id", "url", "html").withColumn("html", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    keyed = rows.select("page_id", F.sha1("html").alias("sha"), F.length("html").alias("n"))
    largest = keyed.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").drop("copies")
    largest = spool(largest, "warc-largest")  # read again, both sides of the join are dealt out for it, so that Spark may split a digest with very many pages
    links = keyed.join(largest, "sha").where("not (page_id <=> first)").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.col("first").alias("refers_to")).distinct()
    told = rows.withColumn("sha", F.sha1("html")).join(links, F.expr("page_id <=> p and sha = s"), "left").select("page_id", "url", "html", "refers_to")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root)
        name = f"{uuid.uuid4().hex}.warc.zst"
        bundle, out = None, None
        for batch in batches:
            found = []
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bundle is None:
                    bundle = Bundle(out := fs.open_output_stream(f"{root}/{name}.part"), frame_bytes=frame_bytes)
                data = record(page_id, url, html, refers_to)
                found.append((page_id, name, *bundle.add(data), len(data)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["page_id", "bundle", "frame", "at", "length"])
        if bundle is not None:
            bundle.close()
            out.close()
            fs.move(f"{root}/{name}.part", f"{root}/{name}")

    return spool(told.mapInArrow(put, INDEX_SCHEMA), "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the index names, each frame fetched once by its place in the footer."""
    wanted = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("at")).alias("places"))  # as many as a frame holds

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = _open(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        tables: dict[str, list] = {}
        for batch in batches:
            for want in batch.to_pylist():
                path = f"{root}/{want['bundle']}"
                with fs.open_input_file(path) as f:
                    if path not in tables:
                        tables.clear()
                        tables[path] = seek_table(f, f.size())
                    place, size = tables[path][want["frame"]]
                    f.seek(place)
                    data = unpack(f.read(size))
                rows = [parse(data, at)[0] for at in want["places"]]
                if not payloads:
                    rows = [r | {"payload": None} for r in rows]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    return wanted.repartition("bundle", "frame").mapInArrow(get, RECORD_SCHEMA)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to a new folder of bundles and reads every record back."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read(write(pages, folder, **options), folder, payloads=False)
