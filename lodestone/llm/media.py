"""Media columns: archives of images and a Spark data source over them.

``write_archives`` stores each payload as an 8-bit greyscale PNG of width 24,
one archive a task, with a directory of its members' offsets beside it.  The
data source ``media_archive`` plans byte-range partitions over the archives of
a folder from their sizes alone; a partition reads the members that begin in
its range in one stream, decodes them and passes on Arrow batches.  A member that
fails its checksum or whose read fails is read again by its offset, reopening
the file, without reading its neighbours anew.

A payload is a text's UTF-8 followed by bytes 255 up to a positive multiple of
576 (24 by 24 samples).

Defined results: null and empty texts give one block of 255s and 0 bytes.
Null ids stay null, repeated rows are members of their own, equal texts give
equal values, and an empty table gives no archive and an empty result.  A text
of any length is one member, held whole by its task.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import map_batches, map_file, open_random, run_folder, whole_text, write_file

WIDTH = 24
BLOCK = WIDTH * WIDTH
FILL = b"\xff"
#: Planned bytes of archive a partition, payload bytes a batch, reads a member.
RANGE_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
_DIRECTORY = np.dtype([("offset", "<i8"), ("length", "<i8"), ("crc32", "<u4"), ("has_id", "<i4"), ("doc_id", "<i8"), ("n_bytes", "<i8")])
_PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload binary, feature string"


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + FILL * (-len(raw) % BLOCK if raw else BLOCK)


def encode_png(payload: bytes) -> bytes:
    """Greyscale, 8 bits, rows of 24 samples without a filter."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 1)), (b"IEND", b""))
    return _PNG + b"".join(struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data)) for name, data in parts)


def decode_png(media: bytes) -> np.ndarray:
    """Samples, rows by 24; any damage raises ValueError."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, shape, data = 8, None, []
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        name, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a damaged chunk")
        if name == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif name == b"IDAT":
            data.append(body)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation, entropy and an 8 by 8 average hash of the samples."""
    counts = np.bincount(samples.ravel(), minlength=256).astype(np.float64)
    share = counts / counts.sum()
    levels = np.arange(256)
    mean = float(share @ levels)
    deviation = float(np.sqrt(max(0.0, share @ (levels - mean) ** 2)))
    used = share[share > 0]
    grid = samples.reshape(8, -1, 8, WIDTH // 8).sum(axis=(1, 3), dtype=np.int64)
    bits = np.packbits(grid * 64 > grid.sum())
    return f"mean={mean:.4f};dev={deviation:.4f};entropy={abs(float(-(used * np.log2(used)).sum())):.4f};ahash={bits.tobytes().hex()}"


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """One archive and directory a task; the folder's list is written last."""

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        name = uuid.uuid4().hex
        directory: list[tuple] = []
        size = 0

        def members() -> Iterator[bytes]:
            nonlocal size
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    media = encode_png(payload_of(text))
                    directory.append((size, len(media), zlib.crc32(media), doc_id is not None, doc_id or 0, len(text.encode())))
                    size += len(media)
                    yield media

        first = next(rest := members(), None)
        if first is None:
            return
        write_file(f"{folder}/{name}.media", _with_first(first, rest))
        write_file(f"{folder}/{name}.dir", iter([np.array(directory, _DIRECTORY).tobytes()]))
        yield {"name": [name], "size": [size]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    # One row an archive; an attempt that was lost leaves files that the list doesn't name.
    archives = [tuple(r) for r in map_batches(rows, work, "name string, size long").collect()]
    write_file(f"{folder}/archives.json", iter([json.dumps(sorted(archives)).encode()]))


def _with_first(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


@dataclass
class ByteRange(InputPartition):
    """Members of one archive that begin in [start, end)."""

    archive: str
    start: int
    end: int


def read_member(archive: str, offset: int, length: int, crc32: int, open_file=open_random, wait: float = 0.2) -> tuple[bytes, np.ndarray]:
    """One member's media and samples; tried again by offset on any failure."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            with open_file(archive) as file:
                file.seek(offset)
                media = file.read(length)
            if len(media) != length or zlib.crc32(media) != crc32:
                raise ValueError(f"member at {offset} of {archive} is damaged")
            return media, decode_png(media)
        except (OSError, ValueError, zlib.error, struct.error):
            if attempt == ATTEMPTS:
                raise
            time.sleep(wait * attempt)
    raise AssertionError


def read_members(archive: str, members: list[tuple[int, int, int]], open_file=open_random, wait: float = 0.2) -> Iterator[tuple[bytes, np.ndarray]]:
    """Members (offset, length, crc32) that follow each other, from one stream.

    A member that is damaged, or at which the stream fails, is read again alone
    by its offset; the stream goes on with the next one.
    """
    file = None
    try:
        for offset, length, crc32 in members:
            try:
                if file is None:
                    file = open_file(archive)
                    file.seek(offset)
                media = file.read(length)
                if len(media) != length or zlib.crc32(media) != crc32:
                    raise ValueError("damaged")
                found = media, decode_png(media)
            except (OSError, ValueError, zlib.error, struct.error):
                if file is not None:
                    with contextlib.suppress(OSError):
                        file.close()
                    file = None
                found = read_member(archive, offset, length, crc32, open_file, wait)
            yield found
    finally:
        if file is not None:
            file.close()


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        archives = json.loads(bytes(map_file(f"{self.folder}/archives.json")))
        step = self.range_bytes
        planned = [ByteRange(f"{self.folder}/{name}", at, at + step) for name, size in archives for at in range(0, size, step)]
        return planned or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        directory = np.frombuffer(map_file(f"{partition.archive}.dir"), _DIRECTORY)
        low, high = np.searchsorted(directory["offset"], (partition.start, partition.end))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []
        held = 0
        members = directory[low:high].tolist()
        for member, (media, samples) in zip(members, read_members(f"{partition.archive}.media", [m[:3] for m in members]), strict=True):
            _, length, _, has_id, doc_id, n_bytes = member
            rows.append((doc_id if has_id else None, n_bytes, length, hashlib.sha256(media).hexdigest(), samples.tobytes(), feature_of(samples)))
            held += samples.size
            if held >= BATCH_BYTES:
                yield _batch(names, rows)
                rows, held = [], 0
        if rows:
            yield _batch(names, rows)


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:  # noqa: ARG002
        return MediaReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(folder)


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The query's digest of the payloads that were read back."""
    folder = run_folder(spark, "media")
    write_archives(docs, folder)
    media = read_archives(spark, folder)
    return media.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
