"""Token-id output: flat unsigned files with 64-bit offsets, memory-mapped.

A shard is three files: ``.bin`` holds the ids of its documents in ascending
id order (16 bits while the vocabulary allows it, else 32), ``.idx`` the
64-bit offset of each document and the end, ``.doc`` their 64-bit doc ids.
Shards follow each other in id order; a shard's base, the ids before it, is
the prefix sum over the shards' totals.  A task begins a new shard after
``SHARD_TOKENS`` ids or ``SHARD_DOCUMENTS`` documents, so a shard's size (and
what a task holds of it) doesn't grow with the table.  Only the shard list
(one small row a shard) reaches the driver.  A run of a task writes files of
its own names and lists them when they are whole.

Defined results: null or empty texts are documents of the end id alone.  Rows
that repeat an id are separate documents side by side, by their partition and
text, and may lie in several ranges; null ids are refused, since the files
have no place for them.  A text of any length is one document of one shard,
held whole by its task.  An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, map_file, run_folder, whole_text, write_file
from .tokens import ChunkEncoder, default_vocabulary, encoder

#: Ids and documents after which a shard ends.
SHARD_TOKENS, SHARD_DOCUMENTS = 1 << 26, 1 << 20

@dataclass(frozen=True)
class Shard:
    """One shard: its files' common name, base and size."""

    name: str
    first_doc: int
    base: int
    documents: int
    tokens: int
    width: int


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> list[Shard]:
    """Encode whole texts and write them as shards; returns their list."""
    path = vocabulary or default_vocabulary()
    ordered = docs.select(
        F.when(F.col(id_col).isNull(), F.raise_error(F.lit("a document without an id"))).otherwise(F.col(id_col)).cast("long").alias("doc_id"),
        whole_text(text_col).cast("binary").alias("text"),
        F.spark_partition_id().alias("_part"),  # splits the rows of one id
    )
    ordered = ordered.repartitionByRange("doc_id", "_part").sortWithinPartitions("doc_id", "_part", "text").select("doc_id", "text")

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        own = encoder(path)
        tail = np.array([end_id], dtype=own.dtype).tobytes()
        part = TaskContext.get().partitionId()
        rows = _documents(batches, own, tail)
        shard = 0
        while (first := next(rows, None)) is not None:
            name = f"{folder}/{uuid.uuid4().hex}"
            doc_ids: list[int] = []
            ends: list[int] = []
            write_file(f"{name}.bin", _shard_body(first, rows, own.dtype.itemsize, shard_tokens, doc_ids, ends))
            write_file(f"{name}.idx", iter([np.array([0, *ends], dtype="<i8").tobytes()]))
            write_file(f"{name}.doc", iter([np.array(doc_ids, dtype="<i8").tobytes()]))
            yield {"part": [part], "shard": [shard], "name": [name], "first_doc": [doc_ids[0]], "documents": [len(doc_ids)], "tokens": [ends[-1]], "width": [own.dtype.itemsize]}
            shard += 1

    # One row a shard of ``SHARD_TOKENS`` ids, or a task.
    rows = map_batches(ordered, work, "part int, shard int, name string, first_doc long, documents long, tokens long, width int").collect()
    shards, base = [], 0
    for row in sorted(rows, key=lambda r: (r.part, r.shard)):
        shards.append(Shard(row["name"], row.first_doc, base, row.documents, row.tokens, row.width))
        base += row.tokens
    return shards


def _documents(batches: Iterator[dict], own: ChunkEncoder, tail: bytes) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for doc_id, found in zip(batch["doc_id"], own.encode(batch["text"]), strict=True):
            yield doc_id, found + tail


def _shard_body(first: tuple[int, bytes], rest: Iterator[tuple[int, bytes]], width: int, most: int, doc_ids: list[int], ends: list[int]) -> Iterator[bytes]:
    """A shard's ids; notes its documents and where each ends."""
    row: tuple[int, bytes] | None = first
    end = 0
    while row is not None:
        doc_ids.append(row[0])
        ends.append(end := end + len(row[1]) // width)
        yield row[1]
        row = next(rest, None) if end < most and len(ends) < SHARD_DOCUMENTS else None


def read_shard(shard: Shard) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc id, start over all shards, ids) of each document, memory-mapped."""
    ids = np.frombuffer(map_file(f"{shard.name}.bin"), dtype=f"<u{shard.width}")
    offsets = np.frombuffer(map_file(f"{shard.name}.idx"), dtype="<i8")
    doc_ids = np.frombuffer(map_file(f"{shard.name}.doc"), dtype="<i8")
    for doc_id, start, end in zip(doc_ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield doc_id, shard.base + start, ids[start:end]


def token_file_rows(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    listed = spark.createDataFrame(
        [(s.name, s.first_doc, s.base, s.documents, s.tokens, s.width) for s in shards],
        "name string, first_doc long, base long, documents long, tokens long, width int",
    ).repartition(max(1, len(shards)))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for row in zip(*(batch[k] for k in ("name", "first_doc", "base", "documents", "tokens", "width")), strict=True):
                out: dict = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc_id, start, ids in read_shard(Shard(*row)):
                    for key, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        out[key].append(value)
                    if len(out["start"]) >= 20_000:
                        yield out
                        out = {k: [] for k in out}
                yield out

    return map_batches(listed, work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The query's digest: encode, write, read the files back."""
    return token_file_rows(spark, write_token_files(docs, run_folder(spark, "tokens")))
