"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII white space at its ends and with A-Z
lowered; keys of at least ``MIN_LENGTH`` code points count.  A key found in at
least ``MIN_DOCUMENTS`` documents is frequent: all its lines go, except in the
document of the largest id that holds it.

``LineIndex`` keeps a log of references (key digest, doc id, +1 for an
insertion or -1 for a deletion of the document), an exact reference-count
table of all keys (digest, count, largest id) and a cuckoo filter a shard.
``commit`` sums what was logged since the last one and merges it into the
shards that it touches; the others keep their files.  The log is read again
only for keys that lost the document that kept them.  A shard's filter file
holds the filter, then the sorted digests of its frequent keys with their
counts and keeping ids; the filter of the version before is changed key by
key, so taking documents out again restores the former decisions.  Shards
double when references outgrow ``SHARD_REFERENCES`` each, which rewrites all
of them.  Each version's state is one small file, written last, so an index is
opened again from its folder by another driver.  A lookup deals references to
their shards (salted by document, so a line that a third of all documents share
is spread), asks the filter, and confirms what passes in the exact table.

Keys are compared by 128-bit BLAKE2 digests.  Defined results: a null or empty
text is one empty line, which stays (a null becomes empty text).  Rows that
share an id each count as a document, and all of them keep the lines of the
largest id.  Null ids are never the largest; a key that only null ids hold
stays.  A text of any length is split whole, its lines held by its task.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_names, map_batches, map_file, materialise, run_folder, whole_text, write_file

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
SHARD_REFERENCES = 250_000
SALTS = 32
#: Shards that a lookup task keeps open, and references it holds to sort.
OPEN_SHARDS = 16
_SPACE = b" \t\n\r\x0b\x0c"
_ENTRY = np.dtype([("digest", "S16"), ("n", "<i8"), ("keep", "<i8"), ("has_keep", "<i8")])


def key_digest(line: bytes, min_length: int = MIN_LENGTH) -> bytes | None:
    """A line's key as a digest, None for a short key."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_length or len(key) < 4 * min_length and len(key.decode()) < min_length:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Fingerprints of 16 bits, four a bucket, two buckets a key."""

    SLOTS = 4
    KICKS = 500

    def __init__(self, buckets: int):
        self.table = np.zeros((1 << max(0, buckets - 1).bit_length(), self.SLOTS), np.uint16)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(int(keys / (cls.SLOTS * 0.8)) + 2)

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.frombuffer(digests.tobytes(), "<u4").reshape(-1, 4)
        marks = (words[:, 0] % 65535 + 1).astype(np.uint16)
        mask = np.uint32(len(self.table) - 1)
        first = words[:, 1] & mask
        return marks, first, first ^ (self._step(marks) & mask)

    @staticmethod
    def _step(marks):
        return (marks.astype(np.uint32) * np.uint32(0x5BD1E995)) >> np.uint32(7)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        marks, first, second = self._places(digests)
        return ((self.table[first] == marks[:, None]) | (self.table[second] == marks[:, None])).any(axis=1)

    def insert(self, digests: np.ndarray) -> bool:
        """Add distinct keys; False when one found no place (grow, then refill)."""
        mask = len(self.table) - 1
        table = self.table
        for number, (mark, first, second) in enumerate(zip(*(x.tolist() for x in self._places(digests)), strict=True)):
            for place in (first, second):
                free = np.flatnonzero(table[place] == 0)
                if len(free):
                    table[place, free[0]] = mark
                    break
            else:
                place = second if number & 1 else first
                for kick in range(self.KICKS):
                    slot = (number + kick) % self.SLOTS
                    mark, table[place, slot] = int(table[place, slot]), mark
                    place ^= (mark * 0x5BD1E995 & 0xFFFFFFFF) >> 7 & mask
                    free = np.flatnonzero(table[place] == 0)
                    if len(free):
                        table[place, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, digests: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for mark, first, second in zip(*(x.tolist() for x in self._places(digests)), strict=True):
            for place in (first, second):
                held = np.flatnonzero(self.table[place] == mark)
                if len(held):
                    self.table[place, held[0]] = 0
                    break
            else:
                raise KeyError("a key that was never inserted")

    def to_bytes(self) -> bytes:
        return struct.pack("<q", len(self.table)) + self.table.tobytes()

    @classmethod
    def from_buffer(cls, raw) -> tuple[CuckooFilter, int]:
        """The filter at the start of a buffer, and where it ends."""
        (buckets,) = struct.unpack_from("<q", raw)
        found = cls.__new__(cls)
        found.table = np.frombuffer(raw, np.uint16, buckets * cls.SLOTS, 8).reshape(-1, cls.SLOTS)
        return found, 8 + buckets * cls.SLOTS * 2


class Shard:
    """A filter and the exact table behind it."""

    def __init__(self, table: CuckooFilter, entries: np.ndarray):
        self.filter, self.entries = table, entries

    @classmethod
    def build(cls, entries: np.ndarray, before: Shard | None = None) -> Shard:
        """From sorted entries, changing the filter of the version before."""
        if before is not None:
            old, new = before.entries["digest"], entries["digest"]
            table = CuckooFilter.__new__(CuckooFilter)
            table.table = before.filter.table.copy()
            table.delete(old[~np.isin(old, new)])
            if len(entries) <= table.table.size * 0.9 and table.insert(new[~np.isin(new, old)]):
                return cls(table, entries)
        size = len(entries)
        while not (table := CuckooFilter.sized(size)).insert(entries["digest"]):
            size = size * 2 + 8
        return cls(table, entries)

    @classmethod
    def load(cls, uri: str) -> Shard:
        raw = map_file(uri)
        table, end = CuckooFilter.from_buffer(raw)
        return cls(table, np.frombuffer(raw, _ENTRY, offset=end))

    def write(self, uri: str) -> None:
        write_file(uri, iter([self.filter.to_bytes(), self.entries.tobytes()]))

    def keepers(self, digests: np.ndarray) -> np.ndarray:
        """Positions in the exact table, -1 for keys that aren't frequent."""
        out = np.full(len(digests), -1, np.int64)
        maybe = np.flatnonzero(self.filter.contains(digests)) if len(self.entries) else []
        if len(maybe):
            at = np.searchsorted(self.entries["digest"], digests[maybe]).clip(max=len(self.entries) - 1)
            out[maybe] = np.where(self.entries["digest"][at] == digests[maybe], at, -1)
        return out


def _padded(digests: list[bytes]) -> np.ndarray:
    # numpy's S16 drops trailing zero bytes when it compares, which orders and equates fixed-length digests rightly.
    return np.array(digests, dtype="S16")


class LineIndex:
    """The index in a shared folder; one writer at a time.

    A folder that holds an index is opened as its last commit left it.
    """

    def __init__(self, spark: SparkSession, folder: str, min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH):
        self.spark, self.folder = spark, folder
        self.pending: list[tuple[str, int]] = []  # logged since the last commit: name, sign
        self.state = {"version": 0, "bits": 0, "references": 0, "min_documents": min_documents, "min_length": min_length, "log": [], "counts": {}, "filters": {}}
        versions = [int(m[1]) for name in list_names(spark, folder) if (m := re.fullmatch(r"state-(\d+)\.json", name))]
        if versions:
            self.state = json.loads(bytes(map_file(f"{folder}/state-{max(versions)}.json")))
        self.min_documents, self.min_length = self.state["min_documents"], self.state["min_length"]

    def references(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, digest) of the distinct keys of each row."""
        shortest = self.min_length

        def work(batches: Iterator[dict]) -> Iterator[dict]:
            for batch in batches:
                out: dict = {"doc_id": [], "digest": []}
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    keys = {key_digest(line, shortest) for line in text.encode().split(b"\n")} - {None}
                    out["doc_id"] += [doc_id] * len(keys)
                    out["digest"] += keys
                yield out

        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
        return map_batches(rows, work, "doc_id long, digest binary")

    def insert(self, docs: DataFrame, **columns: str) -> DataFrame:
        """Log the documents' references; returns the logged table."""
        return self._log(docs, 1, columns)

    def delete(self, docs: DataFrame, **columns: str) -> DataFrame:
        """Take back documents that were inserted, with the same texts."""
        return self._log(docs, -1, columns)

    def _log(self, docs: DataFrame, sign: int, columns: dict) -> DataFrame:
        name = f"references-{uuid.uuid4().hex}"
        logged = materialise(self.references(docs, **columns), self.folder, name)
        self.pending.append((name, sign))
        return logged

    def _read_log(self, names: list[tuple[str, int]]) -> DataFrame:
        logs = [self.spark.read.schema("doc_id long, digest binary").parquet(f"{self.folder}/{name}").withColumn("sign", F.lit(sign)) for name, sign in names]
        return reduce(DataFrame.unionAll, logs)

    def counts(self, shards: list[int] | None = None) -> DataFrame:
        """The exact table (digest, n, keep, shard) of some shards, or all."""
        kinds = "digest binary, n long, keep long"
        own = {k: v for k, v in self.state["counts"].items() if shards is None or int(k) in shards}
        parts = [self.spark.createDataFrame([], kinds + ", shard int")]
        for version in sorted(set(own.values())):
            table = self.spark.read.schema(kinds + ", shard int").parquet(f"{self.folder}/counts-{version}")
            parts.append(table.where(F.col("shard").isin([int(k) for k, v in own.items() if v == version])))
        return reduce(DataFrame.unionAll, parts)

    def commit(self) -> None:
        """Merge what was logged into the shards that it touches."""
        if not self.pending:
            return
        state = json.loads(json.dumps(self.state))
        version = state["version"] = state["version"] + 1
        log = self._read_log(self.pending)
        state["references"] += log.count()
        bits = state["bits"]
        while state["references"] > SHARD_REFERENCES << bits:
            bits += 1
        split, state["bits"] = bits > state["bits"], bits
        change = log.groupBy("digest").agg(
            F.sum("sign").alias("dn"), F.max(F.when(F.col("sign") > 0, F.col("doc_id"))).alias("top"), F.max(F.when(F.col("sign") < 0, F.col("doc_id"))).alias("gone")
        )
        deleted = any(sign < 0 for _, sign in self.pending)
        if not state["counts"] and not deleted:
            merged = change.select("digest", F.col("dn").alias("n"), F.col("top").alias("keep"))
            touched = None
        else:
            change = materialise(change.withColumn("shard", _shard_of(bits)), self.folder, f"change-{version}")
            touched = None if split else sorted(r.shard for r in change.select("shard").distinct().collect())  # shards are a short list
            old = self.counts(touched).select("digest", "n", F.col("keep").alias("_keep"))
            both = old.join(change.drop("shard"), "digest", "full")
            lost = F.col("gone").isNotNull() & ((F.col("gone") >= F.col("_keep")) | F.col("_keep").isNull() | (F.col("gone") >= F.col("top")))
            both = both.select("digest", (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"), F.greatest("_keep", "top").alias("keep"), F.coalesce(lost, F.lit(False)).alias("_lost"))
            merged = materialise(both.where("n > 0"), self.folder, f"merged-{version}")
            if deleted:
                # Keys that may have lost the document that kept them: their references are summed anew.
                again = merged.where("_lost").select("digest")
                every = self._read_log([tuple(x) for x in state["log"]] + self.pending).join(again, "digest", "left_semi")
                held = every.groupBy("digest", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0").groupBy("digest").agg(F.max("doc_id").alias("_held"))
                merged = merged.join(held, "digest", "left").withColumn("keep", F.when(F.col("_lost"), F.col("_held")).otherwise(F.col("keep")))
            merged = merged.select("digest", "n", "keep")
        dealt = merged.withColumn("shard", _shard_of(bits))
        dealt.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{self.folder}/counts-{version}")
        written = self.spark.read.schema("digest binary, n long, keep long, shard int").parquet(f"{self.folder}/counts-{version}")
        shards = list(range(1 << bits)) if touched is None else touched
        before = {} if split else {int(k): v for k, v in state["filters"].items()}
        filled = self._write_filters(written.where(F.col("n") >= self.min_documents), shards, before, version)
        for k in shards:
            state["counts"][str(k)] = version
            state["filters"].pop(str(k), None)
        state["filters"] |= {str(k): version for k in filled}
        state["log"] += [list(x) for x in self.pending]
        write_file(f"{self.folder}/state-{version}.json", iter([json.dumps(state).encode()]))
        self.state, self.pending = state, []

    def _write_filters(self, frequent: DataFrame, shards: list[int], before: dict[int, int], version: int) -> list[int]:
        """Filter files of the shards that have frequent keys; returns those."""
        folder = self.folder
        dealt = frequent.repartition("shard").sortWithinPartitions("shard", "digest")

        def work(batches: Iterator[dict]) -> Iterator[dict]:
            held: list[tuple] = []
            own: int | None = None

            def flush() -> None:
                if own is not None:
                    entries = np.array(held, _ENTRY)
                    entries.sort(order="digest")
                    Shard.build(entries, _load(folder, before.get(own), own)).write(f"{folder}/filters-{version}/{own}")
                held.clear()

            found: list[int] = []
            for batch in batches:
                for shard, digest, n, keep in zip(batch["shard"], batch["digest"], batch["n"], batch["keep"], strict=True):
                    if shard != own:
                        flush()
                        own = shard
                        found.append(shard)
                    held.append((digest, n, keep or 0, keep is not None))
            flush()
            yield {"shard": found}

        # One row a shard.
        return sorted(r.shard for r in map_batches(dealt.select("shard", "digest", "n", "keep"), work, "shard int").collect())

    def drops(self, references: DataFrame) -> DataFrame:
        """(doc_id, digest) of the references whose lines go."""
        folder, bits = self.folder, self.state["bits"]
        versions = {int(k): v for k, v in self.state["filters"].items()}
        dealt = references.withColumn("shard", _shard_of(bits)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        dealt = dealt.repartition("shard", "salt")

        def work(batches: Iterator[dict]) -> Iterator[dict]:
            opened: dict[int, Shard | None] = {}
            for batch in batches:
                out: dict = {"doc_id": [], "digest": []}
                digests = _padded(batch["digest"])
                shard_of = np.array(batch["shard"])
                for number in np.unique(shard_of).tolist():
                    if number not in opened:
                        if len(opened) >= OPEN_SHARDS:
                            opened.pop(next(iter(opened)))
                        opened[number] = _load(folder, versions.get(number), number)
                    if (shard := opened[number]) is None:
                        continue
                    rows = np.flatnonzero(shard_of == number)
                    at = shard.keepers(digests[rows])
                    for row, entry in zip(rows[at >= 0].tolist(), shard.entries[at[at >= 0]], strict=True):
                        if entry["has_keep"] and batch["doc_id"][row] != entry["keep"]:
                            out["doc_id"].append(batch["doc_id"][row])
                            out["digest"].append(batch["digest"][row])
                yield out

        return map_batches(dealt.select("doc_id", "digest", "shard"), work, "doc_id long, digest binary")

    def apply(self, docs: DataFrame, references: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(row, n_lines, n_dropped, kept_text): each row as a struct, and its lines."""
        shortest = self.min_length
        own = self.drops(references).groupBy("doc_id").agg(F.collect_set("digest").alias("gone"))
        whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        joined = whole.join(own, F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("doc_id")), "left")

        @F.pandas_udf("n_lines long, n_dropped long, kept_text string")
        def kept(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
            rows = [keep_lines(t, drop, shortest) for t, drop in zip(texts, drops, strict=True)]
            return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_text"])

        return joined.select("row", kept(whole_text(f"row.`{text_col}`"), F.col("gone")).alias("kept")).select("row", "kept.*")


def keep_lines(text: str, drop, min_length: int = MIN_LENGTH) -> tuple[int, int, str]:
    """(lines, lines dropped, what stays) of a text and its digests to drop."""
    if drop is None or len(drop) == 0:
        return text.count("\n") + 1, 0, text
    gone = set(map(bytes, drop))
    lines = text.encode().split(b"\n")
    stay = [line for line in lines if key_digest(line, min_length) not in gone]
    return len(lines), len(lines) - len(stay), b"\n".join(stay).decode()


def _shard_of(bits: int):
    return F.pmod(F.xxhash64("digest"), F.lit(1 << bits)).cast("int")


def _load(folder: str, version: int | None, shard: int) -> Shard | None:
    return None if version is None else Shard.load(f"{folder}/filters-{version}/{shard}")


def line_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One table against itself: insert all, commit, apply."""
    index = LineIndex(spark, run_folder(spark, "lines"))
    references = index.insert(docs, id_col=id_col, text_col=text_col)
    index.commit()
    return index.apply(docs, references, id_col, text_col)


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The query's digest."""
    found = line_dedup(spark, docs.select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
