"""The chunk index: a table of added rows and deleted ids, switched by a build record written last.

A version is the list of its parts.  ``added-n-*`` holds the rows that version
n brought, ``gone-n-*`` the ids that it took away; a row of part n is read
unless a later part took its id away.  An update writes what changed and no
more: small changes are one small file each.  Once deleted rows are more than
``GONE_SHARE`` of all, or parts more than ``MOST_PARTS``, the update that finds
so writes the living rows together as its one part.  Versions and parts that no
record names are removed by ``remove_old`` after a grace, so readers of an old
version finish.  A writer that stops at any step leaves the last version in
force, and parts that ``remove_old`` clears; one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indexing import check_ids, index_diff

RECORD = r"build-\d+\.json"
#: From which a version's living rows are written together again.
GONE_SHARE, MOST_PARTS = 0.25, 16
#: Rows that are written as one file, whatever tasks they came from.
ROWS_A_FILE = 100_000
#: Words of 64 cells that are broadcast at most, to tell rows to be added where they lie.
MOST_WORDS = 1 << 19


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def fingerprint(digests: dict[str, str], settings: dict) -> str:
    """Of the files and every setting that shapes the index or an answer."""
    return hashlib.sha256(canonical({"files": digests, "settings": settings}).encode()).hexdigest()


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_record(spark: SparkSession, folder: str) -> dict:
    """The build record of the highest number that is whole; empty where there is none."""
    where, store = _file(spark, folder)
    if not store.exists(where):
        return {}
    names = [status.getPath().getName() for status in store.listStatus(where)]
    for name in sorted((n for n in names if re.fullmatch(RECORD, n)), key=lambda n: int(n.split("-")[1].split(".")[0]), reverse=True):
        text = "\n".join(r.value for r in spark.read.text(f"{folder}/{name}").collect())  # one small file
        try:
            found = json.loads(text)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return {}


def write_record(spark: SparkSession, folder: str, record: dict) -> None:
    """A new file of the record's number, renamed when whole: nothing is deleted, so some record is always in force."""
    number = int(record.get("number", 0))
    new, store = _file(spark, f"{folder}/.build-{number}.new")
    out = store.create(new, True)
    out.write(bytearray(canonical(record).encode()))
    out.close()
    final, _ = _file(spark, f"{folder}/build-{number}.json")
    if store.exists(final) or not store.rename(new, final):
        raise OSError(f"{final} could not be written: another writer was first, or the store refused")


def fields_of(mark: str | dict) -> dict[str, str]:
    """A fingerprint as fields; a plain one is its only field."""
    return {k: v if isinstance(v, str) else canonical(v) for k, v in mark.items()} if isinstance(mark, dict) else {"fingerprint": mark}


def _parts(spark: SparkSession, folder: str, record: dict, columns: list[str] | None = None, doc_ids: list[str] | None = None) -> DataFrame:
    """The living rows of a version, with the part ``_part`` that brought each."""
    rows = spark.read.parquet(*(f"{folder}/{p['name']}" for p in record["parts"]))
    rows = rows.where(F.col("doc_id").isin(doc_ids)) if doc_ids else rows
    rows = rows.select(*dict.fromkeys([*columns, "chunk_hash", "_part"])) if columns else rows
    if not record["gone"]:
        return rows
    gone = spark.read.parquet(*(f"{folder}/{p['name']}" for p in record["gone"])).groupBy("chunk_hash").agg(F.max("_part").alias("_gone"))
    held = rows.alias("r").join(gone.alias("g"), F.expr("r.chunk_hash = g.chunk_hash AND r._part < g._gone"), "left_anti")
    return held.select("r.*")


def read_index(spark: SparkSession, folder: str, columns: list[str] | None = None, doc_ids: list[str] | None = None) -> DataFrame:
    """The active version; columns and documents reach the scan. No or an empty list means all documents."""
    rows = _parts(spark, folder, read_record(spark, folder), columns, doc_ids)
    return rows.select(*columns) if columns else rows.drop("_part")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """The active version's rows with ``_part``, the number of the version that brought each."""
    return _parts(spark, folder, read_record(spark, folder))


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_hash, position, action) by which the active version came about: add, delete or keep."""
    return spark.read.parquet(f"{folder}/{read_record(spark, folder)['plan']}")


def _write(rows: DataFrame, n: int, folder: str, name: str) -> None:
    (rows.repartition(1) if n <= ROWS_A_FILE else rows).write.parquet(f"{folder}/{name}")


def _rows_of(chunks: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``chunks`` that ``ids`` (chunk_hash, position) names, all of which are there; ``n`` is about how many hashes there are.

    Rows fall into cells by a digest of hash and position. A cell with as many
    rows as ids holds no other rows, and one without ids none that are named, so
    both are settled where rows lie, by bits that are broadcast. Only rows of
    cells that hold named rows and others are shuffled, to be joined to the ids.
    """
    cell = F.pmod(F.xxhash64("chunk_hash", "position"), F.lit(64 * min(n // 4 + 1, MOST_WORDS))).alias("_cell")
    rows, ids = chunks.select("*", cell), ids.select("*", cell)
    cells = rows.select("_cell", F.lit(0).alias("_id")).unionAll(ids.select("_cell", F.lit(1))).groupBy("_cell").agg(F.sum("_id").alias("_ids"), F.sum(1 - F.col("_id")).alias("_rows"))
    one, word = "shiftleft(1L, CAST(_cell % 64 AS INT))", F.expr("_cell DIV 64").alias("_word")
    bits = cells.where("_ids > 0").groupBy(word).agg(F.expr(f"bit_or({one})").alias("_named"), F.expr(f"bit_or(IF(_rows > _ids, {one}, 0L))").alias("_mixed"))
    # 1: all rows of the cell are named, 2: some are. Every use reads the same columns, so bits are made once.
    state = F.expr("getbit(_named, CAST(_cell % 64 AS INT)) + getbit(_mixed, CAST(_cell % 64 AS INT))")
    of = lambda side, k: side.join(F.broadcast(bits), F.expr("_cell DIV 64 = _word")).where(state == k)
    # Ids are distinct. A semi join would be moved below the bits, to where all rows are.
    mixed = of(rows, 2).select(chunks.columns).join(of(ids, 2).select("chunk_hash", "position"), ["chunk_hash", "position"])
    return of(rows, 1).select(chunks.columns).unionAll(mixed.select(chunks.columns))


def rebuild(chunks: DataFrame, folder: str, embed: Callable[[DataFrame], DataFrame], mark: str | dict) -> dict:
    """Bring the index up to ``chunks`` (chunk_hash, position, ...); returns its record.

    Under the same fingerprint only new chunks are embedded and written, and
    ids that are no longer wanted are noted; under another one all are. Of the
    rows of one hash the last by ``position`` counts, which tells them apart.
    What is to do is settled on ids and positions and written first, so its
    size is known when whole rows meet it, mostly where they lie, and one table
    decides what is embedded, written and checked.
    """
    spark = chunks.sparkSession
    before, fields = read_record(spark, folder), fields_of(mark)
    number, run = int(before.get("number", 0)) + 1, uuid.uuid4().hex[:12]
    part = lambda what: f"{what}-{number}-{run}"
    same = before.get("fields") == fields
    wanted = chunks.groupBy("chunk_hash").agg(F.max("position").alias("position"))
    held = _parts(spark, folder, before, ["chunk_hash"]) if same else wanted.select("chunk_hash").limit(0)
    plan_path = f"{folder}/{part('plan')}"
    index_diff(wanted, held).join(wanted, "chunk_hash", "left").select("chunk_hash", "position", "action").write.parquet(plan_path)
    plan = spark.read.parquet(plan_path)
    n = {r.action: r.n for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    add, delete, keep = (n.get(action, 0) for action in ("add", "delete", "keep"))
    parts, gone = (list(before["parts"]), list(before["gone"])) if same else ([], [])
    if add or not parts:
        new = embed(_rows_of(chunks, plan.where("action = 'add'").select("chunk_hash", "position"), add + keep))
        _write(new.withColumn("_part", F.lit(number)), add, folder, part("added"))
        parts.append({"name": part("added"), "rows": add})
    if delete:
        _write(plan.where("action = 'delete'").select("chunk_hash", F.lit(number).alias("_part")), delete, folder, part("gone"))
        gone.append({"name": part("gone"), "rows": delete})
    record = {"fields": fields, "number": number, "count": add + keep, "at": int(time.time()), "plan": part("plan"), "parts": parts, "gone": gone}
    written = sum(p["rows"] for p in parts)
    if len(parts) + len(gone) > MOST_PARTS or sum(p["rows"] for p in gone) > GONE_SHARE * written:
        _write(_parts(spark, folder, record).withColumn("_part", F.lit(number)), record["count"], folder, part("whole"))
        record |= {"parts": [{"name": part("whole"), "rows": record["count"]}], "gone": []}
    living = _parts(spark, folder, record, ["chunk_hash"])
    check_ids(plan.where("action <> 'delete'"), living)
    if living.count() != record["count"]:
        raise ValueError("a chunk was written more than once: positions don't tell its rows apart")
    write_record(spark, folder, record)
    return record


def remove_old(spark: SparkSession, folder: str, grace: float = 86_400.0, now: float | None = None) -> list[str]:
    """Remove records older than ``grace`` seconds but for the newest whole one, then parts that no record names and that are as old; returns the names."""
    now = time.time() if now is None else now
    where, store = _file(spark, folder)
    if not store.exists(where):
        return []
    files = {s.getPath().getName(): (s.getPath(), s.getModificationTime() / 1000) for s in store.listStatus(where)}
    current = read_record(spark, folder)
    known, removed = [current], []
    for name, (path, _) in files.items():
        if not re.fullmatch(RECORD, name):
            continue
        text = "\n".join(r.value for r in spark.read.text(f"{folder}/{name}").collect())
        try:
            record = json.loads(text)
        except ValueError:
            continue
        if record.get("number") != current.get("number") and record.get("at", 0) < now - grace:
            store.delete(path, False)
            removed.append(name)
        else:
            known.append(record)
    named = {p["name"] for r in known for p in [*r.get("parts", []), *r.get("gone", [])]} | {r.get("plan") for r in known}
    for name, (path, at) in files.items():
        if re.match(r"(added|gone|whole|plan)-", name) and name not in named and at < now - grace:
            store.delete(path, True)
            removed.append(name)
    return sorted(removed)


def assert_compatible(spark: SparkSession, folder: str, mark: str | dict) -> None:
    """Fails unless the index was built under this fingerprint and is whole; names the fields that differ."""
    record, fields = read_record(spark, folder), fields_of(mark)
    built = record.get("fields", {})
    wrong = sorted(k for k in built.keys() | fields.keys() if built.get(k) != fields.get(k))
    if wrong:
        raise ValueError(f"the index was built under other settings: {', '.join(wrong)}")
    if read_index(spark, folder, ["chunk_hash"]).count() != record.get("count"):
        raise ValueError("the index isn't complete")
