"""The query log as a table: batches added once, numbered rows, upkeep by part.

A record (as of the index: numbered, written last, never overwritten) lists
the log's parts, the next free id, and for each writer the number of its last
batch.  A batch is known by its writer and number, numbers ascend, and one
that the record has already seen adds nothing; so a stream's repeated
micro-batch and a batch job's second try are both harmless.  Rows of a batch
are numbered on from the last id, in order of time.  A part's record carries
its span of time and how many rows hold contents, so retention reads only
parts that the limit cuts through, scrubbing only those that hold something,
and counts need no scan.  A writer that stops leaves the last record in force;
of two writers the later one takes its numbers again.  ``index.remove_old``
clears parts that no record names.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prefix, usage
from ..session import run_folder
from .index import ROWS_A_FILE, read_record, write_record
from .journal import remove

#: Tries of a change that another writer was before.
TRIES = 10
#: Parts of less than a file's rows from which an append writes them together.
SMALL_PARTS = 16
EMPTY = {"number": 0, "next": 1, "writers": {}, "parts": []}
HELD = "coalesce(content_logged, 0) <> 0 OR coalesce(raw_output_logged, 0) <> 0"


def new_name(what: str) -> str:
    return f"{what}-{uuid.uuid4().hex}"


def _record(spark: SparkSession, folder: str) -> dict:
    return {**EMPTY, **read_record(spark, folder)}


def _change(spark: SparkSession, folder: str, make: Callable[[dict], dict | None]) -> dict:
    """The record after ``make`` (old to new, None for no change), made again when another writer was first."""
    for left in reversed(range(TRIES)):
        record = _record(spark, folder)
        new = make(record)
        if new is None:
            return record
        new = {**record, **new, "number": record["number"] + 1, "at": int(time.time())}
        try:
            write_record(spark, folder, new)
            return new
        except OSError:
            if not left or _record(spark, folder)["number"] == record["number"]:
                raise
    raise AssertionError("not reached")


def _part(rows: DataFrame, n: int, folder: str, what: str) -> dict:
    """Rows written as a part, and what the record says of it. A row without a moment makes the span open at its start."""
    name = new_name(what)
    (rows.repartition(1) if n <= ROWS_A_FILE else rows).write.parquet(f"{folder}/{name}")
    t = F.col("timestamp")
    span = F.when(F.count(t) == F.count(F.lit(1)), F.min(t)).alias("first")
    found = rows.sparkSession.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("rows"), span, F.max(t).alias("last"), F.count_if(F.expr(HELD)).alias("held"))
    return {"name": name, **found.first().asDict()}


def read_log(spark: SparkSession, folder: str, since: float | None = None) -> DataFrame:
    """The log's rows, those from ``since`` on if it is given: parts that ended before it aren't opened."""
    parts = [p for p in _record(spark, folder)["parts"] if since is None or (p["last"] is not None and p["last"] >= since)]
    rows = spark.read.parquet(*(f"{folder}/{p['name']}" for p in parts)) if parts else spark.createDataFrame([], usage.LOG_SCHEMA)
    return rows if since is None else rows.where(F.col("timestamp") >= since)


def append(rows: DataFrame, folder: str, writer: str, batch: int) -> int:
    """Add a batch of rows (the log's columns) unless it is there; returns how many were added.

    Rows are dealt over ranges of time and written once as they are; ids are
    then the next free one, what the ranges before hold, and the place within
    the range. An ``id`` that rows bring orders those of one moment, which
    otherwise follow each other in any order, and is replaced.
    """
    spark = rows.sparkSession
    if batch <= _record(spark, folder)["writers"].get(writer, -1):
        return 0
    staged = run_folder(spark, "log")
    order = ["timestamp", "id" if "id" in rows.columns else F.xxhash64("question_hmac", "answer", "latency_ms")]
    ordered = usage.migrate(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    # The row's range in the upper bits, its place there in the lower 33.
    ordered.withColumn("_at", F.monotonically_increasing_id()).write.parquet(staged)
    dealt = spark.read.parquet(staged).withColumn("_range", F.shiftright("_at", 33))
    sized = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    n = dealt.count()
    added = 0

    def make(record: dict) -> dict | None:
        nonlocal added
        if batch <= record["writers"].get(writer, -1):
            added = 0
            return None
        added, writers = n, {**record["writers"], writer: batch}
        if not n:
            return {"writers": writers}
        number = F.lit(record["next"]) + F.col("base") + F.col("_at").bitwiseAND((1 << 33) - 1)
        numbered = dealt.join(prefix.bases(sized, [], "_range", "n").select("_range", "base"), "_range").withColumn("id", number)
        columns = spark.createDataFrame([], usage.LOG_SCHEMA).columns
        parts = [*record["parts"], _part(numbered.select(columns), n, folder, "added")]
        return {"writers": writers, "next": record["next"] + n, "parts": _together(spark, folder, parts)}

    _change(spark, folder, make)
    remove(spark, staged)
    return added


def _together(spark: SparkSession, folder: str, parts: list[dict]) -> list[dict]:
    """Many small parts as one; large ones stay."""
    small = [p for p in parts if p["rows"] < ROWS_A_FILE]
    if len(small) < SMALL_PARTS:
        return parts
    rows = spark.read.parquet(*(f"{folder}/{p['name']}" for p in small))
    return [*(p for p in parts if p["rows"] >= ROWS_A_FILE), _part(rows, sum(p["rows"] for p in small), folder, "whole")]


def purge_expired(spark: SparkSession, folder: str, now: float, days: int = 30) -> int:
    """Remove what ``usage.retain`` doesn't keep; returns how many rows. Ids aren't given again."""
    limit = now - days * usage.DAY
    removed = 0

    def make(record: dict) -> dict | None:
        nonlocal removed
        kept = []
        for part in record["parts"]:
            if part["first"] is not None and part["first"] >= limit:
                kept.append(part)
            elif part["last"] is not None and part["last"] >= limit:
                rows = usage.retain(spark.read.parquet(f"{folder}/{part['name']}"), now, days)
                kept.append(_part(rows, part["rows"], folder, "whole"))
        removed = sum(p["rows"] for p in record["parts"]) - sum(p["rows"] for p in kept)
        return {"parts": kept} if removed else None

    _change(spark, folder, make)
    return removed


def scrub_content(spark: SparkSession, folder: str, dry_run: bool = False) -> int:
    """Contents out of the rows that hold any; returns how many do, from the record alone on a dry run."""
    n = sum(p["held"] for p in _record(spark, folder)["parts"])
    if dry_run or not n:
        return n

    def make(record: dict) -> dict | None:
        nonlocal n
        n = sum(p["held"] for p in record["parts"])
        scrubbed = lambda p: _part(usage.scrub(spark.read.parquet(f"{folder}/{p['name']}")), p["rows"], folder, "whole")
        return {"parts": [scrubbed(p) if p["held"] else p for p in record["parts"]]} if n else None

    _change(spark, folder, make)
    return n
