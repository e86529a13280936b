"""The response cache as tables under one record, so that upkeep of all is one change.

The record (as of the index) names the folder of each recognised table's rows
and counts them; a change writes the tables that it touches and then one new
record, so readers see all of it or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage
from .index import ROWS_A_FILE
from .log import _change, _record, new_name

#: Tables that upkeep knows: the present one first, then those of older versions.
TABLES = ("response_cache_v2", "response_cache")
CACHE_SCHEMA = "question_hash string, answer string, citations string, refused int, model string, refusal_reason string, created_at double, expires_at double"


def _held(record: dict) -> dict[str, dict]:
    return record.get("tables", {})


def _written(rows: DataFrame, folder: str, name: str) -> dict:
    """A table's rows in a new folder, with their number and the first expiry."""
    spark, path = rows.sparkSession, new_name("added")
    rows.write.parquet(f"{folder}/{path}")
    first = F.min("expires_at").alias("first") if "expires_at" in rows.columns else F.lit(None).alias("first")
    found = spark.read.parquet(f"{folder}/{path}").agg(F.count(F.lit(1)).alias("rows"), first).first()
    if found["rows"] <= ROWS_A_FILE and spark.read.parquet(f"{folder}/{path}").inputFiles()[1:]:
        merged = new_name("whole")
        spark.read.parquet(f"{folder}/{path}").repartition(1).write.parquet(f"{folder}/{merged}")
        path = merged
    return {"name": path, "table": name, **found.asDict()}


def _with(record: dict, tables: dict[str, dict]) -> dict:
    """A record of these tables; ``parts`` keeps their folders from removal."""
    return {"tables": tables, "parts": list(tables.values())}


def read_table(spark: SparkSession, folder: str, name: str = TABLES[0]) -> DataFrame:
    """A table's entries, expired ones too; none where it doesn't exist."""
    held = _held(_record(spark, folder)).get(name)
    return spark.read.parquet(f"{folder}/{held['name']}") if held else spark.createDataFrame([], CACHE_SCHEMA)


def lookup(questions: DataFrame, folder: str, now: float) -> DataFrame:
    """The live entries of asked keys (question_hash); one at its expiry is dead."""
    keys = questions.select("question_hash").distinct()
    return usage.live(read_table(questions.sparkSession, folder), now).join(keys, "question_hash", "left_semi")


def put(entries: DataFrame, folder: str, now: float, name: str = TABLES[0], tie: str | None = None) -> None:
    """Replace the entries of these keys, the latest of each, and drop those that have expired by ``now``."""
    spark = entries.sparkSession

    def make(record: dict) -> dict:
        tables = _held(record)
        old = spark.read.parquet(f"{folder}/{tables[name]['name']}") if name in tables else entries.limit(0)
        kept = usage.live(old, now).join(entries.select("question_hash"), "question_hash", "left_anti").select(entries.columns)
        return _with(record, {**tables, name: _written(usage.upsert(kept, entries, tie=tie), folder, name)})

    _change(spark, folder, make)


def purge_expired(spark: SparkSession, folder: str, now: float, dry_run: bool = False, name: str = TABLES[0]) -> int:
    """Remove the present table's expired entries, or count them; a table whose first expiry lies ahead isn't read."""
    n = 0

    def make(record: dict) -> dict | None:
        nonlocal n
        tables = _held(record)
        held = tables.get(name)
        if not held or not held["rows"] or (held["first"] is not None and held["first"] > now):
            n = 0
            return None
        rows = spark.read.parquet(f"{folder}/{held['name']}")
        if dry_run:
            n = held["rows"] - usage.live(rows, now).count()
            return None
        new = _written(usage.live(rows, now), folder, name)
        n = held["rows"] - new["rows"]
        return _with(record, {**tables, name: new}) if n else None

    _change(spark, folder, make)
    return n


def scrub(spark: SparkSession, folder: str, dry_run: bool = False) -> dict[str, int]:
    """Empty all recognised tables in one change, or count their rows; nothing is made where there is no cache."""
    counts: dict[str, int] = {}

    def make(record: dict) -> dict | None:
        tables = _held(record)
        counts.update({name: tables[name]["rows"] if name in tables else 0 for name in TABLES})
        if dry_run or not any(counts.values()):
            return None
        return _with(record, {name: held for name, held in tables.items() if name not in TABLES})

    _change(spark, folder, make)
    return counts
