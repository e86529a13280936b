"""Index upkeep: what to add and delete, digests of files, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_diff(desired: DataFrame, existing: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """(key, action) for the keys of either side: add, delete or keep."""
    want = desired.select(key).distinct().withColumn("_w", F.lit(True))
    have = existing.select(key).distinct().withColumn("_h", F.lit(True))
    action = F.when(F.col("_h").isNull(), "add").when(F.col("_w").isNull(), "delete").otherwise("keep")
    return want.join(have, key, "full").select(key, action.alias("action"))


def check_ids(desired: DataFrame, written: DataFrame, key: str = "chunk_hash") -> None:
    """Fails unless exactly the desired keys were written."""
    wrong = index_diff(desired, written, key).where("action <> 'keep'").groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()
    if wrong:
        raise ValueError("the index differs: " + ", ".join(f"{r.n} to {r.action}" for r in wrong))


def file_digests(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(filename, state) of listed files: ok, changed or missing.

    ``files`` is Spark's binaryFile table.
    """
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(name.alias("filename"), F.sha2("content", 256).alias("_d"))
    state = F.when(F.col("_d").isNull(), "missing").when(F.col("_d") == F.col("sha256"), "ok").otherwise("changed")
    return manifest.select("filename", "sha256").join(found, "filename", "left").select("filename", state.alias("state"))


def truncated(chunks: DataFrame, tokens: str, limit: int) -> DataFrame:
    """One row: chunks, and those over an embedder's limit."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum((F.col(tokens) > limit).cast("long")), F.lit(0)).alias("truncated"))
