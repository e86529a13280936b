"""Exact dedup by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after every run of ASCII white space became
one space.  Three aggregations find the winners: within each task (Spark's
partial aggregation), within a salted digest group, and over the salts'
winners.  The grouping key always holds the normalised text itself beside its
digest, so equality is decided on full content at every stage; two contents
under one digest end the run with an error instead of a wrong group.  A group that
holds a third of all rows costs each task one row per salt after the first
stage.

Defined results: a null text counts as empty; all null and blank-free empty
texts form one group.  A group whose ids are all null has a null ``keep_id``
and keeps its rows; null ids lose to any other.  Repeated ids are equal rows:
each row that carries the winning id is kept.  Other columns pass through
``deduplicate`` whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_ids, whole_text

#: Salts that a group of equal texts is dealt over; a power of two.
SALTS = 64

#: Matches only where a run of white space is not already one space.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text):
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(text, _RUNS, " ")


def equal_text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(whole_text(text_col)).alias("_text"))
    rows = rows.select("_id", "_text", F.sha2("_text", 256).alias("_digest"), _salt())
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    # Dealt by digest alone, so contents that shared a digest would meet here and be seen.
    whole = salted.repartition("_digest").groupBy("_digest", "_text").agg(
        F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"), F.collect_list("_salt").alias("_salts")
    )
    single = whole.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_contents"), F.first("_keep").alias("_keep"), F.first("_size").alias("_size"), F.first("_salts").alias("_salts")
    )
    checked = F.when(F.col("_contents") == 1, F.col("_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
    winners = single.select("_digest", "_keep", checked.alias("_size"), F.explode("_salts").alias("_salt"))
    members = rows.select("_id", "_digest", "_salt")
    return members.join(winners, ["_digest", "_salt"]).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns only."""
    return keep_ids(docs, equal_text_groups(docs, id_col, text_col).where("kept").select(id_col), id_col)


def _salt():
    return F.pmod(F.xxhash64(F.col("_id")), F.lit(SALTS)).cast("int").alias("_salt")
