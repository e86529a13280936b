"""Near-duplicate groups: bottom-k sketches, inverted lists, exact Jaccard.

1. Each text's set of shingle hashes gives its size, a digest of the set and
   its ``SKETCH`` smallest hashes (one hash function).  Rows with equal sets
   are one class; only its least id goes on.
2. Inverted lists of retained values generate candidates. A pair at the
   threshold shares at least ``overlap(n)`` values of its sketches, so if each
   text enters only its rarest ``size - overlap + 1`` values (rarest over all
   sketches, the same order for all), the pair still meets in a list. Values of
   passages that many texts share come last and seldom make lists. For sets
   within a sketch this is exact; for a larger pair exactly at the threshold
   it fails with a chance of 10 ** -6, and less above it.
3. Each member is paired with its list's pivot, the text with the fewest values
   of its own (an original rather than an altered copy), so candidates are no
   more than list entries. Pairs whose union sketch estimates far too little
   are dropped; the rest is decided on full sets.
4. Links make components. Two texts of a list can still be similar where
   neither is the pivot and they aren't yet in one component. Texts of lists
   that hold several components are taken again with their whole sets: each
   enters the lists of the rarest quarter of its set, in which a similar pair
   must meet, and pairs of two components whose sizes and places in the list
   leave room for enough common shingles are decided on full sets. Entries
   whose place leaves no room for any partner's size are dropped before pairs
   are formed. This step is exact.

Nothing is capped; a text of any length is one set of its shingles, 8 bytes
each, in its task.  Defined results: null or blank texts have the empty set
and are linked with nothing.  Rows that repeat an id are one node.  Null ids
have their set's size, a null component and stay.  An empty table gives an
empty result.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_folder, keep_ids, keep_only, map_batches, materialise, run_folder, whole_text
from .graph import connected_components
from .shingles import shingle_sets

#: Similarity in hundredths, retained values, and those that a pair shares at least if either set is larger.
SIMILAR = 75
SKETCH = 128
SHARED_LARGE, SHARED_MIXED = 72, 85
#: Sizes of one band differ by this factor at most.
BAND = 1.05
#: A pair at the threshold is estimated below this with a chance of 10 ** -6.
LEAST_ESTIMATE = 0.55


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", retain: int | None = SKETCH) -> DataFrame:
    """Per row: doc_id, n_shingles, set digest (null if empty), sketch (None: the whole set)."""

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"]
            for low in range(0, len(ids), 2000):
                out: dict = {"doc_id": ids[low : low + 2000], "n_shingles": [], "digest": [], "sketch": []}
                for own in shingle_sets(texts[low : low + 2000]):
                    out["n_shingles"].append(len(own))
                    out["digest"].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    out["sketch"].append(own[:retain].view(np.int64))
                yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_batches(rows, work, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def list_entries(classes: DataFrame, whole: bool = False) -> DataFrame:
    """(key, id, n, own, at): each text in the lists of its rarest values.

    ``own`` counts the values that no other sketch retains, ``at`` is the
    value's place among the others. ``whole``: the sketches are full sets.
    """
    values = classes.select("id", "n", F.size("sketch").alias("_s"), F.explode("sketch").alias("key"))
    shared = values.groupBy("key").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    held = values.join(shared, "key")
    text = Window.partitionBy("id", "n")
    place = held.withColumn("own", F.col("_s") - F.count(F.lit(1)).over(text)).withColumn("at", F.row_number().over(text.orderBy("_df", "key")))
    overlap = F.ceil(F.col("n") * SIMILAR / 100)
    if not whole:
        overlap = F.when(F.col("n") > SKETCH, F.lit(SHARED_LARGE)).otherwise(F.least(overlap, F.lit(SHARED_MIXED)))
    return place.where(F.col("own") + F.col("at") <= F.col("_s") - overlap + 1).select("key", "id", "n", "own", "at")


def near_sizes(a: str, b: str) -> str:
    """Sizes that a similar pair can have."""
    return f"100 * {a} >= {SIMILAR} * {b} and 100 * {b} >= {SIMILAR} * {a}"


def pivot_pairs(entries: DataFrame) -> DataFrame:
    """(a, b), a < b: each list's members with its pivot, each pair once."""
    lists = entries.groupBy("key").agg(F.min(F.struct("own", "id", "n")).alias("_p"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    lists = lists.select("key", F.col("_p.id").alias("_id"), F.col("_p.n").alias("_n"))
    pairs = entries.join(lists, "key").where(f"id <> _id and {near_sizes('n', '_n')}")
    return pairs.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()


def rest_pairs(entries: DataFrame, found: DataFrame, decided: DataFrame, docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """Pairs of two components that step 4 has to decide."""
    labelled = entries.join(found, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    lists = labelled.groupBy("key").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).where("_low <> _high").select("key")
    texts = materialise(labelled.join(lists, "key", "left_semi").select("id", "c").distinct(), folder, "open")
    whole = docs.join(texts.select(F.col("id").alias("_open")), F.col(id_col).cast("long") == F.col("_open"), "left_semi")
    again = list_entries(profiles(whole, id_col, text_col, None).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch"), True)
    own = materialise(again.join(texts, "id"), folder, "open-entries")
    return banded_pairs(own).join(decided, ["a", "b"], "left_anti")


def banded_pairs(entries: DataFrame) -> DataFrame:
    """(a, b) of entries (key, id, n, own, at, c) of one list that can be similar and are not one component.

    At its first list in the order of rarity a pair has this value and later
    ones to share, and similar sets share three sevenths of their sizes' sum.
    Sizes fall into bands. An entry is dealt to the bands of the sizes that a
    partner can have, and only where its own place leaves room for the least of
    them: texts of one template that differ too much are dropped here, before
    any pair is formed.
    """
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND) + 1e-9).cast("int")
    low = lambda b: F.pow(F.lit(BAND), b.cast("double")) * (1 - 1e-6)
    sized = entries.withColumn("_b", band(F.col("n"))).withColumn("_left", F.col("n") - F.col("own") - F.col("at") + 1)
    steps = F.sequence(F.lit(0), F.lit(math.ceil(math.log(100 / SIMILAR) / math.log(BAND)) + 1))
    room = lambda other: 7 * F.col("_left") >= 3 * (F.col("n") + F.greatest(low(other), F.col("n") * SIMILAR / 100 * (1 - 1e-6)))
    smaller = sized.withColumn("_o", F.explode(F.transform(steps, lambda i: F.col("_b") + i))).where(room(F.col("_o")) & (low(F.col("_o")) * SIMILAR <= F.col("n") * 100))
    larger = sized.withColumn("_o", F.explode(F.transform(steps, lambda i: F.col("_b") - i))).where(room(F.col("_o")))
    left = smaller.select("key", F.col("_b").alias("x"), F.col("_o").alias("y"), "id", "n", "c", "_left").alias("l")
    right = larger.select("key", F.col("_o").alias("x"), F.col("_b").alias("y"), "id", "n", "c", "_left").alias("r")
    fits = f"l.key = r.key and l.x = r.x and l.y = r.y and (l.n < r.n or l.n = r.n and l.id < r.id) and l.c <> r.c and {near_sizes('l.n', 'r.n')}"
    met = left.join(right, F.expr(f"{fits} and 7 * least(l._left, r._left) >= 3 * (l.n + r.n)"))
    return met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets from their sorted bottom-k sketches."""
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~again])][:SKETCH]
    shared = both[1:][again]
    return np.searchsorted(shared, union[-1], side="right") / len(union) if len(union) else 0.0


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose union sketches suggest a link."""
    own = classes.select("id", "sketch")
    one = pairs.join(own.select(F.col("id").alias("a"), F.col("sketch").alias("_sa")), "a")
    two = one.join(own.select(F.col("id").alias("b"), F.col("sketch").alias("_sb")), "b")

    @F.pandas_udf("double")
    def estimated(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([estimate(x.view(np.uint64), y.view(np.uint64)) for x, y in zip(a, b, strict=True)], dtype=float)

    return two.where(estimated("_sa", "_sb") >= LEAST_ESTIMATE).select("a", "b")


def linked(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (src, dst) whose full sets are similar enough."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text"))
    one = pairs.join(texts.withColumnsRenamed({"_id": "a", "_text": "_ta"}), "a")
    two = one.join(texts.withColumnsRenamed({"_id": "b", "_text": "_tb"}), "b")

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_similar(x, y) for x, y in zip(shingle_sets(a), shingle_sets(b), strict=True)], dtype=bool)

    return two.where(similar("_ta", "_tb")).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= SIMILAR * (len(both) - shared)


def components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    folder = run_folder(spark, "near")
    sketched = materialise(profiles(docs, id_col, text_col), folder, "profiles")
    grouped = sketched.where("digest is not null and doc_id is not null").groupBy("digest")
    classes = materialise(grouped.agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), folder, "classes")
    rows = materialise(sketched.drop("sketch"), folder, "rows")
    drop_folder(spark, f"{folder}/profiles")
    release(spark)
    entries = materialise(list_entries(classes), folder, "entries")
    pairs = materialise(pivot_pairs(entries), folder, "pairs")
    release(spark)
    links = materialise(linked(materialise(likely(pairs, classes), folder, "likely"), docs, id_col, text_col), folder, "links")
    release(spark)
    found = connected_components(links, folder)
    rest = materialise(rest_pairs(entries, found, pairs, docs, folder, id_col, text_col), folder, "rest")
    release(spark)
    if not rest.isEmpty():
        more = materialise(linked(rest, docs, id_col, text_col), folder, "more-links")
        found = connected_components(links.unionAll(more), folder)
    own = classes.select("digest", "id").join(found, F.col("id") == F.col("node"), "left")
    labels = materialise(own.select(F.col("digest").alias("_digest"), F.coalesce("component", "id").alias("_component")), folder, "labels")
    keep_only(spark, folder, {"rows", "labels"})
    release(spark)
    out = rows.join(labels, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def representatives(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each group, with their own columns."""
    found = components(spark, docs.select(id_col, text_col), id_col, text_col)
    return keep_ids(docs, found.where("kept").select("doc_id"), id_col)
