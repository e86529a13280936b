"""Connected components of a graph that no machine could hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Tasks that the edges of one node are dealt over.
SALTS = 6


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (src, dst; both not null).

    Alternating stars: each node's greater neighbours, then its smaller ones,
    are linked to the least node near it until nothing changes; a number of
    rounds that grows with the logarithm of the diameter.  Each round is
    written to the shared folder, so neither lineage nor driver grows.  The
    component is its least node; nodes without an edge have no row.
    """
    now = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()
    run = uuid.uuid4().hex[:8]
    now = materialise(now, folder, f"stars-{run}-0")
    seen = _state(now)
    number = 0
    while seen[0]:
        number += 1
        both = now.unionAll(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = both.groupBy("src").agg(F.min("dst").alias("near")).select("src", F.least("src", "near").alias("near"))
        large = _beside(both, near).where("dst > src").select(F.col("dst").alias("src"), F.col("near").alias("dst"))
        least = large.groupBy("src").agg(F.min("dst").alias("near"))
        small = _beside(large.select("src", "dst"), least).select(F.explode(F.array(F.struct("src", F.col("near").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("near").alias("dst")))).alias("e"))
        after = materialise(small.select("e.src", "e.dst").where("src <> dst").distinct(), folder, f"stars-{run}-{number}")
        if (state := _state(after)) == seen:
            break
        now, seen = after, state
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(roots)


def _beside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge with its ``src``'s row of ``nodes``.

    The centre of a large component has a large share of all edges, so edges
    are salted by their other end and each node has a row a salt.
    """
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"))
    copies = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["src", "_salt"]).drop("_salt")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
    return row.n, row.x
