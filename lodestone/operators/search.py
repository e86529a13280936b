"""Phrase search over pages: one hit a page, the first ones in manifest order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, phrase_pattern
from ..session import run_folder

#: Characters shown at each side of a hit.
AROUND = 80
#: Documents of the first range that is searched, and how much longer each further one is.
FIRST_RANGE, GROWTH = 1024, 8


def snippet(text: Column, pattern: str) -> Column:
    """The first match with what is around it, white space as single spaces."""
    parted = rf"(?s)\A(.*?)((?iu:{pattern}))"
    before = F.length(F.regexp_extract(text, parted, 1))
    hit = F.length(F.regexp_extract(text, parted, 2))
    shown = F.substring(text, F.greatest(before - AROUND, F.lit(0)) + 1, F.least(before, F.lit(AROUND)) + hit + AROUND)
    return F.regexp_replace(F.regexp_replace(shown, f"{BLANK}+", " "), "^ | $", "")


def hits(pages: DataFrame, phrases: list[str]) -> DataFrame:
    """The columns of ``pages`` but ``text``, with ``phrase`` and ``snippet``: one row a page and phrase that it holds.

    A phrase is literal, in any case; a space in it is any run of white space,
    line ends too.  An empty phrase is on every page, a null text holds none.
    All phrases (a few) are looked for in one pass, without Python.
    """
    rest = [F.col(f"`{c}`") for c in pages.columns if c != "text"]
    text = F.col("text")
    patterns = {phrase: phrase_pattern(phrase) for phrase in phrases}
    found = F.array(*(F.when(text.rlike(f"(?iu){p}"), F.struct(F.lit(phrase).alias("phrase"), snippet(text, p).alias("snippet"))) for phrase, p in patterns.items()))
    # The filter comes first, so pages without a hit build no arrays.
    some = "(?iu)" + "|".join(f"(?:{p})" for p in patterns.values())
    return pages.where(text.rlike(some)).select(*rest, F.explode(F.array_compact(found)).alias("_hit")).select(*rest, "_hit.*")


def first_hits(pages: DataFrame, phrases: list[str], most: int = 30, doc_ids: list | None = None, order: str = "manifest_ord") -> DataFrame:
    """Of each phrase the first ``most`` hits by order and page, which is the feature.

    Ranges of the order are searched one after another, each longer than all
    before it, until every phrase has its hits; a table in that order (see
    ``sources.pages.write_pages``) is read no further.  What a range finds is
    written, so a lost executor costs that range.  Ties of order and page go
    to the snippet that sorts first.  Pages without an order are not searched.
    """
    spark = pages.sparkSession
    if doc_ids is not None:
        pages = pages.where(F.col("doc_id").isin(doc_ids))
    low, last = pages.agg(F.min(order), F.max(order)).first()
    folder = run_folder(spark, "hits")
    lacking = dict.fromkeys(phrases, most)
    empty = hits(pages.limit(0), phrases)
    steps: list[DataFrame] = []
    length = FIRST_RANGE
    while low is not None and low <= last and lacking:
        own = hits(pages.where((F.col(order) >= low) & (F.col(order) < low + length)), list(lacking))
        ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy("phrase").orderBy(order, "page", "snippet")))
        path = f"{folder}/{len(steps)}"
        # No phrase needs more than the greatest number lacking; a limit of the window is combined in tasks.
        ranked.where(F.col("_rank") <= max(lacking.values())).write.parquet(path)
        kept = spark.read.schema(ranked.schema).parquet(path)
        need = F.create_map(*(F.lit(x) for pair in lacking.items() for x in pair))
        kept = kept.where(F.col("_rank") <= need[F.col("phrase")]).drop("_rank")
        steps.append(kept)
        for phrase, n in kept.groupBy("phrase").count().collect():  # a row a phrase
            lacking[phrase] -= n
        lacking = {phrase: n for phrase, n in lacking.items() if n > 0}
        low, length = low + length, length * GROWTH
    for step in steps:
        empty = empty.unionByName(step)
    return empty
