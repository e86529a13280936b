"""From lines to elements: furniture, contents pages, headings, paragraphs.

A line has ``doc_id, page, line_no, text`` and a font ``size``; an element is
a heading or a paragraph of one page, numbered in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import upper_median
from ..functions.text import DOT_LEADER, HEADING_NUMBER, dehyphenated, is_heading, strip

REPEATED_SHARE = 0.4
CONTENTS_SHARE = 0.3
DEFAULT_SIZE = 10.0
#: Characters of lines that a task holds, about; what a line takes besides its text.
CHARS_A_TASK, LINE_ROOM = 1 << 23, 16


def extract_lines(docs: DataFrame, lines_per_page: int = 5) -> DataFrame:
    """(doc_id, page, line_no, text) of non-blank lines, stripped."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    page = F.floor(F.col("line_no") / lines_per_page).cast("int") + 1
    return lines.select("doc_id", page.alias("page"), "line_no", strip(F.col("raw")).alias("text")).where("text <> ''")


def boilerplate_lines(lines: DataFrame, doc: str, page: str, page_counts: DataFrame, share: float = REPEATED_SHARE) -> DataFrame:
    """(doc, text, n_pages) of texts that repeat on enough pages.

    ``page_counts`` (doc, n) includes pages without lines.
    """
    # Two combining aggregations: distinct pages first, so a common line is one row a task and page.
    repeated = lines.select(doc, "text", page).distinct().groupBy(doc, "text").agg(F.count(F.lit(1)).alias("n_pages"))
    least = F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(share)))
    return repeated.join(page_counts.withColumnRenamed(doc, "_doc"), F.col(doc) == F.col("_doc")).where(F.col("n_pages") >= least).select(doc, "text", "n_pages")


def strip_boilerplate(lines: DataFrame, boilerplate: DataFrame, doc: str) -> DataFrame:
    return lines.join(boilerplate.select(doc, "text"), [doc, "text"], "left_anti").select(lines.columns)


def contents_pages(lines: DataFrame, share: float = CONTENTS_SHARE) -> DataFrame:
    """(doc_id, page) of pages whose lines mostly lead to a page number."""
    leaders = F.avg(F.col("text").rlike(DOT_LEADER).cast("int"))
    return lines.groupBy("doc_id", "page").agg(leaders.alias("_share")).where(F.col("_share") >= share).select("doc_id", "page")


def body_sizes(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the upper median of positive sizes, 10.0 without any."""
    found = upper_median(lines.where("size > 0"), ["doc_id"], "size", "body")
    return lines.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("body", F.lit(DEFAULT_SIZE)).alias("body"))


def heading_flags(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """The lines with ``heading``."""
    return lines.join(sizes, "doc_id").withColumn("heading", is_heading(F.col("text"), F.col("size"), F.col("body"))).drop("body")


def assemble(flagged: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, kind, text): headings, and runs of other lines of a page as paragraphs."""
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    island = F.sum(F.col("heading").cast("int")).over(order)
    grouped = flagged.withColumn("_island", island).groupBy("doc_id", "page", "_island", "heading")
    parts = grouped.agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_lines"))
    kind = F.when(F.col("heading"), F.lit("heading")).otherwise(F.lit("paragraph"))
    return parts.select("doc_id", "page", "line_no", kind.alias("kind"), dehyphenated(F.col("_lines.text")).alias("text"))


def elements(lines: DataFrame, page_counts: DataFrame, share: float = REPEATED_SHARE) -> DataFrame:
    """All steps on lines with sizes: (doc_id, elem_no, kind, text, page).

    The lines are dealt by document once; each step is a window within a
    document, so whole lines cross the network no more than that. Lines without
    a document are left out; ones without a text repeat none.
    """
    own = lines.where("doc_id is not null")
    # So many parts that a task sorts about as much at any size; without a number, small ones are put together.
    size = own.agg(F.coalesce(F.sum(F.coalesce(F.length("text"), F.lit(0)) + LINE_ROOM), F.lit(0)).alias("n")).first().n
    parts = max(lines.sparkSession.sparkContext.defaultParallelism, -(-size // CHARS_A_TASK))
    # Both sides, or the join would deal the lines as the other one is.
    known = page_counts.repartition(parts, "doc_id").groupBy("doc_id").agg(F.max("n").alias("_n"))
    dealt = own.repartition(parts, "doc_id").join(known, "doc_id", "left")
    doc, text, page = (Window.partitionBy("doc_id", *keys) for keys in ((), ("text",), ("page",)))
    # Body size: the upper median of positive sizes.
    sized = dealt.withColumn("_size", F.when(F.col("size") > 0, F.col("size")))
    sized = sized.withColumns({"_at": F.row_number().over(doc.orderBy(F.col("_size").asc_nulls_last())) - 1, "_sizes": F.count("_size").over(doc)})
    sized = sized.withColumn("body", F.coalesce(F.max(F.when(F.expr("_at = _sizes div 2"), F.col("_size"))).over(doc), F.lit(DEFAULT_SIZE)))
    # Pages that a text is on, a page's first occurrence counting.
    met = sized.withColumn("_first", F.row_number().over(Window.partitionBy("doc_id", "text", "page").orderBy("line_no")) == 1)
    met = met.withColumn("_pages", F.sum(F.col("_first").cast("int")).over(text))
    least = F.greatest(F.lit(2), F.floor(F.col("_n") * F.lit(share)))
    kept = met.where(F.col("text").isNull() | F.col("_n").isNull() | (F.col("_pages") < least))
    # Contents pages, judged by what is left of them.
    leaders = F.avg(F.col("text").rlike(DOT_LEADER).cast("int")).over(page)
    kept = kept.withColumn("_leaders", leaders).where(F.col("page").isNull() | F.col("_leaders").isNull() | (F.col("_leaders") < CONTENTS_SHARE))
    heading = is_heading(F.col("text"), F.col("size"), F.col("body"))
    return numbered(assemble(kept.select("doc_id", "page", "line_no", "text", heading.alias("heading"))))


def ocr_elements(pages: DataFrame) -> DataFrame:
    """Elements of recognised pages (doc_id, page, text), split at blank lines."""
    blocks = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\n\s*\n")).alias("line_no", "_block"))
    lines = F.filter(F.transform(F.split("_block", "\n"), strip), lambda x: x != "")
    own = blocks.select("doc_id", "page", "line_no", lines.alias("_lines")).where(F.size("_lines") > 0)
    first = F.element_at("_lines", 1)
    heading = (F.size("_lines") == 1) & (F.length(first) < 100) & first.rlike(HEADING_NUMBER)
    kind: Column = F.when(heading, F.lit("heading")).otherwise(F.lit("paragraph"))
    return numbered(own.select("doc_id", "page", "line_no", kind.alias("kind"), dehyphenated(F.col("_lines")).alias("text")))


def numbered(parts: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    return parts.select("doc_id", F.row_number().over(order).cast("long").alias("elem_no"), "kind", "text", "page")


def corpus_elements(manifest: DataFrame, lines: DataFrame, page_counts: DataFrame, ocr_pages: DataFrame) -> DataFrame:
    """Elements of all manifest entries whose pages were read.

    Entries whose ``text_layer`` is ``ocr`` come from recognised pages, all
    others from lines with sizes; documents outside the manifest are left out.
    """
    scanned = F.col("text_layer").eqNullSafe("ocr")
    by = lambda when: manifest.where(when).select(F.col("id").alias("doc_id"))
    printed = lines.join(by(~scanned), "doc_id", "left_semi")
    return elements(printed, page_counts).unionByName(ocr_elements(ocr_pages.join(by(scanned), "doc_id", "left_semi")))
