"""Citations of answers against the pages that were retrieved, and notices.

Answers are ``answer_id, answer``; contexts are the chunks that the answer was
written from: ``answer_id, chunk_id, doc_id, page_start, page_end, section``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What a status is called in a notice.
STATUS_VERBS = {
    "withdrawn": "treated as withdrawn",
    "superseded": "treated as superseded by a later instrument",
    "historical_snapshot": "a dated historical snapshot that may not reflect later amendments",
    "unknown": "of unconfirmed current status",
}
#: Pages of a cited range that are listed at once.
PAGES_AT_ONCE = 10_000


def extract(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(answer_id, cite_no, doc_id, page): ranges page by page, reversed ones none."""
    tokens = answers.select("answer_id", F.posexplode(T.citations(F.col(text))).alias("_token", "_c")).where("_c.last >= _c.first")
    # In blocks, so that no array grows with a range that an answer names.
    blocks = tokens.select("answer_id", "_token", F.col("_c.doc_id").alias("doc_id"), F.col("_c.last").alias("_last"), F.explode(F.sequence("_c.first", "_c.last", F.lit(PAGES_AT_ONCE))).alias("_from"))
    last = F.when(F.col("_from") > F.col("_last") - (PAGES_AT_ONCE - 1), F.col("_last")).otherwise(F.col("_from") + (PAGES_AT_ONCE - 1))
    pages = blocks.select("answer_id", "_token", "doc_id", F.explode(F.sequence("_from", last)).alias("page"))
    order = Window.partitionBy("answer_id").orderBy("_token", "page")
    return pages.select("answer_id", F.row_number().over(order).cast("long").alias("cite_no"), "doc_id", "page")


def covered_pages(contexts: DataFrame) -> DataFrame:
    """(answer_id, doc_id, page, section): the first covering chunk's section."""
    pages = contexts.select("answer_id", "doc_id", "page_start", "chunk_id", "section", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    # The section travels in a struct, so that a first chunk without one gives null.
    first = F.min(F.struct("page_start", "chunk_id", F.struct("section").alias("_s")))
    return pages.groupBy("answer_id", "doc_id", "page").agg(first.alias("_f")).select("answer_id", "doc_id", "page", F.col("_f._s.section").alias("section"))


def verify(cites: DataFrame, contexts: DataFrame) -> DataFrame:
    """The citations with ``verified`` and the ``section`` of their page."""
    pages = covered_pages(contexts).withColumn("_in", F.lit(True))
    return cites.join(pages, ["answer_id", "doc_id", "page"], "left").withColumn("verified", F.coalesce("_in", F.lit(False))).drop("_in")


def with_reference(verified: DataFrame, manifest: DataFrame) -> DataFrame:
    """``section_ref`` of verified citations, by the document's authority."""
    known = manifest.select(F.col("id").alias("doc_id"), "authority_level")
    out = verified.join(known, "doc_id", "left")
    reference = F.when(F.col("verified"), T.section_reference(F.col("section"), F.col("authority_level")))
    return out.withColumn("section_ref", reference).drop("authority_level", "section")


def _covers(ranges: Column, first: Column, last: Column) -> Column:
    """Whether ranges of pages hold every page of one: each in order reaches on from the ones before."""
    ordered = F.array_sort(F.transform(ranges, lambda p: F.struct(p["page_start"].alias("a"), p["page_end"].alias("b"))))
    reached = F.aggregate(ordered, first.cast("long") - 1, lambda to, p: F.when(p["a"] <= to + 1, F.greatest(to, p["b"].cast("long"))).otherwise(to))
    return reached >= last


def validate(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(answer_id, refused, refusal_reason, served): the first rule that fails."""
    # An answer is read once and carried along: a model behind it may not give the same reply twice.
    own = judge(answers.join(shown_pages(contexts), "answer_id", "left"))
    served = F.when(F.col("refusal_reason").isNull(), T.strip(F.col("answer"))).otherwise(F.lit(T.REFUSAL))
    return own.select("answer_id", F.col("refusal_reason").isNotNull().alias("refused"), "refusal_reason", served.alias("served"))


def shown_pages(contexts: DataFrame) -> DataFrame:
    """(answer_id, pages): the ranges of pages that each answer was written from."""
    return contexts.groupBy("answer_id").agg(F.collect_set(F.struct("doc_id", "page_start", "page_end")).alias("pages"))


def judge(answers: DataFrame) -> DataFrame:
    """Rows with ``answer`` and ``pages`` and, new, ``refusal_reason``, null where every rule holds."""
    own = answers.withColumn("_t", T.strip(F.col("answer")))
    own = own.withColumn("_cited", F.filter(T.citations(F.col("answer")), lambda c: c["last"] >= c["first"]))
    seen = lambda c: F.filter(F.coalesce("pages", F.array().cast(answers.schema["pages"].dataType)), lambda p: (p["doc_id"] == c["doc_id"]) & (p["page_start"] <= c["last"]) & (p["page_end"] >= c["first"]))
    own = own.withColumn("_n", F.size("_cited")).withColumn("_all", F.forall("_cited", lambda c: _covers(seen(c), c["first"], c["last"])))
    text: Column = F.col("_t")
    uncited = F.exists(F.split(text, "\n"), lambda line: (T.strip(line) != "") & ~F.rtrim(line, F.lit(T.SPACES)).rlike(T.ENDS_IN_CITATION))
    reason = (
        F.when(text == T.REFUSAL, F.lit("model_refusal"))
        .when(F.lower(text).contains(T.REFUSAL.lower()), F.lit("malformed_refusal"))
        .when((F.col("_n") == 0) & text.rlike(T.CITATION_SHAPED), F.lit("malformed_citation"))
        .when(F.col("_n") == 0, F.lit("missing_citation"))
        .when(uncited, F.lit("uncited_line"))
        .when(~F.col("_all"), F.lit("unverified_citation"))
    )
    return own.withColumn("refusal_reason", reason).drop("_t", "_cited", "_n", "_all")


def enrich(cites: DataFrame, manifest: DataFrame) -> DataFrame:
    """Title and address of each citation; unknown documents keep nulls."""
    known = manifest.select(F.col("id").alias("doc_id"), "title", "download_url", "landing_page_url")
    out = cites.join(known, "doc_id", "left")
    return out.withColumn("source_url", T.citation_url(F.col("download_url"), F.col("landing_page_url"), F.col("page"))).drop("download_url", "landing_page_url")


def format_context(contexts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(answer_id, context): blocks in rank order, each under its header."""
    known = manifest.select(F.col("id").alias("doc_id"), "document_type", "published_date", "issuing_authority", "title")
    own = contexts.join(known, "doc_id", "left")
    pages = F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("p."), F.col("page_start"))).otherwise(F.concat(F.lit("p."), F.col("page_start"), F.lit("-"), F.col("page_end")))
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(", "), F.col("section"))).otherwise(F.lit(""))
    head = F.concat(F.lit("("), F.col("doc_id"), F.lit(", "), pages, section, F.lit(")\n"), F.col("text"))
    source = F.concat(F.lit("Source type: "), "document_type", F.lit(" ("), F.substring("published_date", 1, 4), F.lit("), issued by "), "issuing_authority", F.lit('. Title: "'), "title", F.lit('".\n'))
    block = F.concat(F.coalesce(source, F.lit("")), head)
    blocks = own.select("answer_id", "rank", block.alias("block")).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return blocks.select("answer_id", F.array_join(F.col("b.block"), "\n\n").alias("context"))


def with_status_source(manifest: DataFrame) -> DataFrame:
    """The manifest with the title of each entry's status evidence, or its id."""
    titles = manifest.select(F.col("id").alias("status_source_id"), F.col("title").alias("_title"))
    return manifest.join(titles, "status_source_id", "left").withColumn("status_source_title", F.coalesce("_title", "status_source_id")).drop("_title")


def notices(cites: DataFrame, manifest: DataFrame) -> DataFrame:
    """(answer_id, notice_no, kind, text, evidence_doc, evidence_page) of cited documents."""
    own = cites.select("answer_id", "doc_id").distinct().join(with_status_source(manifest).withColumnRenamed("id", "doc_id"), "doc_id")
    page = F.nullif(F.col("status_source_page"), F.lit(0))
    shown = (F.coalesce("status_source_id", F.lit("")) != "") & page.isNotNull()
    clause = F.when(shown, F.concat(F.lit(", per "), "status_source_title")).otherwise(F.lit(" (no corpus document confirms this; see the manifest's external source)"))
    verbs = F.create_map(*(F.lit(x) for pair in STATUS_VERBS.items() for x in pair))
    third = F.struct(F.lit("third_party_source").alias("kind"), F.concat("doc_id", F.lit(" is third-party commentary, not an official regulator or standard-setter source.")).alias("text"), F.lit(False).alias("e"))
    stage = F.struct(F.lit("non_final_source").alias("kind"), F.concat("doc_id", F.lit(" is a "), "publication_stage", F.lit(" document, not a final published instrument.")).alias("text"), F.lit(False).alias("e"))
    status = F.struct(F.concat("current_status", F.lit("_source")).alias("kind"), F.concat("doc_id", F.lit(" is "), verbs[F.col("current_status")], F.lit(" as of "), "status_as_of", clause, F.lit(".")).alias("text"), shown.alias("e"))
    said = F.array(
        F.when(F.col("is_third_party"), third),
        F.when(F.col("publication_stage").isNotNull() & (F.col("publication_stage") != "final"), stage),
        F.when(F.col("current_status").isNotNull() & (F.col("current_status") != "current"), status),
    )
    rows = own.select("answer_id", "doc_id", F.col("status_source_id").alias("_s"), page.alias("_p"), F.posexplode(said).alias("_at", "_n")).where("_n is not null")
    order = Window.partitionBy("answer_id").orderBy("doc_id", "_at")
    evidence = F.col("_n.e")
    return rows.select("answer_id", F.row_number().over(order).cast("long").alias("notice_no"), "_n.kind", "_n.text", F.when(evidence, F.col("_s")).alias("evidence_doc"), F.when(evidence, F.col("_p")).alias("evidence_page"))


def cited_passages(cites: DataFrame, contexts: DataFrame) -> DataFrame:
    """(answer_id, passage_no, chunk_id, doc_id, page): covering chunks, once each.

    ``cites`` have ``cite_no``, ``contexts`` have ``rank``.
    """
    joined = cites.join(contexts, ["answer_id", "doc_id"]).where(F.col("page").between(F.col("page_start"), F.col("page_end")))
    first = joined.groupBy("answer_id", "chunk_id").agg(F.min(F.struct("cite_no", "rank", "doc_id", "page")).alias("_f"))
    order = Window.partitionBy("answer_id").orderBy("_f.cite_no", "_f.rank")
    return first.select("answer_id", F.row_number().over(order).cast("long").alias("passage_no"), "chunk_id", "_f.doc_id", "_f.page")
