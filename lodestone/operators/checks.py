"""Constraint reports: every error of a manifest or question file, not the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NAMED_INSTRUMENT, normal_quote

# The manifest's required fields and controlled terms.
REQUIRED = (
    "id", "title", "filename", "download_url", "landing_page_url", "referer", "sha256", "publisher", "issuing_authority", "document_type",
    "authority_level", "publication_stage", "published_date", "current_status", "status_as_of", "status_source_url", "is_third_party",
)
TERMS = {
    "authority_level": (
        "primary_legislation", "binding_regulatory_instrument", "accounting_standard", "official_non_binding_guidance",
        "official_explanatory_material", "consultation_or_discussion", "third_party_commentary",
    ),
    "publication_stage": ("final", "consultation", "draft"),
    "current_status": ("current", "withdrawn", "superseded", "historical_snapshot", "unknown"),
}
TEXT_LAYERS = ("text", "ocr")
TYPE_COUNTS = {"single": 12, "threshold": 6, "status": 5, "multi": 8, "unanswerable": 6, "false_premise": 3}
CORRECTIONS = ("not", "no longer", "superseded", "withdrawn", "replaced", "incorrect", "actually", "rather", "instead")
URLS = ("download_url", "landing_page_url", "referer", "status_source_url")


def _say(when: Column, *parts: object) -> Column:
    words = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.when(F.coalesce(when, F.lit(True)), F.concat(*words))


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """(id, error) of every rule that an entry breaks; null counts as missing."""
    have = lambda c: F.col(c) if c in manifest.columns else F.lit(None).cast("string")
    missing = [_say(have(f).isNull(), f"missing required field '{f}'") for f in REQUIRED]
    lacks = F.greatest(*(have(f).isNull() for f in REQUIRED))
    iso = lambda f: have(f).rlike(r"^\d{4}-\d{2}-\d{2}$")
    day = lambda f: F.when(iso(f), F.expr(f"try_cast(`{f}` as date)") if f in manifest.columns else F.lit(None))
    quoted = lambda f: F.concat(F.lit("'"), have(f).cast("string"), F.lit("'"))
    rest = [_say(~have(f).isin(*allowed), f"{f} ", quoted(f), " is not a controlled value") for f, allowed in TERMS.items()]
    rest += [
        _say(~have("sha256").rlike("^[0-9a-f]{64}$"), "sha256 is not a 64-character lowercase hex digest"),
        _say(~have("filename").rlike(r"^[A-Za-z0-9_.-]+\.pdf$"), "filename ", quoted("filename"), " doesn't look like a local .pdf path"),
    ]
    rest += [_say(~have(f).startswith("https://"), f"{f} must be an https:// URL, got ", quoted(f)) for f in URLS]
    for f in ("published_date", "status_as_of"):
        rest.append(_say(~iso(f), f"{f} must be an ISO date (YYYY-MM-DD), got ", quoted(f)))
        rest.append(_say(iso(f) & day(f).isNull(), f"{f} is not a valid calendar date: ", quoted(f)))
    early = F.coalesce(day("status_as_of") < day("published_date"), F.lit(False))
    rest += [
        _say(early, "status_as_of (", have("status_as_of"), ") is before published_date (", have("published_date"), ")"),
        _say(have("status_source_page").isNotNull() & have("status_source_id").isNull(), "status_source_page given without status_source_id"),
        _say(have("text_layer").isNotNull() & ~F.coalesce(have("text_layer").isin(*TEXT_LAYERS), F.lit(False)), "text_layer ", quoted("text_layer"), " must be 'text' or 'ocr'"),
        _say(have("year").isNotNull(), "legacy 'year' field present - use published_date instead"),
    ]
    said = F.when(lacks, F.array(*missing)).otherwise(F.array(*rest))
    single = manifest.select(F.coalesce("id", F.lit("<missing id>")).alias("id"), F.explode(said).alias("error")).where("error is not null")
    for field in ("id", "filename"):
        again = duplicates(manifest, field)
        text = F.concat(F.lit(f"duplicate {field} '"), F.col(field), F.lit("' appears "), F.col("n"), F.lit(" times"))
        single = single.unionByName(again.select(F.lit("").alias("id"), text.alias("error")))
    return single


def duplicates(frame: DataFrame, key: str) -> DataFrame:
    """(key, n) of values that occur more than once."""
    return frame.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def quote_hits(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """The quotes (quote_id, doc_id, page, quote) with ``found``: on the page, or over its end.

    The next page is the one with the next number, not the next row.
    """
    own = pages.select("doc_id", "page", normal_quote(F.col("text")).alias("_here"))
    # A frame of the next number, so that pages are normalised once and not joined with themselves.
    after = Window.partitionBy("doc_id").orderBy("page").rangeBetween(1, 1)
    both = own.withColumn("_next", F.first("_here").over(after))
    # Both are normalised before the join, each once.
    asked = quotes.withColumn("_quote", normal_quote(F.col("quote")))
    out = asked.join(both, ["doc_id", "page"], "left")
    there = F.col("_here").contains(F.col("_quote")) | F.concat("_here", F.lit(" "), F.coalesce("_next", F.lit(""))).contains(F.col("_quote"))
    return out.withColumn("found", F.coalesce(there, F.lit(False))).drop("_here", "_next", "_quote")


def question_errors(questions: DataFrame, known: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(id, error) of a question file.

    ``questions``: id, type, question, reference_answer, evidence (array of
    doc_id, page, quote), why_unanswerable. Documents and quotes are checked
    where ``known`` (doc_id) and ``pages`` are given.
    """

    rank = F.row_number().over(Window.partitionBy("id").orderBy("question"))
    twice = F.row_number().over(Window.partitionBy(F.lower("question")).orderBy("id"))
    q = questions.select("*", rank.alias("_r"), twice.alias("_q"))
    known_type = F.coalesce(F.col("type").isin(*TYPE_COUNTS), F.lit(False))
    open_ = F.col("type") == "unanswerable"
    size = F.coalesce(F.size("evidence"), F.lit(0))
    size = F.greatest(size, F.lit(0))
    text = F.coalesce("question", F.lit(""))
    documents = F.size(F.array_distinct(F.transform(F.coalesce("evidence", F.array().cast(questions.schema["evidence"].dataType)), lambda e: e["doc_id"])))
    corrected = F.lower(F.coalesce("reference_answer", F.lit(""))).rlike("|".join(CORRECTIONS))
    rules = [
        _say(~F.col("id").rlike(r"^[dt]\d\d$") | (F.col("_r") > 1), "bad or duplicate id"),
        _say(~known_type, "unknown type '", F.coalesce("type", F.lit("None")), "'"),
        _say(known_type & ((F.length(text) < 25) | (F.length(text) > 300) | ~text.endswith("?")), "question must be 25-300 chars and end in '?'"),
        _say(known_type & (F.col("_q") > 1), "duplicate question"),
        _say(open_ & (size > 0), "unanswerable item has evidence"),
        _say(open_ & (F.length(F.coalesce("why_unanswerable", F.lit(""))) < 40), "why_unanswerable too short"),
        _say(known_type & ~open_ & (size == 0), "answerable item has no evidence"),
        _say((F.col("type") == "multi") & (documents < 2), "multi item needs two distinct documents"),
        _say((F.col("type") == "false_premise") & ~corrected, "reference does not correct the premise"),
    ]
    out = q.select("id", F.explode(F.array(*rules)).alias("error")).where("error is not null")
    cited = q.where(known_type & ~open_).select("id", F.posexplode("evidence").alias("quote_id", "_e")).select("id", "quote_id", "_e.doc_id", "_e.page", "_e.quote")
    listed = cited
    if known is not None:
        listed = cited.join(known.select("doc_id"), "doc_id", "left_semi")
        lost = cited.join(known.select("doc_id"), "doc_id", "left_anti")
        out = out.unionByName(lost.select("id", F.concat(F.lit("doc_id '"), "doc_id", F.lit("' not in manifest")).alias("error")))
    bad = ~F.length(F.coalesce("quote", F.lit(""))).between(30, 300)
    out = out.unionByName(listed.where(bad).select("id", F.lit("quote must be 30-300 chars").alias("error")))
    if pages is not None:
        hits = quote_hits(listed.where(~bad), pages).where("not found")
        out = out.unionByName(hits.select("id", F.concat(F.lit("quote not found on "), "doc_id", F.lit(" p."), F.col("page").cast("string")).alias("error")))
    named = questions.where(F.col("type").isin("single", "threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("question").rlike(NAMED_INSTRUMENT).cast("int")).alias("k"))
    counts = questions.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    dev = questions.agg(F.coalesce(F.max(F.col("id").startswith("d")), F.lit(False)).alias("_dev"))
    out = out.unionByName(type_count_errors(counts, dev))
    share = named.where("n > 0 and k / n > 0.25").select(F.lit("").alias("id"), F.format_string("%d/%d single+threshold questions name an instrument (max 25%%)", "k", "n").alias("error"))
    return out.unionByName(share)


def type_count_errors(counts: DataFrame, dev: DataFrame) -> DataFrame:
    """One error where a development file's questions of a type are not as many as they should be.

    ``counts`` is (type, n), ``dev`` one row: whether any id is a development one.
    """
    held = counts.agg(F.coalesce(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("type").isin(*TYPE_COUNTS), F.struct("type", "n"))))), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias("_m"), F.coalesce(F.max(~F.col("type").isin(*TYPE_COUNTS)), F.lit(False)).alias("_other"))
    known = {t: F.coalesce(F.try_element_at("_m", F.lit(t)), F.lit(0)) for t in TYPE_COUNTS}
    wrong = F.col("_other")
    for t, n in TYPE_COUNTS.items():
        wrong = wrong | (known[t] != n)
    shown = F.concat_ws(", ", *(F.concat(F.lit(f"{t} "), known[t].cast("string"), F.lit(f" of {n}")) for t, n in TYPE_COUNTS.items()))
    both = held.crossJoin(F.broadcast(dev))  # one row each
    return both.where(F.col("_dev") & wrong).select(F.lit("").alias("id"), F.concat(F.lit("type counts: "), shown).alias("error"))
