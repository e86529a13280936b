"""Text rules as columns: normalisers, patterns, citations, labels."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results.
HEADING_NUMBER = r"^(\d{1,3}[A-Z]?(\.\d{1,3}){0,3})[\.\)]?\s+\S"
DATE_LINE = r"(?i)^\d{1,2}\s+(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\.?\s*$"
DOT_LEADER = r"\.{4,}\s*\d{1,4}\s*$"
ENDS_IN_HYPHEN = r"[\p{L}\p{N}_]-$"
SENTENCE_GAP = r"(?<=[.!?])\s+"
TERM = r"[a-z0-9]+(?:[/.][a-z0-9]+)*"
CITATION = r"\[[\p{L}\p{N}_\-\.]+,\s*p\.\d+(?:-\d+)?(?:,[^\]]*)?\]"
CITATION_PARTS = r"\[([\p{L}\p{N}_\-\.]+),\s*p\.(\d+)(?:-(\d+))?(?:,[^\]]*)?\]"
ENDS_IN_CITATION = r"(?:\[[\p{L}\p{N}_\-\.]+,\s*p\.\d+(?:-\d+)?(?:,[^\]]*)?\]\s*)+$"
CITATION_SHAPED = r"(?i)[\[(][^\])\n]{0,160}?p+[\s.]{0,3}\d"
SECTION_NUMBER = r"(?i)^\s*(?:section\s+|regulation\s+|reg\.\s*|paragraph\s+|para\.?\s*)?(\d{1,3}[A-Z]?(?:\.\d{1,3}){0,3})\b"
INJECTION = (
    r"ignore (all |any |the )?(previous|prior|above) instructions",
    r"disregard (all |any |the )?(previous|prior|above) (instructions|rules|prompt)",
    r"you are now\b",
    r"act as (a|an)\b",
    r"reveal (your|the) (system )?prompt",
    r"repeat (your|the) (system )?prompt",
    r"new instructions\s*:",
    r"</?(system|instructions?)>",
)
REFUSAL = "I don't have a source for that."
NAMED_INSTRUMENT = r"(?i)(directive|guidance note|guideline|circular|conduct standard)\s+\d|\b[a-z]\d{1,2}/20\d\d\b|\b\d{1,3}/20\d\d\b|\bper the\b"

SPACE = r"[\x09-\x0D ]+"
SPACES = "\t\n\x0b\x0c\r "
#: White space of Unicode, a class that Java's and RE2's patterns both take.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space at either end. A pattern would read a run within the text anew from each of its places."""
    return F.btrim(text, F.lit(SPACES))


def phrase_pattern(phrase: str) -> str:
    """A pattern of the phrase in any case, literally but for its spaces, each of which is any white space."""
    literal = (re.sub(r"([^\w])", r"\\\1", part, flags=re.ASCII) if part.isascii() else "".join(c if c.isalnum() else f"\\x{{{ord(c):X}}}" for c in part) for part in phrase.split(" "))
    return f"{BLANK}+".join(literal)


def normal_question(text: Column) -> Column:
    """Lower case, runs of white space (Unicode's) as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), f"{BLANK}+", " "))


def question_key(fingerprint: Column, question: Column) -> Column:
    """The response cache's key."""
    return F.sha2(F.concat(fingerprint, F.lit(":"), normal_question(question)), 256)


def normal_name(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def compatible(text: Column) -> Column:
    """Unicode NFKC, which has no built-in function."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return normal(text)


def normal_quote(text: Column) -> Column:
    """NFKC, lower case, hyphens at line ends joined, a-z 0-9 % only."""
    joined = F.regexp_replace(F.lower(compatible(text)), r"-\s*\n\s*", "")
    return F.trim(F.regexp_replace(joined, r"[^a-z0-9%]+", " "))


def keyed_digest(text: Column, key: str) -> Column:
    """HMAC-SHA256 of the normalised question, null without a key."""
    if not key:
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest(), na_action="ignore")

    return digest(normal_question(text))


def words(text: Column) -> Column:
    """White-space tokens; the default, exactly reproducible token counter."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def overlap_tail(text: Column, most: int) -> Column:
    """The last tokens of a text, the whole text where it has no more."""
    own = words(text)
    return F.when(F.size(own) <= most, text).otherwise(F.array_join(F.slice(own, -most, most), " "))


def token_windows(text: Column, target: int, overlap: int) -> Column:
    """Windows of ``target`` tokens; the first to reach the end is the last."""
    own, step = words(text), max(target - overlap, 1)
    last = F.greatest(F.ceil((F.size(own) - target) / F.lit(step)), F.lit(0)).cast("int")
    starts = F.when(F.size(own) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(own, i * step + 1, target), " "))


def chunk_hash(doc_id: Column, page_start: Column, page_end: Column, section: Column, text: Column) -> Column:
    """Content address; a missing section is the empty one."""
    parts = [doc_id.cast("string"), page_start.cast("string"), page_end.cast("string"), F.coalesce(section, F.lit("")), text]
    return F.sha2(F.concat(*[x for p in parts for x in (p, F.lit(":"))][:-1]), 256)


def terms(text: Column) -> Column:
    """Search terms, identifiers such as ``8/2025`` whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def dehyphenated(lines: Column) -> Column:
    """Lines joined by spaces, or without their hyphen where one ends in it."""

    def join(text: Column, line: Column) -> Column:
        broken = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), line)
        return F.when(text == "", line).when(text.rlike(ENDS_IN_HYPHEN), broken).otherwise(F.concat(text, F.lit(" "), line))

    return F.aggregate(lines, F.lit(""), join)


def is_heading(text: Column, size: Column, body: Column) -> Column:
    """Short, not a date, and numbered or set in larger type."""
    return F.when(F.length(text) > 120, F.lit(False)).when(text.rlike(DATE_LINE), F.lit(False)).when(text.rlike(HEADING_NUMBER), F.lit(True)).otherwise(size >= body * 1.15)


def citations(text: Column) -> Column:
    """array<struct<doc_id, first, last>> of the citations in a text."""
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))

    def parts(token: Column) -> Column:
        # A number that no page has is the greatest one; a range to such a page is none.
        first = F.coalesce(F.regexp_extract(token, CITATION_PARTS, 2).try_cast("int"), F.lit(2**31 - 1))
        end = F.regexp_extract(token, CITATION_PARTS, 3)
        return F.struct(F.regexp_extract(token, CITATION_PARTS, 1).alias("doc_id"), first.alias("first"), F.when(end == "", first).otherwise(end.try_cast("int")).alias("last"))

    return F.transform(found, parts)


def injection_flag(text: Column) -> Column:
    """Whether a question tries to steer the model; it only flags."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in INJECTION))


def section_reference(section: Column, authority: Column) -> Column:
    """``s N`` of primary legislation, else ``para N``; null if unnumbered."""
    number = F.regexp_extract(F.coalesce(section, F.lit("")), SECTION_NUMBER, 1)
    prefix = F.when(authority.eqNullSafe(F.lit("primary_legislation")), F.lit("s ")).otherwise(F.lit("para "))
    return F.when(number != "", F.concat(prefix, number))


def parsed_label(text: Column, allowed: tuple[str, ...]) -> Column:
    """struct<label, reason> of the JSON object that a reply holds."""
    found = F.from_json(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0), "label string, reason string")
    label = F.when(found["label"].isin(*allowed), found["label"]).otherwise(F.lit("unparsed"))
    return F.struct(label.alias("label"), F.substring(F.coalesce(found["reason"], F.lit("")), 1, 300).alias("reason"))


def citation_url(download: Column, landing: Column, page: Column) -> Column:
    """Where a citation leads; PDF addresses with the page."""
    url = F.coalesce(F.nullif(download, F.lit("")), F.nullif(landing, F.lit("")))
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    return F.when(F.lower(path).endswith(".pdf"), F.concat(url, F.lit("#page="), page.cast("string"))).otherwise(url)


def ratio_text(k: Column, n: Column) -> Column:
    """``k/n (p%)``, half a percent to the even side; no share of nothing."""
    share = F.format_string(" (%.0f%%)", F.bround(F.try_divide(100 * k.cast("double"), n), 0))
    return F.concat(F.format_string("%d/%d", k, n), F.when(n > 0, share).otherwise(F.lit("")))


def interval_text(low: Column, high: Column) -> Column:
    """``a%-b%`` of an interval, ``n/a`` where there is none."""
    text = F.format_string("%.0f%%-%.0f%%", F.bround(low * 100, 0), F.bround(high * 100, 0))
    return F.when(low.isNull(), F.lit("n/a")).otherwise(text)


def agent_decision(text: Column, question: Column) -> Column:
    """struct<sufficient, query>: what a sufficiency reply asks for next."""
    insufficient = F.upper(strip(text)).startswith("INSUFFICIENT")
    after = strip(F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1))
    return F.struct((~insufficient).alias("sufficient"), F.when(insufficient, F.when(after != "", after).otherwise(question)).alias("query"))
