"""Readers and writers of the corpus and evaluation files, schemas declared."""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = "array<struct<doc_id:string,page:int,quote:string>>"
MANIFEST = (
    "id string, title string, filename string, download_url string, landing_page_url string, referer string, sha256 string, publisher string, "
    "issuing_authority string, document_type string, authority_level string, publication_stage string, published_date string, current_status string, "
    "status_as_of string, status_source_url string, is_third_party boolean, status_source_id string, status_source_page int, text_layer string"
)
QUESTIONS = f"id string, type string, question string, reference_answer string, evidence {EVIDENCE}, why_unanswerable string"
LABELS = "id string, correctness string, support string, reviewer string, notes string"
CITATIONS = "array<struct<doc_id:string,page:int,verified:boolean,section_ref:string>>"
CONTEXTS = "array<struct<chunk_id:string,doc_id:string,page_start:int,page_end:int,section:string,text:string>>"
RUN = (
    f"schema int, run_id string, items array<struct<id:string,type:string,refused:boolean,refusal_reason:string,raw_model_output:string,served_answer:string,"
    f"citations:{CITATIONS},contexts:{CONTEXTS},evidence:{EVIDENCE},usage:struct<input_tokens:int,output_tokens:int,cost_usd:double>,"
    "repair_attempted:boolean,error:string,latency_ms:int>>"
)
JUDGED = "run string, judge string, model string, items array<struct<id:string,type:string,correctness:string,correctness_reason:string,support:string,support_reason:string>>"
HISTORY = (
    "timestamp timestamp, run_id string, split string, label string, config string, closed_book boolean, n int, answer_rate double, refusal_recall double, "
    "task_outcome double, raw_citation_precision double, retrieval_any_hit double, retrieval_all_hit double, cost_usd double"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with ``manifest_ord``, as its order matters.

    It is one small JSON array, so the order is that of its one partition.
    """
    rows = spark.read.option("multiLine", True).schema(MANIFEST).json(path).coalesce(1)
    return rows.withColumn("manifest_ord", F.monotonically_increasing_id().cast("int"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines question file; blank lines don't count."""
    return spark.read.schema(QUESTIONS).json(path).where("id is not null")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A review form with a header; blank cells are null."""
    return spark.read.option("header", True).schema(LABELS).csv(path)


def read_items(spark: SparkSession, path: str, schema: str = RUN) -> DataFrame:
    """The items of a nested run or judge artifact, one row each, in order."""
    whole = spark.read.option("multiLine", True).schema(schema).json(path)
    rest = [c for c in whole.columns if c != "items"]
    return whole.select(*rest, F.posexplode("items").alias("item_no", "_item")).select(*rest, "item_no", "_item.*")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(HISTORY).csv(path)


METRICS = ("answer_rate", "refusal_recall", "task_outcome", "raw_citation_precision", "retrieval_any_hit", "retrieval_all_hit")


def prepare_history(history: DataFrame) -> tuple[DataFrame, list[str]]:
    """The history with ``evidence_scope``, and the metric columns it has."""
    scope = F.when(F.col("split").eqNullSafe("test"), "test").otherwise("development") if "split" in history.columns else F.lit("unknown")
    return history.withColumn("evidence_scope", scope), [m for m in METRICS if m in history.columns]


def append_history(rows: DataFrame, folder: str) -> None:
    """Add runs to a history folder of CSV files, each with its header."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(folder)


def write_items(rows: DataFrame, folder: str) -> None:
    """An artifact as JSON lines."""
    rows.write.mode("overwrite").json(folder)


def read_markdown_table(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Rows of a report whose lines match, one column a group."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*(F.trim(F.regexp_extract("value", pattern, i + 1)).alias(n) for i, n in enumerate(names)))


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[list[tuple[str, float]]]]) -> DataFrame:
    """(path, page, line_no, text, size) of binary documents by a pluggable parser.

    ``parse`` gives each page's lines with their font sizes; a PDF library or
    an OCR engine fits. Documents are parsed where Spark reads them.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for name, content in zip(own.path, own.content, strict=True):
                rows = [(name, p, i, text.strip(), float(size)) for p, lines in enumerate(parse(bytes(content)), 1) for i, (text, size) in enumerate(lines) if text.strip()]
                yield pd.DataFrame(rows, columns=["path", "page", "line_no", "text", "size"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(work, "path string, page int, line_no int, text string, size double")


def uncached_pages(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """(doc_id, page) that recognition still has to read."""
    return wanted.select("doc_id", "page").join(cached, ["doc_id", "page"], "left_anti")


def page_text(pages: DataFrame, doc_id: str, page: int) -> DataFrame:
    """A point lookup."""
    return pages.where((F.col("doc_id") == doc_id) & (F.col("page") == page)).select("text")


def fetch(url: str, path: str, sha256: str, referer: str = "", attempts: int = 3, wait: float = 2.0, opener: Callable = urllib.request.urlopen) -> str:
    """Download one pinned file; skips one that is there and right.

    A driver-side helper: returns ``kept`` or ``fetched``, raises on a wrong digest.
    """
    import hashlib
    import time

    digest = lambda data: hashlib.sha256(data).hexdigest()
    if os.path.exists(path):
        with open(path, "rb") as file:
            if digest(file.read()) == sha256:
                return "kept"
    for attempt in range(1, attempts + 1):
        try:
            with opener(urllib.request.Request(url, headers={"Referer": referer} if referer else {})) as answer:
                data = answer.read()
            break
        except OSError:
            if attempt == attempts:
                raise
            time.sleep(wait * attempt)
    if not data.startswith(b"%PDF"):
        raise ValueError(f"{url} isn't a PDF")
    if digest(data) != sha256:
        raise ValueError(f"{url} changed")
    temporary = f"{path}.partial"
    with open(temporary, "wb") as file:
        file.write(data)
    os.replace(temporary, path)
    return "fetched"


def export_html(rows: DataFrame, template: str, mark: str = "__DATA__") -> str:
    """A page with a small result as JSON that can't close its script."""
    data = json.dumps([r.asDict(True) for r in rows.collect()], default=str)
    return template.replace(mark, re.sub("</", r"<\\/", data))


def markdown_table(rows: DataFrame) -> str:
    """A small result as a report table."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()]
    return "\n".join(lines) + "\n"
