"""A corpus pipeline over ``documents``, of five of the operators.

Each stage takes what its predecessor kept and returns the columns of
``documents`` (the last one the packed pieces); ``run`` writes every stage's
result to the shared folder and reads it back, so a lost executor costs one
stage at most.

* language: documents whose language cannot be told go (no letters, two
  languages almost as near, a low score); ``LANGUAGES`` may name those to keep.
* lines: lines that three or more documents share go, but for the document of
  the largest id; ``n_chars`` follows the text.
* near: one document of each group of near-duplicates stays.
* secrets: every secret is masked; ``n_chars`` follows the text.
* packing: whole documents as pieces of sequences of 4096 tokens.

Null texts have no letters and go with the first stage.  Repeated rows and ids
are documents each until the near stage, which keeps one row of equal texts and
all rows that share a kept id; ties go to the smaller id there, and to the
larger one for shared lines.  Texts of any length are handled whole, each in
one task.  Other columns pass through.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language_id, line_dedup, near_dedup, packing, secrets
from lodestone.llm.common import bound_batches, materialise, run_folder


#: Languages to keep; None keeps every one that is told.
LANGUAGES: set[str] | None = None


def _with_text(docs: DataFrame, text, columns: list[str], of: str = "") -> DataFrame:
    """The columns of ``docs`` (or of its struct), their text replaced."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return docs.select(*(new.get(c, F.col(f"{of}`{c}`")).alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    bound_batches(spark)
    return language_id.accepted(docs, language_id.train(docs), keep=LANGUAGES)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    return _with_text(line_dedup.line_dedup(spark, docs), F.col("kept_text"), docs.columns, "row.")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    return near_dedup.representatives(spark, docs)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    bound_batches(spark)
    return _with_text(secrets.redacted(docs), F.col("text"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    return packing.pack_rows(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("secrets", secret), ("packing", pack)]

#: Models, hashes and sequences are not SQL; tests hold a brute-force version against the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on the written result of the one before."""
    folder = run_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
