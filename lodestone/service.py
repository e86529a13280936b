"""A facade over the operators: ask, statistics, recent queries, health.

What an HTTP layer would serve, as functions of DataFrames: whole batches of
questions go through the cache, retrieval, the model, the checks and the log.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import question_key
from .operators import citations, retrieval, usage
from .session import written
from .sources import index
from .sources.settings import Privacy


@dataclass
class Service:
    """``answer`` maps (answer_id, question, context) to the same with ``answer``."""

    spark: SparkSession
    index_folder: str
    manifest: DataFrame
    answer: Callable[[DataFrame], DataFrame]
    fingerprint: str
    strategy: str = "bm25"
    k: int = 5
    privacy: Privacy = Privacy()
    clock: Callable[[], float] = time.time
    scorer: Callable[[DataFrame], Column] | None = None
    #: (alias, doc_id, manifest_ord), for ``named_balanced``.
    names: DataFrame | None = None

    def contexts(self, questions: DataFrame) -> DataFrame:
        """The chunks that each question (question_id, question) is answered from."""
        chunks = index.read_index(self.spark, self.index_folder).withColumnRenamed("chunk_hash", "chunk_id")
        resolved = retrieval.resolve_names(questions, self.names) if self.names is not None else None
        ranked = retrieval.retrieve(questions, chunks, self.k, self.strategy, scorer=self.scorer, resolved=resolved).select("question_id", "chunk_id", "rank")
        return ranked.join(chunks.select("chunk_id", "doc_id", "page_start", "page_end", "section", "text"), "chunk_id").withColumnRenamed("question_id", "answer_id")

    def ask(self, questions: DataFrame, cache: DataFrame) -> DataFrame:
        """(question_id, question, answer, refused, refusal_reason, cache_hit, flagged_injection).

        Live entries of ``cache`` (question_hash, answer, expires_at) serve;
        the others are retrieved for, answered and checked.
        """
        judged: list[DataFrame] = []

        def fresh(misses: DataFrame) -> DataFrame:
            found = self.contexts(misses)
            context = citations.format_context(found, self.manifest)
            asked = self.answer(misses.withColumnRenamed("question_id", "answer_id").join(context, "answer_id"))
            # Written once: every later step reads the same reply.
            asked = written(asked.select("answer_id", "answer"), "answers")
            checked = citations.validate(asked, found).withColumnRenamed("answer_id", "question_id")
            whole = misses.join(checked, "question_id", "left").withColumn("answer", F.coalesce("served", F.lit(citations.T.REFUSAL)))
            judged.append(whole.select("question_id", F.coalesce("refused", F.lit(True)).alias("refused"), F.when(F.col("refused").isNull(), "no_context").otherwise(F.col("refusal_reason")).alias("refusal_reason")))
            return whole

        out = usage.answer_with_cache(questions, cache, fresh, self.clock(), self.fingerprint)
        return out.join(judged[0], "question_id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))

    def remember(self, answered: DataFrame, cache: DataFrame, ttl: float) -> DataFrame:
        """The cache with what was newly answered; refusals aren't kept."""
        now = self.clock()
        new = answered.where("not cache_hit and not refused").select(question_key(F.lit(self.fingerprint), F.col("question")).alias("question_hash"), "answer", F.lit(now).alias("created_at"), F.lit(now + ttl).alias("expires_at"))
        return usage.upsert(cache, new)

    def timed(self, questions: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``ask`` and its log rows, one a question, hits and misses alike, with the batch's time shared out."""
        began = time.perf_counter()
        answered = written(self.ask(questions, cache), "asked")
        took = 1000 * (time.perf_counter() - began) / max(1, answered.count())
        row = answered.withColumns({"timestamp": F.lit(self.clock()), "latency_ms": F.lit(took), "refused": F.col("refused").cast("int"), "content_logged": F.lit(int(self.privacy.content))})
        shown = ["question", "answer"] if self.privacy.content else []
        return answered, row.select("timestamp", *shown, "content_logged", "refused", "refusal_reason", F.col("cache_hit").cast("int").alias("cache_hit"), F.col("flagged_injection").cast("int").alias("flagged_injection"), "latency_ms")

    def stats(self, log: DataFrame) -> dict:
        return usage.log_stats(log).first().asDict()

    def recent(self, log: DataFrame, limit: int = 20) -> list[dict]:
        """The last rows, contents only where the settings allow them."""
        shown = log if self.privacy.content else log.drop("question", "answer", "raw_model_output")
        return [r.asDict() for r in usage.recent(shown, limit).collect()]

    def ready(self) -> bool:
        """Whether the index is there, whole and built under these settings."""
        try:
            index.assert_compatible(self.spark, self.index_folder, self.fingerprint)
        except (ValueError, KeyError):
            return False
        return True
