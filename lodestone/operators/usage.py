"""The query log and the response cache: summaries, retention, expiry, upkeep."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import injection_flag, keyed_digest, question_key

DAY = 86_400

#: The log's columns; the streaming and batch sinks write these.
LOG_SCHEMA = (
    "id long, timestamp double, question string, answer string, question_hmac string, content_logged int, raw_model_output string, "
    "raw_output_logged int, refused int, flagged_injection int, cache_hit int, citation_count int, unverified_citation_count int, "
    "retrieved_chunk_ids string, model string, input_tokens int, output_tokens int, cost_usd double, latency_ms double, refusal_reason string"
)


def log_rows(results: DataFrame, content: bool = False, raw: bool = False, key: str = "") -> DataFrame:
    """Results as log rows; contents only where the privacy settings allow them.

    ``results``: id, timestamp, question, answer, raw_model_output, refused,
    cache_hit, citations (array of struct with verified), chunk_ids (array),
    model, input_tokens, output_tokens, cost_usd, latency_ms, refusal_reason.
    """
    kept = lambda c, on: F.when(F.lit(on), F.nullif(F.col(c), F.lit(""))).cast("string").alias(c)
    return results.select(
        "id",
        "timestamp",
        kept("question", content),
        kept("answer", content),
        keyed_digest(F.col("question"), key).alias("question_hmac"),
        F.lit(int(content)).alias("content_logged"),
        kept("raw_model_output", raw),
        F.when(F.lit(raw) & (F.coalesce("raw_model_output", F.lit("")) != ""), F.lit(1)).otherwise(F.lit(0)).alias("raw_output_logged"),
        F.col("refused").cast("int").alias("refused"),
        injection_flag(F.col("question")).cast("int").alias("flagged_injection"),
        F.col("cache_hit").cast("int").alias("cache_hit"),
        F.size("citations").alias("citation_count"),
        F.size(F.filter("citations", lambda c: ~c["verified"])).alias("unverified_citation_count"),
        F.to_json("chunk_ids").alias("retrieved_chunk_ids"),
        "model",
        "input_tokens",
        "output_tokens",
        "cost_usd",
        "latency_ms",
        "refusal_reason",
    )


def log_stats(log: DataFrame) -> DataFrame:
    """Queries, mean latency, cost and refusal rate; zeros for an empty log."""
    zero = F.lit(0.0)
    return log.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.avg("latency_ms"), zero).alias("avg_latency_ms"),
        F.coalesce(F.sum("cost_usd"), zero).alias("total_cost_usd"),
        F.coalesce(F.avg(F.col("refused").cast("double")), zero).alias("refusal_rate"),
    )


def recent(log: DataFrame, limit: int) -> DataFrame:
    """The last rows by id."""
    return log.orderBy(F.col("id").desc()).limit(limit)


def retain(log: DataFrame, now: float, days: int = 30) -> DataFrame:
    """What retention keeps: rows at the limit stay."""
    return log.where(F.col("timestamp") >= F.lit(now - days * DAY))


def scrub(log: DataFrame) -> DataFrame:
    """Raw contents and their flags out of the rows that hold any; figures stay."""
    held = (F.coalesce("content_logged", F.lit(0)) != 0) | (F.coalesce("raw_output_logged", F.lit(0)) != 0)
    out = log
    for name in ("question", "answer", "raw_model_output"):
        out = out.withColumn(name, F.when(~held, F.col(name)))
    return out.withColumns({name: F.when(held, F.lit(0)).otherwise(F.col(name)) for name in ("content_logged", "raw_output_logged")})


def purge(log: DataFrame, dry_run: bool = False) -> tuple[int, DataFrame]:
    """How many rows hold contents, and the log without them (as it is on a dry run)."""
    n = log.where("coalesce(content_logged, 0) <> 0 or coalesce(raw_output_logged, 0) <> 0").count()
    return n, log if dry_run else scrub(log)


def migrate(old: DataFrame, schema: str = LOG_SCHEMA) -> DataFrame:
    """Rows of an older log under the present columns, missing ones null."""
    empty = old.sparkSession.createDataFrame([], schema)
    common = [c for c in empty.columns if c in old.columns]
    return empty.unionByName(old.select(*(F.col(c).cast(empty.schema[c].dataType).alias(c) for c in common)), allowMissingColumns=True)


def live(cache: DataFrame, now: float | Column) -> DataFrame:
    """Entries that may be served; one at its expiry is dead."""
    return cache.where(F.col("expires_at") > (F.lit(now) if isinstance(now, (int, float)) else now))


def upsert(cache: DataFrame, more: DataFrame, key: str = "question_hash", at: str = "created_at", tie: str | None = None) -> DataFrame:
    """The latest entry of each key.

    Combined within tasks (max of a struct) before the shuffle, so a hot key
    costs each task one row.
    """
    every = cache.unionByName(more)
    rest = [c for c in every.columns if c not in (key, at, tie)]
    best = F.max(F.struct(at, *([tie] if tie else []), F.struct(*rest).alias("_rest"))).alias("_b")
    return every.groupBy(key).agg(best).select(key, f"_b.{at}", *([f"_b.{tie}"] if tie else []), "_b._rest.*").select(every.columns)


def ttl_hits(requests: DataFrame, ttl: float, key: str = "key") -> DataFrame:
    """(key, at, hit): replay of a cache whose entries live ``ttl`` from their write.

    A hit doesn't extend an entry, so a key's requests depend on each other in
    order; they stream through one sorted pass, holding one number a key.
    """
    kind = requests.schema[key].dataType.simpleString()
    ordered = requests.select(key, "at", "seq").repartition(key).sortWithinPartitions(key, "at", "seq")

    def work(batches):
        last, until = None, 0.0
        for own in batches:
            hits = []
            for name, at in zip(own[key], own["at"], strict=True):
                if name != last:
                    last, until = name, float("-inf")
                hits.append(at < until)
                if not hits[-1]:
                    until = at + ttl
            yield pd.DataFrame({key: own[key], "at": own["at"], "seq": own["seq"], "hit": hits})

    return ordered.mapInPandas(work, f"{key} {kind}, at double, seq long, hit boolean")


def answer_with_cache(questions: DataFrame, cache: DataFrame, answer: object, now: float, fingerprint: str) -> DataFrame:
    """(question_id, question, answer, cache_hit, flagged_injection).

    Live entries serve; ``answer`` (DataFrame to DataFrame with ``answer``)
    is asked for the others only.
    """
    keyed = questions.withColumn("question_hash", question_key(F.lit(fingerprint), F.col("question")))
    held = live(cache, now).select("question_hash", F.col("answer").alias("_held"), F.lit(True).alias("_hit"))
    looked = keyed.join(held, "question_hash", "left")
    hits = looked.where("_hit").select("question_id", "question", F.col("_held").alias("answer"), F.lit(True).alias("cache_hit"))
    misses = answer(looked.where("_hit is null").select("question_id", "question")).select("question_id", "question", "answer", F.lit(False).alias("cache_hit"))
    return hits.unionByName(misses).withColumn("flagged_injection", injection_flag(F.col("question")))


def over_limit(requests: DataFrame, client: str, at: str, per_minute: int = 10) -> DataFrame:
    """(client, minute, n) of clients over their limit in a minute (an extension)."""
    minute = F.date_trunc("minute", F.col(at))
    return requests.groupBy(client, minute.alias("minute")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_minute)


def question_counts(questions: DataFrame, pattern: str) -> DataFrame:
    """(type, n, named): questions of each type and how many name an instrument."""
    return questions.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("question").rlike(pattern).cast("long")).alias("named"))


