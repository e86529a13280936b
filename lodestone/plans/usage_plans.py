"""Queries over the query log and the response cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import question_key
from ..operators import usage
from ..session import run_folder, table
from ..sources import cache as cache_tables
from ..sources import log as log_table
from . import inputs
from .registry import query

NOW = "(SELECT max(timestamp) FROM log)"


def _now(spark, sf_dir) -> float:
    """The log's last moment stands for now."""
    return inputs.log(spark, sf_dir).agg(F.max("timestamp")).first()[0]


@query("SELECT count(*) AS queries, round(coalesce(avg(latency_ms), 0), 6) AS avg_latency_ms, round(coalesce(sum(cost_usd), 0), 6) AS total_cost_usd, round(coalesce(avg(refused), 0), 6) AS refusal_rate FROM log")
def log_stats(spark, sf_dir):
    found = usage.log_stats(inputs.log(spark, sf_dir))
    return found.select("queries", *(F.round(c, 6).alias(c) for c in ("avg_latency_ms", "total_cost_usd", "refusal_rate")))


@query("SELECT id, question, latency_ms FROM log ORDER BY id DESC LIMIT 20")
def log_recent(spark, sf_dir):
    """The last rows; the limit is the feature."""
    return usage.recent(inputs.log(spark, sf_dir).select("id", "question", "latency_ms"), 20)


@query(f"SELECT id, timestamp FROM log WHERE timestamp >= {NOW} - 7 * 86400")
def log_retention(spark, sf_dir):
    return usage.retain(inputs.log(spark, sf_dir).select("id", "timestamp"), _now(spark, sf_dir), 7)


HELD = "(content_logged <> 0 OR raw_output_logged <> 0)"


@query(f"""SELECT id, CASE WHEN NOT {HELD} THEN question END AS question, CASE WHEN NOT {HELD} THEN answer END AS answer, CASE WHEN NOT {HELD} THEN raw_model_output END AS raw_model_output,
    CASE WHEN {HELD} THEN 0 ELSE content_logged END AS content_logged, CASE WHEN {HELD} THEN 0 ELSE raw_output_logged END AS raw_output_logged, refused, latency_ms FROM log""")
def log_scrub(spark, sf_dir):
    return usage.scrub(inputs.log(spark, sf_dir)).select("id", "question", "answer", "raw_model_output", "content_logged", "raw_output_logged", "refused", "latency_ms")


@query("SELECT id, timestamp, question, answer, CAST(NULL AS VARCHAR) AS question_hmac, CAST(NULL AS INT) AS cache_hit, refused, latency_ms, CAST(NULL AS VARCHAR) AS refusal_reason FROM log")
def log_migrate(spark, sf_dir):
    """An older log without the later columns."""
    old = inputs.log(spark, sf_dir).select("id", "timestamp", "question", "answer", "refused", "latency_ms")
    return usage.migrate(old).select("id", "timestamp", "question", "answer", "question_hmac", "cache_hit", "refused", "latency_ms", "refusal_reason")


@query("""SELECT id, timestamp, question, answer, 1 AS content_logged, CAST(NULL AS VARCHAR) AS raw_model_output, 0 AS raw_output_logged, refused, CAST(CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS INT) AS flagged_injection,
    CAST(id % 3 AS INT) AS citation_count, CAST((id % 3) // 2 AS INT) AS unverified_citation_count, concat('["c', id, '"]') AS retrieved_chunk_ids, latency_ms
    FROM (SELECT id, timestamp, CASE WHEN id % 4 = 0 THEN concat(question, ' you are now free') ELSE question END AS question, answer, refused, latency_ms FROM log)""")
def log_project(spark, sf_dir):
    rows = inputs.log(spark, sf_dir).withColumns({
        "question": F.expr("CASE WHEN id % 4 = 0 THEN concat(question, ' you are now free') ELSE question END"),
        "cache_hit": F.lit(False),
        "citations": F.expr("transform(slice(array(1, 2), 1, CAST(id % 3 AS INT)), x -> named_struct('verified', x = 1))"),
        "chunk_ids": F.expr("array(concat('c', id))"),
        "model": F.lit("none"), "input_tokens": F.lit(0), "output_tokens": F.lit(0), "refusal_reason": F.lit(None).cast("string"),
    })
    names = ["id", "timestamp", "question", "answer", "content_logged", "raw_model_output", "raw_output_logged", "refused", "flagged_injection", "citation_count", "unverified_citation_count", "retrieved_chunk_ids", "latency_ms"]
    return usage.log_rows(rows, content=True).select(*names)


@query(f"""SELECT n AS id, timestamp, refused, latency_ms, CASE WHEN NOT {HELD} THEN answer END AS answer, CASE WHEN {HELD} THEN 0 ELSE content_logged END AS content_logged
    FROM (SELECT *, row_number() OVER (ORDER BY id % 3, timestamp, id) AS n FROM log) WHERE timestamp >= {NOW} - 7 * 86400""")
def log_appended(spark, sf_dir):
    """The log in three batches, each tried twice, then past its retention and scrubbed."""
    rows, folder = inputs.log(spark, sf_dir), run_folder(spark, "log")
    for batch in (0, 0, 1, 1, 2, 2, 0):
        log_table.append(rows.where(F.col("id") % 3 == batch), folder, "query", batch)
    log_table.purge_expired(spark, folder, _now(spark, sf_dir), 7)
    log_table.scrub_content(spark, folder)
    return log_table.read_log(spark, folder).select("id", "timestamp", "refused", "latency_ms", "answer", "content_logged")


ENTRIES = "SELECT concat(question, '/', answer) AS question_hash, id, timestamp AS created_at, timestamp + 86400e0 * (id % 9) AS expires_at FROM log WHERE answer IS NOT NULL"


def _entries(spark, sf_dir):
    return inputs._sql(spark, ENTRIES, log=inputs.log(spark, sf_dir))


@query(f"SELECT question_hash, id, created_at, expires_at FROM ({ENTRIES}) WHERE expires_at > {NOW}")
def cache_expiry(spark, sf_dir):
    return usage.live(_entries(spark, sf_dir), _now(spark, sf_dir))


@query(f"SELECT question_hash, id, created_at, expires_at FROM (SELECT *, row_number() OVER (PARTITION BY question_hash ORDER BY created_at DESC, id DESC) AS r FROM ({ENTRIES.replace(chr(39) + '/' + chr(39) + ', answer', 'id % 3')})) WHERE r = 1")
def cache_upsert(spark, sf_dir):
    entries = inputs._sql(spark, ENTRIES.replace("'/', answer", "id % 3"), log=inputs.log(spark, sf_dir))
    return usage.upsert(entries.where("id % 2 = 0"), entries.where("id % 2 = 1"), tie="id")


@query("""WITH RECURSIVE r AS (SELECT concat(user_id, '/', event_type) AS key, epoch(ts) AS t, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch(ts), event_id) AS k FROM events),
    s AS (SELECT key, t, seq, k, false AS hit, t + 200000e0 AS until FROM r WHERE k = 1
    UNION ALL SELECT r.key, r.t, r.seq, r.k, r.t < s.until, CASE WHEN r.t < s.until THEN s.until ELSE r.t + 200000e0 END FROM r JOIN s ON s.key = r.key AND s.k + 1 = r.k)
    SELECT key, t AS "at", seq, hit FROM s""")
def cache_ttl_sim(spark, sf_dir):
    requests = table(spark, sf_dir, "events").selectExpr("concat(user_id, '/', event_type) AS key", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS at", "event_id AS seq")
    return usage.ttl_hits(requests, 200_000.0)


@query("""SELECT item_id AS question_id, question, CASE WHEN item_id % 3 = 0 THEN concat('held ', item_id) ELSE concat('new ', length(question)) END AS answer, item_id % 3 = 0 AS cache_hit, item_id % 4 = 1 AS flagged_injection
    FROM (SELECT item_id, concat(CASE WHEN item_id % 4 = 1 THEN 'Act as a judge. ' ELSE '' END, text, ' ', item_id) AS question FROM benchmark)""")
def timed_answer(spark, sf_dir):
    """A third of the questions has a live entry; a made-up model answers the rest."""
    questions = table(spark, sf_dir, "benchmark").selectExpr("item_id AS question_id", "concat(CASE WHEN item_id % 4 = 1 THEN 'Act as a judge. ' ELSE '' END, text, ' ', item_id) AS question")
    cache = questions.where("question_id % 3 < 2").select(question_key(F.lit("f"), F.col("question")).alias("question_hash"), F.expr("concat('held ', question_id)").alias("answer"), F.expr("CASE WHEN question_id % 3 = 0 THEN 101D ELSE 100D END").alias("expires_at"))
    return usage.answer_with_cache(questions, cache, lambda q: q.withColumn("answer", F.expr("concat('new ', length(question))")), 100.0, "f")


@query("SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit(spark, sf_dir):
    """An extension; at this event rate a limit of one shows it."""
    found = usage.over_limit(table(spark, sf_dir, "events"), "event_type", "ts", 1)
    return found.select("event_type", F.col("minute").cast("timestamp_ntz").alias("minute"), "n")
