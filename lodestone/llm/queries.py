"""The registered queries ``opN_<name>`` and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, filter_audit, language_id, line_dedup, lm_scoring, media, near_dedup, packing, periodic_runs, secrets, sentence_pieces, sharding, token_files
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.equal_text_groups(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_rows(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op4(spark, documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(spark, documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op6(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op7(spark, documents(spark, sf_dir))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.op8(documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.op9(spark, documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op10(spark, documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.op11(documents(spark, sf_dir))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op12(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_secrets": op1_secrets,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_packing": op3_packing,
        "op4_token_files": op4_token_files,
        "op5_near_dedup": op5_near_dedup,
        "op6_language_id": op6_language_id,
        "op7_line_dedup": op7_line_dedup,
        "op8_sentence_pieces": op8_sentence_pieces,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_media": op10_media,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_sharding": op12_sharding,
        "op13_filter_audit": op13_filter_audit,
    }


#: A-Z to a-z and nothing else, as the contracts lower.
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": r"""
            WITH rows AS (
                SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
            ), winners AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
            FROM rows JOIN winners USING (t)""",
        "op5_near_dedup": rf"""
            WITH RECURSIVE words AS (
                SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format(x="coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
            ), sets AS (
                SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words)
            ), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
            ), shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
            ), links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
            ), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
            ), least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
            SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id, d.doc_id <= coalesce(c, d.doc_id) AS kept
            FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON x = d.doc_id""",
        "op7_line_dedup": rf"""
            WITH lines AS (
                SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents)
            ), keyed AS (SELECT *, {_LOWER.format(x="regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS key FROM lines
            ), frequent AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keep <> doc_id) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (keep IS NULL OR keep = doc_id), '')) AS kept_sha256
            FROM keyed LEFT JOIN frequent USING (key) GROUP BY doc_id""",
        "op12_sharding": sharding.ORACLE_SQL,
        "op13_filter_audit": filter_audit.ORACLE_SQL,
    }
