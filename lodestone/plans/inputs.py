"""Inputs of the registered queries, made alike in Spark and in DuckDB.

The tables hold no citations, headings or pages, so those are derived from
ids and line numbers. ``SQL`` has the same inputs as common table expressions;
``with_sql`` puts those that a query names, and theirs, before it.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession

from ..session import table

#: One expression list for both engines; {raw} is a line, l its number from 0.
LINE_TEXT = """CASE WHEN l % 7 = 6 THEN concat(l % 30 + 1, '.1 ', raw) WHEN l % 11 = 3 THEN '08 July 2020'
    WHEN (doc_id + (l - l % 5) / 5) % 6 < 1 AND l % 2 = 0 THEN concat(raw, ' ..... ', l) WHEN l % 5 = 2 THEN concat(raw, '-') ELSE raw END"""
LINE_SIZE = "CASE WHEN (doc_id + l) % 13 = 4 THEN 14e0 ELSE 10e0 + length(raw) % 2 END"
PAGE = "CAST((l - l % 5) / 5 + 1 AS INT)"
LINES = f"SELECT doc_id, {PAGE} AS page, l AS line_no, {LINE_TEXT} AS text, {LINE_SIZE} AS size FROM raw_lines"

WORDS_OF = "regexp_replace(text, '[^a-zA-Z ]', ' '{g})"
#: The same in Spark: Java looks single letters up in one table, which is several times as fast as ranges.
SPARK_WORDS_OF = WORDS_OF.format(g="").replace("a-zA-Z", string.ascii_letters)
ANSWERS = """SELECT doc_id AS answer_id, CASE doc_id % 9
    WHEN 0 THEN 'I don''t have a source for that.'
    WHEN 1 THEN concat('Sorry: i don''t have a SOURCE for that. ', t)
    WHEN 2 THEN CASE WHEN doc_id % 4 = 1 THEN concat(t, ' [d', doc_id, ', p.12345678901234567890]') ELSE t END
    WHEN 3 THEN concat(t, ' (d3 p. 4)')
    WHEN 4 THEN concat(t, ' [d', doc_id, ', p.1]', {nl}, 'and more')
    WHEN 5 THEN concat(t, ' [d', doc_id, ', p.1-4]')
    WHEN 6 THEN concat('  ', t, ' [d', doc_id, ', p.1-2]', {nl}, {nl}, 'B ', t, ' [d', doc_id, ', p.2] [d', doc_id, ',p.3, 3.1] ')
    WHEN 7 THEN concat(t, ' [d', doc_id, ', p.2-1]')
    ELSE concat(t, CASE WHEN doc_id % 4 = 1 THEN ' [loi-é, p.1]' ELSE '' END, ' [d', doc_id, ', p.3]') END AS answer
    FROM (SELECT doc_id, {words} AS t FROM documents)"""
CONTEXTS = """SELECT doc_id AS answer_id, r AS rank, concat('c', doc_id, '-', r) AS chunk_id, concat('d', doc_id) AS doc_id, CAST(r AS INT) AS page_start,
    CAST(r + 1 AS INT) AS page_end, CASE WHEN r = 2 THEN CAST(NULL AS {string}) WHEN doc_id % 3 = 0 THEN concat('Section ', doc_id % 40 + 1, 'A. Scope') WHEN doc_id % 3 = 1 THEN '8.1.2 Terms' ELSE '2023 Notes' END AS section,
    concat('Block ', r, ' of ', source) AS text FROM documents CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2) AS two"""
MANIFEST = """SELECT concat('d', doc_id) AS id, concat('Directive ', doc_id, '/20', 10 + doc_id % 15, ': ', source) AS title,
    CASE WHEN doc_id % 10 = 3 THEN concat('a file ', doc_id, '.pdf') ELSE concat('f', doc_id - doc_id % 2, '.pdf') END AS filename,
    concat(CASE WHEN doc_id % 9 = 0 THEN 'http' ELSE 'https' END, '://example.org/', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '' END) AS download_url,
    'https://example.org/list' AS landing_page_url, 'https://example.org/' AS referer, {sha} AS sha256, 'Publisher' AS publisher, concat('Authority ', lang) AS issuing_authority,
    'Directive' AS document_type, CASE WHEN doc_id % 2 = 0 THEN 'primary_legislation' WHEN doc_id % 11 = 5 THEN 'rumour' ELSE 'accounting_standard' END AS authority_level,
    CASE doc_id % 5 WHEN 0 THEN 'consultation' WHEN 1 THEN CAST(NULL AS {string}) ELSE 'final' END AS publication_stage,
    CASE WHEN doc_id % 17 = 0 THEN '2021-02-30' WHEN doc_id % 17 = 3 THEN '2 May 2020' ELSE '2020-05-02' END AS published_date,
    CASE doc_id % 6 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'superseded' WHEN 2 THEN 'historical_snapshot' WHEN 3 THEN 'unknown' ELSE 'current' END AS current_status,
    CASE WHEN doc_id % 13 = 0 THEN '2019-01-31' ELSE '2024-01-31' END AS status_as_of, 'https://example.org/status' AS status_source_url, doc_id % 7 = 0 AS is_third_party,
    CASE WHEN doc_id % 4 = 0 THEN concat('d', doc_id + 1) WHEN doc_id % 16 = 2 THEN 'outside' END AS status_source_id, CAST(CASE WHEN doc_id % 8 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN 3 END AS INT) AS status_source_page,
    CASE WHEN doc_id % 19 = 1 THEN 'image' WHEN doc_id % 3 = 0 THEN 'ocr' END AS text_layer, CAST(doc_id AS INT) AS manifest_ord FROM documents"""
#: Ranked results of benchmark questions: every fourth question finds its own text.
ITEMS = """SELECT doc_id AS item_id, CASE doc_id % 5 WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'multi' ELSE 'single' END AS type, toxic = 1 AS refused,
    CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'model_refusal' ELSE 'uncited_line' END END AS refusal_reason, doc_id % 4 AS ok, doc_id % 4 + quality AS total,
    doc_id % 3 > 0 AS any_hit, doc_id % 3 = 2 AS all_hit, doc_id % 4 AS served_citations, CAST(0 AS BIGINT) AS served_unverified, doc_id % 2 AS served_with_section,
    doc_id % 11 = 0 AS repair_attempted, CASE WHEN doc_id % 37 = 0 THEN 'timeout' END AS error, doc_id % 7 / 1024e0 AS cost_usd FROM labels"""
LOG = """SELECT event_id AS id, {epoch} AS timestamp, concat('question ', user_id) AS question, CASE WHEN event_id % 3 = 0 THEN props END AS answer, CAST(event_id % 2 AS INT) AS content_logged,
    CASE WHEN event_id % 5 = 0 THEN 'raw' END AS raw_model_output, CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS raw_output_logged, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT) AS refused,
    value AS latency_ms, value / 1000 AS cost_usd FROM events"""
NOW = 1_705_000_000

SQL = {
    "raw_lines": "SELECT doc_id, source, CAST(generate_subscripts(w, 1) - 1 AS INT) AS l, unnest(w) AS raw FROM (SELECT *, string_split(text, chr(10)) AS w FROM documents)",
    "lines": LINES,
    "answers": ANSWERS.format(nl="chr(10)", words=WORDS_OF.format(g=", 'g'")),
    "contexts": CONTEXTS.format(string="VARCHAR"),
    "manifest": MANIFEST.format(string="VARCHAR", sha="sha256(source)"),
    "items": ITEMS,
    "log": LOG.format(epoch="epoch(ts)"),
    # Pages of citations, one row each: array positions by unnesting both.
    "tokens": r"SELECT answer_id, generate_subscripts(t, 1) AS k, unnest(t) AS token FROM (SELECT answer_id, regexp_extract_all(answer, '\[[\p{L}\p{N}_\-\.]+,\s*p\.\d+(?:-\d+)?(?:,[^\]]*)?\]') AS t FROM answers)",
    "spans": r"SELECT answer_id, k, regexp_extract(token, '\[([\p{L}\p{N}_\-\.]+),', 1) AS doc_id, a, CASE WHEN regexp_matches(token, 'p\.\d+-\d') THEN TRY_CAST(regexp_extract(token, 'p\.\d+-(\d+)', 1) AS INT) ELSE a END AS b FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(token, 'p\.(\d+)', 1) AS INT), 2147483647) AS a FROM tokens)",
    "cites": "SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY k, page) AS cite_no, doc_id, page FROM (SELECT answer_id, k, doc_id, CAST(unnest(generate_series(a, b)) AS INT) AS page FROM spans WHERE b >= a)",
    "verified": """SELECT c.*, EXISTS (SELECT 1 FROM contexts x WHERE x.answer_id = c.answer_id AND x.doc_id = c.doc_id AND c.page BETWEEN x.page_start AND x.page_end) AS verified,
        (SELECT x.section FROM contexts x WHERE x.answer_id = c.answer_id AND x.doc_id = c.doc_id AND c.page BETWEEN x.page_start AND x.page_end ORDER BY x.page_start, x.chunk_id LIMIT 1) AS section FROM cites c""",
    "terms": "SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[/.][a-z0-9]+)*')) AS term FROM documents",
    "asked": "SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[/.][a-z0-9]+)*')) AS term FROM benchmark",
    "bm25": """SELECT question_id, chunk_id, sum(times * (CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score
        FROM (SELECT question_id, term, count(*) AS times FROM asked GROUP BY ALL) q
        JOIN (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf, avg(ln(n - df + 0.5) - ln(df + 0.5)) OVER () AS mean FROM (SELECT term, count(DISTINCT chunk_id) AS df FROM terms GROUP BY term) CROSS JOIN (SELECT count(*) AS n FROM documents)) USING (term)
        JOIN (SELECT chunk_id, term, count(*) AS tf FROM terms GROUP BY ALL) USING (term)
        JOIN (SELECT chunk_id, count(*) AS len FROM terms GROUP BY chunk_id) USING (chunk_id)
        CROSS JOIN (SELECT (SELECT count(*) FROM terms) / count(*) AS avgdl FROM documents) GROUP BY ALL""",
    "bm25_ranked": "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm25",
    "cosine": """SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, c.label AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
        FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 50 = 0""",
    "cosine_ranked": "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM cosine",
    "word_lists": r"SELECT *, list_filter(regexp_split_to_array(text, '[\x09-\x0D ]+'), lambda w: w <> '') AS w FROM documents",
}


def with_sql(query: str) -> str:
    """The query after the inputs that it names, in order of dependence."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(SQL[name])
                needed.append(name)

    need(query)
    own = query.strip()
    parts = [f"{n} AS ({SQL[n]})" for n in needed]
    if own.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {own[5:]}" if parts else own
    return f"WITH {', '.join(parts)} {own}" if parts else own


def _sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    for name in frames:
        text = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **frames)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "posexplode(split(text, '\\n')) AS (l, raw)")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, LINES, raw_lines=raw_lines(spark, sf_dir))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, ANSWERS.replace("{nl}", "char(10)").replace("{words}", SPARK_WORDS_OF), documents=table(spark, sf_dir, "documents"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, CONTEXTS.replace("{string}", "STRING"), documents=table(spark, sf_dir, "documents"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, MANIFEST.replace("{string}", "STRING").replace("{sha}", "sha2(source, 256)"), documents=table(spark, sf_dir, "documents"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, ITEMS, labels=table(spark, sf_dir, "labels"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, LOG.replace("{epoch}", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6"), events=table(spark, sf_dir, "events"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS chunk_id", "doc_id", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr("item_id AS question_id", "text AS question")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS chunk_id", "label AS doc_id", "embedding AS vector")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query vectors: every row whose id is divisible by 50, against all rows."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").selectExpr("vec_id AS question_id", "embedding AS vector")
