"""Queries that measure: metrics, agreement, comparisons, samples, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import NAMED_INSTRUMENT
from ..operators import evaluation as E
from ..operators import usage
from ..session import table, written
from . import inputs, retrieval_plans
from .registry import query

LOW = "greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n))"
HIGH = "least(1, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n))"


def flat(frame, *names):
    """Ratios as columns, their figures rounded."""
    for name in names:
        frame = frame.select("*", *(F.col(f"{name}.{f}").alias(f"{name}_{f}") for f in ("k", "n")), *(F.round(F.col(f"{name}.{f}"), 6).alias(f"{name}_{f}") for f in ("rate", "lo", "hi"))).drop(name)
    return frame


def flat_sql(k: str, n: str, name: str) -> str:
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    fill = lambda x: x.replace("k / n", f"({k}) / ({n})").replace("/ n", f"/ ({n})").replace("* n", f"* ({n})")
    own = f"CASE WHEN {n} > 0 THEN round({{}}, 6) END AS {name}_"
    return f"CAST({k} AS BIGINT) AS {name}_k, CAST({n} AS BIGINT) AS {name}_n, {own.format(f'{k} / {n}')}rate, {own.format(fill(LOW))}lo, {own.format(fill(HIGH))}hi"


@query(f"SELECT lang, {flat_sql('k', 'n', 'quality')} FROM (SELECT lang, count(*) AS n, sum(quality) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def wilson(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return flat(joined.groupBy("lang").agg(stats.ratio(F.sum("quality").cast("long"), F.count(F.lit(1))).alias("quality")), "quality")


def _sum(when: str) -> str:
    return f"coalesce(sum(CASE WHEN {when} THEN 1 ELSE 0 END), 0)"


ANSWERABLE, SERVED = "type <> 'unanswerable'", "CASE WHEN NOT refused THEN {} ELSE 0 END"


@query(f"""SELECT count(*) AS n, {flat_sql(_sum(ANSWERABLE + ' AND NOT refused'), _sum(ANSWERABLE), 'answer_rate')}, {flat_sql(_sum("type = 'unanswerable' AND refused"), _sum("type = 'unanswerable'"), 'refusal_recall')},
    {flat_sql(_sum("(type <> 'unanswerable') <> refused"), 'count(*)', 'task_outcome')}, {flat_sql('sum(ok)', 'sum(total)', 'raw_citation_precision')}, CAST(sum({SERVED.format('served_citations')}) AS BIGINT) AS served_citations,
    CAST(0 AS BIGINT) AS served_unverified_citations, {flat_sql(f'sum({SERVED.format("served_with_section")})', f'sum({SERVED.format("served_citations")})', 'section_ref_rate')},
    {flat_sql(_sum(ANSWERABLE + ' AND any_hit'), _sum(ANSWERABLE), 'retrieval_any_hit')}, {flat_sql(_sum(ANSWERABLE + ' AND all_hit'), _sum(ANSWERABLE), 'retrieval_all_hit')},
    CAST({_sum('repair_attempted')} AS BIGINT) AS repairs, CAST({_sum('error IS NOT NULL')} AS BIGINT) AS failed_items, round_even(sum(cost_usd), 4) AS cost_usd FROM items""")
def run_metrics(spark, sf_dir):
    found = E.run_metrics(inputs.items(spark, sf_dir))
    return flat(found, "answer_rate", "refusal_recall", "task_outcome", "raw_citation_precision", "section_ref_rate", "retrieval_any_hit", "retrieval_all_hit")


@query("SELECT refusal_reason, count(*) AS n FROM items WHERE refused GROUP BY refusal_reason")
def refusal_histogram(spark, sf_dir):
    return E.refusal_histogram(inputs.items(spark, sf_dir))


EVIDENCE = "SELECT doc_id AS item_id, concat('d', doc_id - r % 2) AS doc_id, CAST((doc_id + r) % 4 AS INT) AS page FROM documents CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2) AS two WHERE doc_id % 10 > 0"


@query(f"""WITH hits AS (SELECT e.item_id, e.doc_id, bool_or(x.chunk_id IS NOT NULL) AS hit FROM ({EVIDENCE}) e LEFT JOIN contexts x ON x.answer_id = e.item_id AND x.doc_id = e.doc_id AND e.page BETWEEN x.page_start AND x.page_end GROUP BY ALL)
    SELECT d.doc_id AS item_id, coalesce(bool_or(hit), false) AS any_hit, coalesce(bool_and(hit), false) AS all_hit FROM documents d LEFT JOIN hits h ON h.item_id = d.doc_id GROUP BY d.doc_id""")
def evidence_hit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    evidence = inputs._sql(spark, EVIDENCE, documents=docs)
    contexts = inputs.contexts(spark, sf_dir).withColumnRenamed("answer_id", "item_id")
    return E.evidence_hits(evidence, contexts, docs.selectExpr("doc_id AS item_id"))


HOLDS = "SELECT b.item_id AS question_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


def _relevant(spark, sf_dir):
    """Documents that hold a benchmark text."""
    from ..operators import retrieval as R

    return R.holding(inputs.questions(spark, sf_dir), inputs.chunks(spark, sf_dir))


@query(f"""SELECT item_id AS question_id, first_rank, round(coalesce(1e0 / first_rank, 0), 6) AS reciprocal FROM benchmark LEFT JOIN
    (SELECT question_id, min(rank) AS first_rank FROM (SELECT * FROM bm25_ranked WHERE rank <= 10) JOIN ({HOLDS}) USING (question_id, chunk_id) GROUP BY question_id) ON question_id = item_id""")
def retrieval_mrr(spark, sf_dir):
    from ..operators import retrieval as R

    ranked = R.top(retrieval_plans._bm25(spark, sf_dir, 10), 10)
    found = E.first_hits(ranked, _relevant(spark, sf_dir), inputs.questions(spark, sf_dir))
    return found.select("question_id", F.col("first_rank").cast("long").alias("first_rank"), F.round("reciprocal", 6).alias("reciprocal"))


RESULTS = "SELECT CASE WHEN l.doc_id % 2 = 0 THEN 'wordpiece' ELSE 'baseline' END AS config, CASE WHEN lang = 'en' THEN 'bm25' ELSE 'semantic' END AS strategy, quality = 1 AS rerank, CASE l.doc_id % 5 WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'multi' ELSE 'single' END AS type, l.doc_id % 3 > 0 AS any_hit, l.doc_id % 3 = 2 AS all_hit, CASE WHEN l.doc_id % 3 > 0 THEN 1e0 / (l.doc_id % 4 + 1) ELSE 0e0 END AS reciprocal FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


@query(f"""SELECT config, strategy, rerank, count(*) AS n, CAST(sum(CASE WHEN any_hit THEN 1 ELSE 0 END) AS BIGINT) AS any_hit, CAST(sum(CASE WHEN all_hit THEN 1 ELSE 0 END) AS BIGINT) AS all_hit,
    CAST(sum(CASE WHEN all_hit AND type = 'multi' THEN 1 ELSE 0 END) AS BIGINT) AS multi_all_hit, CAST(sum(CASE WHEN type = 'multi' THEN 1 ELSE 0 END) AS BIGINT) AS multi_n, round_even(avg(reciprocal), 3) AS mrr
    FROM ({RESULTS}) WHERE type <> 'unanswerable' GROUP BY ALL""")
def retrieval_bench(spark, sf_dir):
    results = inputs._sql(spark, RESULTS.replace("JOIN documents d", "JOIN documents AS d"), labels=table(spark, sf_dir, "labels"), documents=table(spark, sf_dir, "documents"))
    return E.retrieval_table(results, ["config", "strategy", "rerank"])


BENCH = """SELECT k, question_id, CASE WHEN count(chunk_id) = 0 THEN 'unanswerable' WHEN count(chunk_id) = 1 THEN 'single' ELSE 'multi' END AS type, count(chunk_id) AS wanted,
    count(rank) FILTER (rank <= k) AS found, min(rank) FILTER (rank <= k) AS first FROM (SELECT 5 AS k UNION ALL SELECT 20) CROSS JOIN (SELECT item_id AS question_id FROM benchmark)
    LEFT JOIN ({holds}) USING (question_id) LEFT JOIN (SELECT question_id, chunk_id, rank FROM bm25_ranked WHERE rank <= 20) USING (question_id, chunk_id) GROUP BY ALL"""


@query(f"""SELECT k, count(*) AS n, count(*) FILTER (found > 0) AS any_hit, count(*) FILTER (found = wanted) AS all_hit, count(*) FILTER (found = wanted AND type = 'multi') AS multi_all_hit, count(*) FILTER (type = 'multi') AS multi_n,
    round_even(avg(coalesce(1e0 / first, 0)), 3) AS mrr FROM ({BENCH.format(holds=HOLDS)}) WHERE type <> 'unanswerable' GROUP BY k""")
def bench_run(spark, sf_dir):
    """The figures of a real run over the tables: BM25's best five and twenty, relevant is what holds the question."""
    from ..operators import retrieval as R

    ranked = written(R.top(retrieval_plans._bm25(spark, sf_dir, 20), 20).select("question_id", "chunk_id", "rank"), "ranked")
    relevant = written(_relevant(spark, sf_dir), "relevant")
    runs = [E.run_results(ranked, relevant, inputs.questions(spark, sf_dir), k).withColumn("k", F.lit(k)) for k in (5, 20)]
    return E.retrieval_table(runs[0].unionByName(runs[1]), ["k"])


#: Two judges' labels of the same texts: the second one judged some others, too.
JUDGES = ("SELECT doc_id, quality AS label FROM labels", "SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END AS label FROM documents")


@query(f"""WITH t AS (SELECT count(*) AS n, avg(CASE WHEN a.label = b.label THEN 1e0 ELSE 0 END) AS po, avg(a.label) * avg(b.label) + (1 - avg(a.label)) * (1 - avg(b.label)) AS pe FROM ({JUDGES[0]}) a JOIN ({JUDGES[1]}) b USING (doc_id))
    SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM t""")
def kappa(spark, sf_dir):
    one = inputs._sql(spark, JUDGES[0], labels=table(spark, sf_dir, "labels"))
    two = inputs._sql(spark, JUDGES[1], documents=table(spark, sf_dir, "documents"))
    return stats.kappa(E.judged_by_both(one, two, "doc_id", "label"), "a", "b").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("""SELECT a, b, count(doc_id) AS n FROM (SELECT 0 AS a UNION ALL SELECT 1) CROSS JOIN (SELECT 0 AS b UNION ALL SELECT 1) LEFT JOIN labels ON quality = a AND toxic = b GROUP BY a, b""")
def confusion(spark, sf_dir):
    return stats.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


JUDGED = """SELECT CASE doc_id % 5 WHEN 0 THEN 'unanswerable' ELSE 'single' END AS type, CASE WHEN doc_id % 5 = 0 AND toxic = 0 THEN 'answered_unanswerable' WHEN toxic = 1 THEN 'refused' WHEN quality = 1 THEN 'correct' WHEN doc_id % 3 = 0 THEN 'partial' WHEN doc_id % 3 = 1 THEN 'incorrect' ELSE 'unparsed' END AS correctness,
    CASE doc_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'partial' WHEN 2 THEN 'unsupported' END AS support FROM labels"""


def _labelled(field: str, value: str, name: str) -> str:
    return f"CAST({_sum(f'{ANSWERABLE} AND {field} = {chr(39)}{value}{chr(39)}')} AS BIGINT) AS {name}"


@query(f"""SELECT CAST({_sum(ANSWERABLE)} AS BIGINT) AS answerable, {', '.join(_labelled('correctness', v, v) for v in ('correct', 'partial', 'incorrect', 'refused', 'unparsed'))},
    {', '.join(_labelled('support', v, 'support_' + v) for v in ('supported', 'partial', 'unsupported', 'unparsed'))}, CAST({_sum("correctness = 'answered_unanswerable'")} AS BIGINT) AS answered_unanswerable FROM ({JUDGED})""")
def judge_summary(spark, sf_dir):
    return E.judge_summary(inputs._sql(spark, JUDGED, labels=table(spark, sf_dir, "labels")))


@query("""WITH p AS (SELECT a.doc_id IS NOT NULL AS ia, b.doc_id IS NOT NULL AS ib, CAST(a.quality AS DOUBLE) AS va, CAST(b.toxic AS DOUBLE) AS vb FROM (SELECT * FROM labels WHERE doc_id % 7 > 0) a FULL JOIN (SELECT * FROM labels WHERE doc_id % 5 > 0) b USING (doc_id))
    SELECT count(*) FILTER (ia AND ib) AS shared, count(*) FILTER (NOT ia) AS entered, count(*) FILTER (NOT ib) AS "left", round(avg(va) FILTER (ia AND ib), 6) AS mean_before, round(avg(vb) FILTER (ia AND ib), 6) AS mean_after,
    count(*) FILTER (vb > va) AS wins, count(*) FILTER (vb < va) AS losses, count(*) FILTER (vb = va) AS ties FROM p""")
def paired_compare(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    found = E.paired_compare(labels.where("doc_id % 7 > 0"), labels.where("doc_id % 5 > 0").withColumn("quality", F.col("toxic")), "doc_id", "quality")
    return found.drop("p_value").withColumns({c: F.round(c, 6) for c in ("mean_before", "mean_after")})


@query("""WITH p AS (SELECT lang, count(*) FILTER (quality > toxic) AS w, count(*) FILTER (quality < toxic) AS l FROM labels JOIN documents USING (doc_id) GROUP BY lang), t AS (SELECT lang, w, l, unnest(generate_series(0, CAST(least(w, l) AS INT))) AS i FROM p)
    SELECT lang, w AS wins, l AS losses, round(CASE WHEN w + l = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2)))) END, 9) AS p_value FROM t GROUP BY lang, w, l""")
def sign_test(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    counted = joined.groupBy("lang").agg(F.sum((F.col("quality") > F.col("toxic")).cast("long")).alias("wins"), F.sum((F.col("quality") < F.col("toxic")).cast("long")).alias("losses"))
    return counted.withColumn("p_value", F.round(stats.sign_test(F.col("wins"), F.col("losses")), 9))


@query("""SELECT event_id, user_id, CAST(running AS BIGINT) AS running FROM (SELECT *, lag(running, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM
    (SELECT event_id, user_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events)) WHERE before <= 50000""")
def budget_prefix(spark, sf_dir):
    """Costs in hundredths, so that running sums are exact in both engines."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cost"))
    return E.budget_prefix(events, ["user_id"], "event_id", "cost", 50000).select("event_id", "user_id", "running")


def place(p: float) -> str:
    return f"list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*) * {p}e0) AS BIGINT)) + 1]"


@query(f"SELECT event_type, {place(0.5)} AS p50, {place(0.95)} AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def nearest_rank(spark, sf_dir):
    return stats.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query(f"SELECT event_type, {place(0.5)} AS p50, {place(0.95)} AS p95, round(avg(value / 1000), 6) AS mean_cost, count(*) FILTER (event_id % 4 = 0) AS hits FROM events WHERE value IS NOT NULL GROUP BY event_type")
def perf_pass(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    ranks = stats.nearest_rank(events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    means = events.groupBy("event_type").agg(F.round(F.avg(F.col("value") / 1000), 6).alias("mean_cost"), F.sum((F.col("event_id") % 4 == 0).cast("long")).alias("hits"))
    return ranks.join(means, "event_type")


# USD a million tokens in and out; any table of this shape will do.
PRICES = (("click", 1.0, 5.0), ("view", 0.15, 0.6), ("error", 2.5, 10.0))
PRICES_SQL = " UNION ALL ".join(f"SELECT '{m}' AS event_type, {a}e0 AS price_in, {b}e0 AS price_out" for m, a, b in PRICES)


@query(f"SELECT event_id, round(CASE WHEN price_in IS NULL THEN NULL ELSE (user_id * price_in + event_id * price_out) / 1e6 END, 9) AS estimate, round(coalesce((user_id * price_in + event_id * price_out) / 1e6, 0), 9) AS cost FROM events LEFT JOIN ({PRICES_SQL}) USING (event_type)")
def cost_estimate(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "event_type string, price_in double, price_out double")
    joined = table(spark, sf_dir, "events").join(F.broadcast(prices), "event_type", "left")  # a constant table
    cost = F.round(stats.token_cost(F.col("user_id"), F.col("event_id"), F.col("price_in"), F.col("price_out")), 9)
    return joined.select("event_id", cost.alias("estimate"), F.coalesce(cost, F.lit(0.0)).alias("cost"))


@query("SELECT item_id AS id, sha256(concat('review-1:', item_id)) AS digest FROM benchmark ORDER BY digest LIMIT 20")
def hash_sample(spark, sf_dir):
    """A sampling operator; the limit is the feature."""
    return E.hash_sample(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "review-1", 20)


@query("""WITH i AS (SELECT item_id AS id, refused FROM items), n AS (SELECT greatest(12 - count(*), 0) AS room FROM i WHERE refused)
    SELECT id, refused FROM (SELECT *, row_number() OVER (PARTITION BY refused ORDER BY id) AS r FROM i) CROSS JOIN n WHERE refused OR r <= room""")
def fixture_sample(spark, sf_dir):
    """A sampling operator; the limit is the feature."""
    return E.fixture_sample(inputs.items(spark, sf_dir).selectExpr("item_id AS id", "refused"))


@query("""SELECT i.item_id AS id, concat('a', i.item_id) AS answer, CASE WHEN i.item_id % 3 > 0 THEN concat('b', i.item_id) END AS closed_answer,
    CASE WHEN i.item_id % 4 > 0 THEN concat('q', i.ok) END AS rag_one, CASE WHEN i.item_id % 5 > 0 THEN concat('l', i.total) END AS rag_two, CASE WHEN i.item_id % 6 = 0 THEN concat('c', i.ok) END AS closed_one, CAST(NULL AS VARCHAR) AS closed_two FROM items i""")
def explorer_join(spark, sf_dir):
    items = inputs.items(spark, sf_dir)
    label = lambda when, run, judge, value: items.where(when).selectExpr("item_id AS id", f"'{run}' AS run", f"'{judge}' AS judge", f"{value} AS label")
    labels = label("item_id % 4 > 0", "rag", "one", "concat('q', ok)").union(label("item_id % 5 > 0", "rag", "two", "concat('l', total)")).union(label("item_id % 6 = 0", "closed", "one", "concat('c', ok)"))
    return E.explorer(items.selectExpr("item_id AS id", "concat('a', item_id) AS answer"), items.where("item_id % 3 > 0").selectExpr("item_id AS id", "concat('b', item_id) AS answer"), labels, ["one", "two"])


@query(f"SELECT d.id, m.title FROM (SELECT doc_id AS id FROM cites UNION SELECT doc_id FROM ({EVIDENCE})) d JOIN manifest m USING (id)")
def explorer_titles(spark, sf_dir):
    from ..operators import citations

    cited = citations.extract(inputs.answers(spark, sf_dir)).select("doc_id")
    evidence = inputs._sql(spark, EVIDENCE, documents=table(spark, sf_dir, "documents")).select("doc_id")
    named = cited.union(evidence).distinct().withColumnRenamed("doc_id", "id")
    return named.join(inputs.manifest(spark, sf_dir).select("id", "title"), "id")


@query("SELECT type, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(question, '(?i)(directive|guidance note|guideline|circular|conduct standard)\\s+\\d|\\b[a-z]\\d{1,2}/20\\d\\d\\b|\\b\\d{1,3}/20\\d\\d\\b|\\bper the\\b') THEN 1 ELSE 0 END) AS BIGINT) AS named FROM (SELECT CASE item_id % 3 WHEN 0 THEN 'single' ELSE 'multi' END AS type, concat(text, CASE WHEN item_id % 4 = 0 THEN ' in Circular 7' WHEN item_id % 4 = 1 THEN ' of 12/2021' ELSE '' END) AS question FROM benchmark) GROUP BY type")
def question_counts(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").selectExpr("CASE item_id % 3 WHEN 0 THEN 'single' ELSE 'multi' END AS type", "concat(text, CASE WHEN item_id % 4 = 0 THEN ' in Circular 7' WHEN item_id % 4 = 1 THEN ' of 12/2021' ELSE '' END) AS question")
    return usage.question_counts(questions, NAMED_INSTRUMENT)
