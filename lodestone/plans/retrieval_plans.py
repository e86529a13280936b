"""Queries that rank: cosine, BM25, fusion, balanced selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import postings
from ..operators import retrieval as R
from ..session import run_folder, table, written
from . import inputs
from .registry import query

SHOWN = "question_id, chunk_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score"


def shown(ranked, *more):
    return ranked.select("question_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), *more)


def _cosine(spark, sf_dir, k=None):
    return R.cosine_scores(inputs.vector_questions(spark, sf_dir), inputs.vectors(spark, sf_dir), k)


def _bm25(spark, sf_dir, k=None):
    return R.bm25_scores(inputs.questions(spark, sf_dir), inputs.chunks(spark, sf_dir), k=k)


@query(f"SELECT {SHOWN} FROM cosine_ranked WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    return shown(R.top(_cosine(spark, sf_dir, 10), 10))


@query(f"SELECT {SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM cosine WHERE doc_id IN (1, 3, 5)) WHERE rank <= 10")
def cosine_filtered(spark, sf_dir):
    chosen = inputs.vectors(spark, sf_dir).where(F.col("doc_id").isin(1, 3, 5))
    return shown(R.cosine_top(inputs.vector_questions(spark, sf_dir), chosen, 10))


@query(f"SELECT {SHOWN} FROM bm25_ranked WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return shown(R.top(_bm25(spark, sf_dir, 5), 5))


@query(f"SELECT {SHOWN} FROM bm25_ranked WHERE rank <= 5")
def bm25_stored(spark, sf_dir):
    """The same from an inverted index, written and then read by block bounds."""
    folder = run_folder(spark, "postings")
    postings.build(inputs.chunks(spark, sf_dir), folder)
    return shown(postings.search(inputs.questions(spark, sf_dir), folder, 5))


FUSED = """SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM
    (SELECT question_id, chunk_id, sum(1.0 / (60 + rank)) AS score FROM ({lists}) GROUP BY ALL)"""
BOTH = "SELECT question_id, chunk_id, rank FROM cosine_ranked WHERE rank <= 50 UNION ALL SELECT question_id, chunk_id, rank FROM bm25_ranked WHERE rank <= 50"


@query(f"SELECT {SHOWN} FROM ({FUSED.format(lists=BOTH)}) WHERE rank <= 10")
def hybrid(spark, sf_dir):
    """Vectors and texts share their ids, as chunks of one index would."""
    return shown(R.fuse([R.top(_cosine(spark, sf_dir, 50), 50), R.top(_bm25(spark, sf_dir, 50), 50)], 10))


BY_LABEL = "SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY chunk_id DESC) AS rank FROM cosine WHERE doc_id = 2"


@query(f"SELECT {SHOWN} FROM ({FUSED.format(lists=f'SELECT question_id, chunk_id, rank FROM cosine_ranked WHERE rank <= 20 UNION ALL SELECT * FROM ({BY_LABEL}) WHERE rank <= 20')}) WHERE rank <= 10")
def rrf_fusion(spark, sf_dir):
    asked, vectors = inputs.vector_questions(spark, sf_dir), inputs.vectors(spark, sf_dir)
    order = Window.partitionBy("question_id").orderBy(F.col("chunk_id").desc())
    # This order is the same for every question, so its first twenty are found once.
    last = vectors.where("doc_id = 2").orderBy(F.col("chunk_id").desc()).limit(20)
    other = R.cosine_scores(asked, last).withColumn("rank", F.row_number().over(order)).where("rank <= 20")
    return shown(R.fuse([R.cosine_top(asked, vectors, 20), other], 10))


@query(f"""SELECT {SHOWN} FROM (SELECT question_id, chunk_id, second AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(second, 9) DESC, chunk_id) AS rank FROM
    (SELECT *, score * 0.5e0 + CAST(chunk_id % 7 AS DOUBLE) / 10e0 AS second FROM cosine_ranked WHERE rank <= 20)) WHERE rank <= 5""")
def rerank_topk(spark, sf_dir):
    """A pool of twenty under a made-up scorer, cut to five."""
    pool = R.top(_cosine(spark, sf_dir, R.POOL), R.POOL)
    return shown(R.rerank(pool, lambda c: c["score"] * 0.5 + (c["chunk_id"] % 7).cast("double") / 10, 5))


def _resolved(spark, sf_dir):
    """Each question names two documents, in manifest order."""
    named = inputs.vector_questions(spark, sf_dir).select("question_id", F.explode(F.array(F.col("question_id") % 10, (F.col("question_id") * 3 + 1) % 10).cast("array<int>")).alias("doc_id")).distinct()
    return named.withColumn("manifest_ord", F.col("doc_id"))


RESOLVED = "SELECT DISTINCT question_id, unnest([question_id % 10, (question_id * 3 + 1) % 10]) AS doc_id FROM (SELECT vec_id AS question_id FROM embeddings WHERE vec_id % 50 = 0)"
CANDIDATES = f"""SELECT question_id, chunk_id, doc_id, score, named, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY round(score, 9) DESC, chunk_id) AS nth FROM
    (SELECT c.*, n.doc_id IS NOT NULL AS named, row_number() OVER (PARTITION BY c.question_id, n.doc_id IS NOT NULL ORDER BY round(score, 9) DESC, chunk_id) AS among
     FROM cosine_ranked c LEFT JOIN ({RESOLVED}) n USING (question_id, doc_id)) WHERE rank <= 20 OR (named AND among <= 20)"""
BALANCED = f"""SELECT *, named AND nth = 1 AS reserved, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN named AND nth = 1 THEN 0 ELSE 1 END, CASE WHEN named AND nth = 1 THEN doc_id END NULLS LAST, round(score, 9) DESC, chunk_id) AS rank
    FROM ({CANDIDATES})"""


def _balanced(spark, sf_dir):
    asked, vectors, resolved = inputs.vector_questions(spark, sf_dir), inputs.vectors(spark, sf_dir), _resolved(spark, sf_dir)
    # Written, as coverage reads them twice.
    pool = written(R.cosine_top(asked, vectors, R.POOL).drop("rank"), "pool")
    named = written(R.named_top(asked, vectors, resolved, R.POOL).drop("rank").select(pool.columns), "named")
    return R.named_balanced(pool, named, resolved, 5), pool.unionByName(named), resolved


@query(f"SELECT {SHOWN}, doc_id, reserved FROM ({BALANCED}) WHERE rank <= 5")
def named_balanced(spark, sf_dir):
    return shown(_balanced(spark, sf_dir)[0], "doc_id", "reserved")


@query(f"""WITH chosen AS (SELECT question_id, doc_id, min(rank) AS shown_at FROM ({BALANCED}) WHERE rank <= 5 GROUP BY ALL), named AS ({RESOLVED}),
    found AS (SELECT DISTINCT question_id, doc_id FROM ({CANDIDATES}) WHERE named)
    SELECT question_id, array_to_string(requested, ',') AS requested, array_to_string(coalesce(resolved, []), ',') AS resolved, array_to_string(represented, ',') AS represented, NOT list_has_all(represented, requested) AS incomplete FROM
    (SELECT question_id, list(doc_id ORDER BY doc_id) AS requested FROM named GROUP BY question_id) LEFT JOIN (SELECT question_id, list(doc_id ORDER BY doc_id) AS resolved FROM found GROUP BY question_id) USING (question_id)
    JOIN (SELECT question_id, list(doc_id ORDER BY shown_at) AS represented FROM chosen GROUP BY question_id) USING (question_id)""")
def named_coverage(spark, sf_dir):
    chosen, candidates, resolved = _balanced(spark, sf_dir)
    found = R.coverage(chosen, resolved, candidates)
    return found.select("question_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("requested", "resolved", "represented")), "incomplete")


@query("""SELECT w.doc_id, w.page, c.chunk_id, c.page_start, c.page_end, 1e0 AS score FROM (SELECT concat('d', doc_id) AS doc_id, CAST(doc_id % 5 AS INT) AS page FROM documents) w
    JOIN contexts c ON c.doc_id = w.doc_id AND w.page BETWEEN c.page_start AND c.page_end""")
def page_stab(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) AS doc_id", "CAST(doc_id % 5 AS INT) AS page")
    found = R.page_stab(wanted, inputs.contexts(spark, sf_dir).select("doc_id", "chunk_id", "page_start", "page_end"))
    return found.select("doc_id", "page", "chunk_id", "page_start", "page_end", "score")


@query("""WITH held AS (SELECT question_id, chunk_id, rank FROM cosine_ranked WHERE rank <= 5), more AS (SELECT question_id, chunk_id, rank FROM
    (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM cosine WHERE chunk_id % 2 = 0) WHERE rank <= 5)
    SELECT * FROM held UNION ALL SELECT question_id, chunk_id, 5 + row_number() OVER (PARTITION BY question_id ORDER BY rank) FROM more m
    WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.question_id = m.question_id AND h.chunk_id = m.chunk_id)""")
def merge_new(spark, sf_dir):
    asked, vectors = inputs.vector_questions(spark, sf_dir), inputs.vectors(spark, sf_dir)
    out = R.merge_new(R.cosine_top(asked, vectors, 5), R.cosine_top(asked, vectors.where("chunk_id % 2 = 0"), 5))
    return out.select("question_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


NAME = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' '{g}))"
#: Aliases: the first three words of every benchmark text, one owner each or not.
ALIASES = f"SELECT item_id AS doc_id, array_to_string(string_split({NAME.format(x='text', g=chr(44) + chr(32) + chr(39) + 'g' + chr(39))}, ' ')[1:3], ' ') AS alias FROM benchmark"


@query(f"""SELECT q.doc_id AS question_id, a.doc_id, CAST(a.doc_id AS INT) AS manifest_ord FROM documents q JOIN
    (SELECT alias, min(doc_id) AS doc_id FROM ({ALIASES}) GROUP BY alias HAVING count(DISTINCT doc_id) = 1) a
    ON contains(' ' || {NAME.format(x='q.text', g=", 'g'")} || ' ', ' ' || a.alias || ' ')""")
def named_resolve(spark, sf_dir):
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    names = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(words, 1, 3), " ").alias("alias"), F.col("item_id").alias("doc_id"), F.col("item_id").cast("int").alias("manifest_ord"))
    return R.resolve_names(table(spark, sf_dir, "documents").selectExpr("doc_id AS question_id", "text AS question"), names)
