import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import REFUSAL, question_key
from lodestone.operators import ingest, usage
from lodestone.service import Service
from lodestone.sources import index


def test_service(spark, tmp_path):
    folder = str(tmp_path / "i")
    chunks = spark.createDataFrame([("c1", 0, "d1", 1, 2, "4. Capital", "capital rules of 8/2025"), ("c2", 1, "d2", 3, 3, None, "liquidity rules"), ("c3", 2, "d3", 1, 1, None, "other text"), ("c4", 3, "d3", 2, 2, None, "more of it")], "chunk_hash string, position int, doc_id string, page_start int, page_end int, section string, text string")
    index.rebuild(chunks, folder, lambda rows: rows, "f")
    manifest = spark.createDataFrame([("d1", "Act", "2020-01-01", "A", "T")], "id string, document_type string, published_date string, issuing_authority string, title string")
    seen = []

    def model(rows):
        seen.extend(r.context for r in rows.collect())
        return rows.withColumn("answer", F.when(F.col("question").contains("8/2025"), "Ten. [d1, p.2]").otherwise("Ten, I think."))

    service = Service(spark, folder, manifest, model, "f", clock=lambda: 100.0)
    questions = spark.createDataFrame([(1, "What says 8/2025?"), (2, "liquidity?"), (3, "held"), (4, "zzz")], "question_id int, question string")
    cache = spark.createDataFrame([("held", "kept", 1.0, 200.0), ("zzz", "old", 1.0, 100.0)], "q string, answer string, created_at double, expires_at double")
    cache = cache.select(question_key(F.lit("f"), F.col("q")).alias("question_hash"), "answer", "created_at", "expires_at")
    got = service.ask(questions, cache)
    rows = {r.question_id: (r.answer, r.refusal_reason, r.cache_hit) for r in got.collect()}
    assert rows == {1: ("Ten. [d1, p.2]", None, False), 2: (REFUSAL, "missing_citation", False), 3: ("kept", None, True), 4: (REFUSAL, "no_context", False)}
    assert any('Source type: Act (2020), issued by A. Title: "T".\n(d1, p.1-2, 4. Capital)\ncapital' in c for c in seen)
    after = service.remember(got, cache, 50.0)
    assert after.count() == 3 and after.where("expires_at = 150").count() == 1
    assert service.ready() and not Service(spark, folder, manifest, model, "other").ready()
    log = spark.createDataFrame([(1, "secret")], "id long, question string")
    log = usage.migrate(log)
    assert "question" not in service.recent(log)[0] and service.stats(log)["queries"] == 1


def test_corpus_elements(spark):
    manifest = spark.createDataFrame([("a", None), ("b", "ocr")], "id string, text_layer string")
    lines = spark.createDataFrame([(d, 1, 0, f"text of {d}", 10.0) for d in "abx"], "doc_id string, page int, line_no int, text string, size double")
    pages = spark.createDataFrame([(d, 1, f"scan of {d}") for d in "abx"], "doc_id string, page int, text string")
    counts = spark.createDataFrame([(d, 1) for d in "abx"], "doc_id string, n long")
    got = ingest.corpus_elements(manifest, lines, counts, pages)
    assert {r.text for r in got.collect()} == {"text of a", "scan of b"}


def test_one_reply_a_question(spark, tmp_path):
    """A model that never answers alike: every verdict is on the reply that is served, asked for once."""
    import random

    folder = str(tmp_path / "i")
    chunks = spark.createDataFrame([(f"c{i}", i, f"d{i}", 1, 2, None, f"word{i} rules") for i in range(20)], "chunk_hash string, position int, doc_id string, page_start int, page_end int, section string, text string")
    index.rebuild(chunks, folder, lambda rows: rows, "f")
    calls = tmp_path / "calls"
    calls.mkdir()

    @F.udf("string")
    def reply(question):
        with open(calls / "log", "a") as out:
            out.write(f"{question}\n")
        number = question.split()[0][4:]
        return random.choice([f"Ten. [d{number}, p.{random.randint(1, 9)}]", "Ten, I think.", "Ten (p. 4)"])

    manifest = spark.createDataFrame([("d1", "Act", "2020-01-01", "A", "T")], "id string, document_type string, published_date string, issuing_authority string, title string")
    service = Service(spark, folder, manifest, lambda rows: rows.withColumn("answer", reply.asNondeterministic()("question")), "f", clock=lambda: 100.0)
    questions = spark.createDataFrame([(i, f"word{i} what?") for i in range(20)], "question_id int, question string")
    cache = spark.createDataFrame([], "question_hash string, answer string, created_at double, expires_at double")
    answered, log = service.timed(questions, cache)
    for r in answered.collect():
        page = int(r.answer.split("p.")[1][:-1]) if "p." in r.answer else 0
        assert (r.refusal_reason is None) == (0 < page <= 2) and r.refused == (r.answer == REFUSAL)
        assert r.refusal_reason in (None, "unverified_citation", "missing_citation", "malformed_citation")
    assert log.count() == 20 and "question" not in log.columns and log.where("latency_ms > 0").count() == 20
    after = service.remember(answered, cache, 50.0)
    assert after.count() == answered.where("not refused").count()
    assert len((calls / "log").read_text().splitlines()) == 20


def test_dispatcher(spark):
    from lodestone.operators import retrieval as R

    chunks = spark.createDataFrame([("a1", "a", "capital of banks", [1.0, 0.0]), ("a2", "a", "capital rules", [0.9, 0.1]), ("b1", "b", "liquidity of banks", [0.0, 1.0]), ("b2", "b", "other", [0.1, 0.9])], "chunk_id string, doc_id string, text string, vector array<double>")
    asked = spark.createDataFrame([(1, "capital of banks", [1.0, 0.05])], "question_id int, question string, vector array<double>")
    ids = lambda frame: [r.chunk_id for r in frame.orderBy("rank").collect()]
    assert ids(R.retrieve(asked, chunks, 2)) == ["a1", "a2"]
    assert ids(R.retrieve(asked, chunks, 2, doc_ids=["b"])) == ["b2", "b1"]
    assert ids(R.retrieve(asked, chunks, 2, "bm25", doc_ids=["b"])) == ["b1"]
    whole = {r.chunk_id: r.score for r in R.bm25_scores(asked, chunks).collect()}
    assert R.bm25_scores(asked, chunks, ["b"]).first().score == whole["b1"]
    assert ids(R.retrieve(asked, chunks, 1, "hybrid", scorer=lambda c: F.when(F.col("chunk_id") == "b2", 1.0).otherwise(0.0))) == ["b2"]
    resolved = spark.createDataFrame([(1, "b", 0)], "question_id int, doc_id string, manifest_ord int")
    assert ids(R.retrieve(asked, chunks, 2, "named_balanced", resolved=resolved)) == ["b2", "a1"]
    many = spark.createDataFrame([(f"c{i:03}", [1.0, i % 7 / 10]) for i in range(500)], "chunk_id string, vector array<double>")
    some = spark.createDataFrame([(i, [1.0, i / 5]) for i in range(9)] + [(9, [0.0, 0.0])], "question_id int, vector array<double>")
    want = sorted((r.question_id, r["rank"], r.chunk_id) for r in R.top(R.cosine_scores(some, many), 12).collect())
    assert sorted((r.question_id, r["rank"], r.chunk_id) for r in R.cosine_top(some, many, 12).collect()) == want
    for bad in (lambda: R.retrieve(asked, chunks, 2, "x"), lambda: R.retrieve(asked, chunks, 2, "named_balanced")):
        with pytest.raises(ValueError):
            bad()


def test_holding(spark, monkeypatch):
    from lodestone.operators import retrieval as R

    texts = ["x the cat sat y", "the cat", "", None, "cat\nsat on", "aaa"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    questions = spark.createDataFrame(list(enumerate(["the cat", "cat\nsat", "aa", "", None, "the cat", "zzz"])), "question_id int, question string")
    want = sorted((q.question_id, c.chunk_id) for q in questions.collect() for c in chunks.collect() if q.question and c.text and q.question in c.text)
    assert sorted(map(tuple, R.holding(questions, chunks).collect())) == want
    monkeypatch.setattr(R, "MOST_QUESTIONS", 2)
    assert sorted(map(tuple, R.holding(questions, chunks).collect())) == want and R.holding(questions.limit(0), chunks).count() == 0
