"""What the third round's findings asked for."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.operators import answering, chunking, ingest
from lodestone.operators import retrieval as R
from lodestone.plans import registry
from lodestone.sources import index


@pytest.fixture(scope="module")
def one_question(tmp_path_factory):
    """Question 0 names documents 0 and 1; ten chunks of document 0 are nearer than the one of document 1."""
    folder = tmp_path_factory.mktemp("vectors")
    angles = [0.0, *(0.01 * i for i in range(1, 11)), 0.5]
    rows = [{"vec_id": i, "embedding": np.array([np.cos(a), np.sin(a)], np.float32), "label": np.int32(i == 11)} for i, a in enumerate(angles)]
    pd.DataFrame(rows).to_parquet(folder / "embeddings.parquet")
    return str(folder)


def test_named_balanced_takes_pools_of_twenty(spark, one_question):
    got = registry.queries()["named_balanced"](spark, one_question).orderBy("rank").collect()
    assert [(r.chunk_id, r.doc_id, r.reserved) for r in got] == [(0, 0, True), (11, 1, True), (1, 0, False), (2, 0, False), (3, 0, False)]


def test_named_coverage_takes_pools_of_twenty(spark, one_question):
    got = registry.queries()["named_coverage"](spark, one_question).first()
    assert (got.requested, got.resolved, got.represented, got.incomplete) == ("0,1", "0,1", "0,1", False)


def test_named_scores_meet_documents_in_the_task(spark, monkeypatch):
    rng = np.random.default_rng(3)
    asked = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "question_id int, vector array<double>")
    chunks = spark.createDataFrame([(i, f"d{i % 7}", [0.0] * 4 if i % 11 == 0 else rng.normal(size=4).tolist()) for i in range(300)], "chunk_id int, doc_id string, vector array<double>").coalesce(2)
    named = spark.createDataFrame([(i, f"d{(i * j) % 8}") for i in range(8) for j in (1, 2, 2)], "question_id int, doc_id string")
    pairs = {(r.question_id, r.doc_id) for r in named.collect()}
    every = [r for r in R.cosine_scores(asked, chunks).collect() if (r.question_id, r.doc_id) in pairs]
    assert sorted((r.question_id, r.chunk_id) for r in R.cosine_scores(asked, chunks, named=named).collect()) == sorted((r.question_id, r.chunk_id) for r in every)
    monkeypatch.setattr(R, "SCORES_AT_ONCE", 16)
    want = {}
    for r in sorted(every, key=lambda r: (r.question_id, r.score is None, -round(r.score or 0, 9), r.chunk_id)):
        want.setdefault(r.question_id, []).append(r.chunk_id)
    want = {question: chunk_ids[:60] for question, chunk_ids in want.items()}
    got = {}
    for r in R.named_top(asked, chunks, named, 60).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.chunk_id)
    assert got == want
    assert "Join" not in R.named_top(asked, chunks, named, 5)._jdf.queryExecution().optimizedPlan().toString()


def test_scores_leave_a_task_only_above_its_best(spark):
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "question_id int, vector array<double>")
    chunks = spark.range(0, 20_000, 1, 1).selectExpr("id AS chunk_id", "array(1.0D, id / 1000.0D) AS vector")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        found = R.cosine_scores(asked, chunks, 5)
        assert found.count() == 5 and sorted(r.chunk_id for r in found.collect()) == [0, 1, 2, 3, 4]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scores_held_at_once_are_few():
    assert R.SCORES_AT_ONCE * 8 <= 8 << 20


def test_rrf_fusion_scores_the_last_twenty_of_a_label(spark, one_question):
    plan = registry.queries()["rrf_fusion"](spark, one_question)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 20" in plan


def test_bm25_keeps_a_tasks_best(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "rare", "the"]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, size=int(n), p=[0.2, 0.15, 0.1, 0.04, 0.01, 0.5])) for n in rng.integers(0, 30, 400)]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string").coalesce(2)
    asked = spark.createDataFrame([(i, " ".join(rng.choice([*words, "nowhere"], size=4))) for i in range(30)], "question_id int, question string")
    every = {(r.question_id, r.chunk_id): round(r.score, 9) for r in R.top(R.bm25_scores(asked, chunks), 7).collect()}
    monkeypatch.setattr(R, "CHUNKS_AT_ONCE", 16)
    monkeypatch.setattr(R, "QUESTIONS_AT_ONCE", 7)
    monkeypatch.setattr(R, "SCORES_AT_ONCE", 50)
    best = R.bm25_scores(asked, chunks, k=7)
    assert {(r.question_id, r.chunk_id): round(r.score, 9) for r in R.top(best, 7).collect()} == every
    assert best.count() < R.bm25_scores(asked, chunks).count() / 2
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()


def test_index_is_built_without_a_batchs_words(spark):
    """A batch of 4,000 chunks takes a worker less than its words as strings would."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import functions as F

    from lodestone.operators import postings

    works = []

    class Chunks:
        schema = spark.range(1).select(F.col("id").alias("chunk_id")).schema

        def select(self, *_):
            return self

        def mapInArrow(self, work, _):
            works.append(work)

    postings._blocks(Chunks())
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 400)) for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(4000)), "text": texts})
    postings.TaskContext, kept = type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}), postings.TaskContext
    try:
        tracemalloc.start()
        entries = sum(len(x) for own in (b.column("ids").to_pylist() for b in works[0](iter([batch]))) for x in own)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        postings.TaskContext = kept
    assert entries == sum(len(set(t.split())) for t in texts)
    assert most < 40e6


@pytest.fixture(scope="module")
def byte_model():
    import public_tokenizers

    from lodestone.operators import chunking

    return chunking.FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"), special=1)


def test_counts_of_a_join_add_up_where_they_are_said_to(byte_model):
    rng = np.random.default_rng(2)
    letters = list("ab Z9.,'’\"-_\n\t  é世界🙂  \x1c\x85s") + ["'s", "'ll", "<|endoftext|>", " the", "  "]
    said = 0
    for _ in range(20_000):
        a, b = ("".join(rng.choice(letters, size=rng.integers(0, 7))) for _ in range(2))
        if byte_model.extends(a, b):
            said += 1
            assert byte_model.encode(f"{a} {b}") == byte_model.encode(a) + byte_model.encode(f" {b}")
    assert said > 5000


def test_a_packer_encodes_a_text_few_times(byte_model, monkeypatch):
    from lodestone.operators import chunking

    read = []
    monkeypatch.setattr(byte_model, "lately", chunking.lru_cache(maxsize=chunking.LATELY)(lambda text: read.append(len(text)) or byte_model.fresh(text)))
    text = " ".join(f"Sentence {i} of a longer paragraph has ten words." for i in range(500))
    elements = [("paragraph", text, 1)] + [("paragraph", f"Short line number {i} here.", 2) for i in range(500)]
    packer = chunking.Packer(byte_model, target=240, overlap=32, exact=True, sizes=chunking.WordCounter())
    chunks = packer.pack(elements)
    assert all(len(byte_model.fresh(c["text"])) + 1 == c["embedding_token_count"] <= 240 for c in chunks)
    assert sum(read) < 8 * sum(len(e[1]) for e in elements)


def test_pages_of_quotes_are_normalised_once(spark):
    from lodestone.operators import checks

    pages = spark.createDataFrame([("a", 1, "one two"), ("a", 2, "three"), ("a", 4, "five"), ("a", None, "six"), (None, 1, "seven")], "doc_id string, page int, text string")
    quotes = spark.createDataFrame([(1, "a", 1, "Two three"), (2, "a", 2, "three five"), (3, "a", 4, "five"), (4, "a", 3, "five"), (5, None, 1, "seven"), (6, "a", None, "six")], "quote_id int, doc_id string, page int, quote string")
    got = checks.quote_hits(quotes, pages)
    assert sorted((r.quote_id, r.found) for r in got.collect()) == [(1, True), (2, False), (3, True), (4, False), (5, False), (6, False)]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ArrowEvalPython") == 2


def test_bm25_meets_terms_that_weigh_nothing(spark):
    chunks = spark.createDataFrame([(1, "one both"), (2, "two both"), (3, "three"), (4, "four")], "chunk_id int, text string")
    asked = spark.createDataFrame([(0, "both")], "question_id int, question string")
    assert sorted((r.chunk_id, r.score) for r in R.bm25_scores(asked, chunks, k=5).collect()) == [(1, 0.0), (2, 0.0)]


def test_prompts_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def prompt(ids: pd.Series) -> pd.Series:
        made.add(len(ids))
        return ids.map("say {}".format)

    contexts = spark.range(40).select(F.col("id").alias("answer_id"), F.lit("c").alias("chunk_id"), F.lit("d1").alias("doc_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit(None).cast("string").alias("section"))
    prompts = spark.range(40).select(F.col("id").alias("answer_id"), prompt("id").alias("prompt"))
    out = answering.complete(prompts, contexts, answering.Replies(spark, str(tmp_path / "store"), lambda text: answering.Reply("no citation", 1, 1, 0.5)))
    assert {(r.refusal_reason, r.repaired, r.calls) for r in out.collect()} == {("missing_citation", True, 2)}
    assert made.value == 40


def test_runs_of_white_space_within_a_text_are_read_once(spark):
    text = "a" + " " * 200_000 + "b"
    begun = time.time()
    got = spark.createDataFrame([(0, f" \t{text}\r\n\x0b\x0c "), (1, " \n "), (2, None)], "i int, t string").select(strip(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [text, "", None]
    assert time.time() - begun < 10  # a pattern took the square of the run


def test_elements_and_chunks_are_dealt_once_in_parts_of_a_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ingest, "CHARS_A_TASK", 50_000)
    found = registry.queries()["elements"](spark, sf_dir)
    assert found.rdd.getNumPartitions() > 4  # as many as the setting has at most, before
    packed = chunking.pack_chunks(found)
    assert "REPARTITION" not in packed._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "")
    want = {r.chunk_hash for r in chunking.pack_chunks(found.repartition(3)).collect()}
    assert {r.chunk_hash for r in packed.collect()} == want


def _states(spark, n):
    """Two states of ``n`` rows, one in nine a copy of another, a tenth new in the second; whole rows are large and don't compress."""
    key = "CASE WHEN id % 9 = 4 THEN id - 1 ELSE id END"
    make = lambda changed: spark.range(0, n, 1, 4).selectExpr("id AS position", f"sha2(concat({key}, IF(id % 10 < {changed}, ' new', '')), 256) AS chunk_hash", "id AS doc_id", f"array_join(transform(sequence(1, 60), i -> sha2(concat({key}, i), 256)), '') AS text")
    return make(0), make(1)


def test_an_index_settles_rows_where_they_lie(spark, tmp_path):
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    rows = 4000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for ids of a large table
    try:
        for state in _states(spark, rows):
            before = moved()
            index.rebuild(state, str(tmp_path / "i"), lambda rows: rows.select("chunk_hash", F.length("text").alias("n_chars")), "f")
            # Ids are shuffled several times over; texts, of 3,840 bytes each, are not.
            assert moved() - before < 900 * rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("words", [1, 1 << 19])
def test_an_index_takes_the_same_rows_at_any_number_of_cells(spark, tmp_path, monkeypatch, words):
    monkeypatch.setattr(index, "MOST_WORDS", words)
    embedded = []

    def embed(rows):
        embedded.append(sorted((r.chunk_hash, r.position) for r in rows.select("chunk_hash", "position").collect()))
        return rows

    held = set()
    for state in _states(spark, 700):
        last = {}
        for r in state.select("chunk_hash", "position").collect():
            last[r.chunk_hash] = max(r.position, last.get(r.chunk_hash, -1))
        index.rebuild(state, str(tmp_path / "i"), embed, "f")
        assert embedded[-1] == sorted((h, p) for h, p in last.items() if h not in held)
        held = set(last)
