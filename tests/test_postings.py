"""The stored inverted index against scores of every chunk."""

import random
import re

import pytest

from lodestone.operators import postings, retrieval
from lodestone.session import run_folder


@pytest.fixture
def corpus(spark, monkeypatch):
    """Skewed words, copies, empty and null texts, in ranges of 16 chunks and several folders."""
    monkeypatch.setattr(postings, "RANGE", 16)
    monkeypatch.setattr(postings, "CHUNKS_A_BUCKET", 60)
    dice = random.Random(11)
    word = lambda: f"w{int(dice.paretovariate(0.6)) % 400}"
    texts = [" ".join(word() for _ in range(dice.randrange(1, 60))) for _ in range(300)]
    rows = [(f"c{i:03}", t) for i, t in enumerate(texts + texts[:20] + ["", None, "Straße 8/2025 İ K2"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(4, "chunk_id")
    asked = [(q, " ".join(dice.choice(texts).split()[: dice.randrange(1, 30)])) for q in range(25)] + [(90, "w1 w1 w1 nowhere"), (91, ""), (92, None), (93, "nowhere"), (94, "8/2025 w399")]
    return chunks, spark.createDataFrame(asked, "question_id long, question string")


def test_stored_index_equals_scores_of_all_chunks(spark, corpus):
    chunks, questions = corpus
    folder = run_folder(spark, "p")
    record = postings.build(chunks, folder)
    assert record["chunks"] == 323 and record["buckets"] > 3
    scores = retrieval.bm25_scores(questions, chunks.fillna("", ["text"])).cache()
    for k in (1, 4, 50):
        want = {(r.question_id, r.rank, r.chunk_id, round(r.score, 8)) for r in retrieval.top(scores, k).collect()}
        got = {(r.question_id, r.rank, r.chunk_id, round(r.score, 8)) for r in postings.search(questions, folder, k).collect()}
        assert got == want, k


def test_few_postings_are_added_up_and_few_folders_read(spark, corpus):
    chunks, questions = corpus
    folder = run_folder(spark, "p")
    buckets = postings.build(chunks, folder)["buckets"]
    n = postings.Search(questions, folder, 1).counts()
    assert 0 < n["added"] < n["postings"] / 2
    one = postings.Search(questions.where("question_id = 94"), folder, 1)
    plan = one._read("blocks")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(\d,\d\)\]", plan) and len(one.buckets) <= 2 < buckets


def test_empty_tables(spark, corpus):
    chunks, questions = corpus
    folder = run_folder(spark, "p")
    postings.build(chunks, folder)
    assert postings.search(questions.limit(0), folder, 3).count() == 0
    none = run_folder(spark, "p")
    assert postings.build(chunks.limit(0), none)["chunks"] == 0
