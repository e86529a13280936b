"""Chunks under two counters against a second implementation, quality, and the run behind the bench."""

import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, evaluation
from lodestone.plans import ingest_plans
from lodestone.plans.registry import queries


class Halves:
    """A made-up model: every word is a token for each two letters begun, and texts get two marks."""

    special, name = 2, "halves"

    def encode(self, text):
        return [w[i : i + 2] + ("" if i + 2 < len(w) else " ") for w in text.split() for i in range(0, len(w), 2)]

    def decode(self, tokens):
        return "".join(tokens).strip()


def second(elements, model, size, target, overlap):
    """Text runs first, then chunks: each step is a list of candidates that a fold merges."""
    room, kept = target - model.special, max(overlap - model.special, 0)
    n = lambda *parts: len(model.encode(" ".join(parts)))

    def end_of(text):
        ids = model.encode(text)
        return text if len(ids) <= kept else model.decode(ids[-kept:]) if kept else ""

    def cut(paragraph):
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            ids = model.encode(sentence)
            if len(ids) <= room:
                yield False, sentence
                continue
            low = 0
            while True:
                yield True, model.decode(ids[low : low + room])
                if low + room >= len(ids):
                    break
                low += max(room - kept, 1)

    def pieces(paragraph):
        held = []
        for whole, text in cut(paragraph):
            if whole or (held and n(*held, text) > room):
                if held:
                    yield " ".join(held)
                seed = "" if whole or not held else end_of(" ".join(held))
                held = [seed] if seed and n(seed, text) <= room else []
            if whole:
                yield text
            else:
                held.append(text)
        if held:
            yield " ".join(held)

    chunks, held, span, section = [], [], None, None

    def shut():
        nonlocal held, span
        if not held:
            return
        text = " ".join(held)
        if chunks and chunks[-1][0] == text:
            held = []
            return
        joined = f"{chunks[-1][0]} {text}" if chunks else ""
        if chunks and size(text) < 40 and n(joined) + model.special <= target:
            chunks[-1] = (joined, chunks[-1][1], span[1], chunks[-1][3], len(chunks))
        else:
            chunks.append((text, *span, section, len(chunks)))
        seed = end_of(text)
        held, span = [seed] if seed else [], (span[1], span[1])

    for kind, text, page in elements:
        if kind == "heading":
            if held and n(*held) >= target * 0.6:
                shut()
            section = text
        elif n(text) > room:
            shut()
            chunks += [(p, page, page, section, len(chunks) + i) for i, p in enumerate(pieces(text))]
            seed = end_of(chunks[-1][0])
            held, span = [seed] if seed else [], (page, page)
        else:
            if held and n(*held, text) > room:
                shut()
                if held and n(*held, text) > room:
                    held, span = [], None
            span = (span[0] if span else page, page)
            held.append(text)
    shut()
    return [(i, t, a, b, s, size(t), n(t) + model.special, model.name) for t, a, b, s, i in chunks if t.strip()]


words = lambda text: len(text.split())


@pytest.mark.parametrize("target, overlap", [(60, 10), (240, 32), (20, 2), (130, 129)])
def test_two_counts(target, overlap):
    pick = random.Random(target)
    packer = chunking.Packer(Halves(), target=target, overlap=overlap, exact=True, sizes=chunking.WordCounter())
    for _ in range(150):
        word = lambda: "".join(pick.choices("abc", k=pick.choice([1, 2, 3, 9]))) + pick.choice(["", "", "", ".", "?"])
        rows = [(pick.choice(["heading", "paragraph", "paragraph", "paragraph"]), " ".join(word() for _ in range(pick.choice([1, 5, 30, 50, 200]))), i // 3 + 1) for i in range(pick.randrange(12))]
        assert [tuple(c.values()) for c in packer.pack(rows)] == second(rows, Halves(), words, target, overlap)


def test_small_chunks_by_the_plain_count():
    """Near the least size: 39 words join the chunk before while the model's 78 tokens alone would not."""
    pack = lambda k: chunking.Packer(Halves(), target=400, overlap=2, exact=True, sizes=chunking.WordCounter()).pack([("paragraph", " ".join(["abcd"] * 130), 1), ("heading", "2. B", 2), ("paragraph", " ".join(["wxyz"] * k), 2)])
    assert [c["token_count"] for c in pack(39)] == [169] and [c["embedding_token_count"] for c in pack(39)] == [340]
    assert [(c["token_count"], c["embedding_token_count"], c["section"], c["embedding_tokenizer"]) for c in pack(40)] == [(130, 262, None, "halves"), (40, 82, "2. B", "halves")]
    plain = chunking.Packer(target=400).pack([("paragraph", "a b", 1)])[0]
    assert (plain["token_count"], plain["embedding_token_count"], plain["embedding_tokenizer"]) == (2, None, None)
    with pytest.raises(ValueError):
        chunking.Packer(Halves(), target=2, overlap=1, exact=True)


def test_whole_tables(spark, sf_dir):
    """A real vocabulary over every document."""
    model = ingest_plans._two_counts().counter
    elements = queries()["elements"](spark, sf_dir).orderBy("doc_id", "elem_no").collect()
    want = {(d, *c) for d, own in groupby(elements, key=lambda r: r.doc_id) for c in second([(r.kind, r.text, r.page) for r in own], model, words, 240, 32)}
    got = queries()["chunks_by_model"](spark, sf_dir)
    assert {tuple(r)[:-1] for r in got.collect()} == want and len(want) == got.count() > 100
    assert got.agg(F.max("embedding_token_count")).first()[0] <= 240 and model.special == 1
    import public_tokenizers

    with pytest.raises(ValueError):  # windows of it would hold symbols in place of text
        chunking.FileTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_corpus_chunks(spark):
    manifest = spark.createDataFrame([("a", "a.pdf"), ("b", "b.pdf"), ("c", "c.pdf")], "id string, filename string")
    elements = spark.createDataFrame([(d, 0, "paragraph", f"text of {d}", 1) for d in "abz"], "doc_id string, elem_no int, kind string, text string, page int")
    chunks, missing = chunking.corpus_chunks(manifest, elements, spark.createDataFrame([("a.pdf",), ("c.pdf",), ("c.pdf",)], "filename string"))
    assert [r.text for r in chunks.collect()] == ["text of a"] and [tuple(r) for r in missing.collect()] == [("b", "b.pdf")]


def test_quality(spark):
    kind = "doc_id string, text string, token_count int"
    rows = [("a", "x " * 50, 50), ("a", "y " * 60, 60), ("a", "", 0), ("b", ". " * 50, 50), (None, None, None)]
    got = {(r.whole, r.doc_id): tuple(r)[2:] for r in chunking.quality(spark.createDataFrame(rows, kind), "doc_id").collect()}
    assert got == {(False, "a"): (3, 0, 50, 60, 1, 1), (False, "b"): (1, 50, 50, 50, 0, 1), (False, None): (1, 0, 0, 0, 0, 0), (True, None): (5, 0, 50, 60, 1, 2)}
    assert [tuple(r) for r in chunking.quality(spark.createDataFrame([], kind), "doc_id").collect()] == [(True, None, 0, 0, 0, 0, 0, 0)]


def test_bench_rows(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,), (4,)], "question_id int")
    relevant = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "b"), (4, "z")], "question_id int, chunk_id string")
    ranked = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "b", 1), (2, "a", 3), (3, "a", 1)], "question_id int, chunk_id string, rank int")
    of = lambda k: sorted(tuple(r) for r in evaluation.run_results(ranked, relevant, questions, k).collect())
    assert of(2) == [(1, "single", True, True, 0.5), (2, "multi", True, False, 1.0), (3, "unanswerable", False, False, 0.0), (4, "single", False, False, 0.0)]
    assert of(3)[1] == (2, "multi", True, True, 1.0)
    times = spark.createDataFrame([("x", "single", 1.0), ("x", "single", 4.0), ("x", "multi", 10.0), ("x", "multi", 7.0), ("x", "unanswerable", 99.0), ("y", "single", 3.0)], "config string, type string, latency_ms double")
    assert {tuple(r) for r in evaluation.median_latency(times, ["config"]).collect()} == {("x", 6), ("y", 3)}
