"""Batches of questions through a model: replies asked once, one repair, requeries."""

import gzip
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import REFUSAL
from lodestone.operators import answering
from lodestone.sources import journal


def model(folder, stop_at=None):
    """Answers by what the prompt says, and notes each call; may stop at a prompt once."""

    def ask(prompt):
        Path(folder, uuid.uuid4().hex).write_text(prompt)
        if stop_at is not None and stop_at in prompt and not Path(folder, "stopped").exists():
            Path(folder, "stopped").write_text("")
            raise RuntimeError("lost")
        if "isn't usable" in prompt:
            return answering.Reply("Right [d1, p.1]" if "mend" in prompt else "Still wrong", 7, 3, 0.25)
        kind = prompt.split(":")[0]
        return answering.Reply({"good": "Fact [d1, p.1]", "none": REFUSAL, "far": "Fact [d1, p.9]", "line": "Fact [d1, p.1]\nmend this", "long": "Fact [d1, p.99999999999999999999]"}.get(kind, "no citation"), 5, 2, 0.5)

    return ask


def calls(folder):
    return [p.read_text() for p in Path(folder).iterdir() if p.name != "stopped"]


def asked(spark, rows):
    prompts = spark.createDataFrame(rows, "answer_id long, prompt string")
    contexts = prompts.where("answer_id < 90").select("answer_id", F.lit("c").alias("chunk_id"), F.lit("d1").alias("doc_id"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.lit(None).cast("string").alias("section"))
    return prompts, contexts


def test_completion(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    rows = [(1, "good: a"), (2, "good: a"), (3, "none: a"), (4, "far: a"), (5, "line: a"), (6, "bad: mend"), (7, "bad: a"), (8, "long: a"), (90, "good: b"), (91, None)]
    got = {r.answer_id: r for r in answering.complete(*asked(spark, rows), answering.Replies(spark, str(tmp_path / "s"), model(notes))).collect()}
    assert {i: r.refusal_reason for i, r in got.items()} == {1: None, 2: None, 3: "model_refusal", 4: "unverified_citation", 5: None, 6: None, 7: "missing_citation", 8: "unverified_citation", 90: "no_context", 91: "no_context"}
    assert {i for i, r in got.items() if r.repaired} == {5, 6, 7} and {i: r.calls for i, r in got.items() if r.calls != 1} == {5: 2, 6: 2, 7: 2, 90: 0, 91: 0}
    assert (got[6].input_tokens, got[6].output_tokens, got[6].cost_usd, got[6].served, got[7].raw) == (12, 5, 0.75, "Right [d1, p.1]", "Still wrong")
    assert got[2].cost_usd == 0.5 and got[90].cost_usd == 0.0 and all(r.served == REFUSAL for r in got.values() if r.refused)
    # Two questions of one prompt are one call; a prompt without a context is none.
    assert len(calls(notes)) == len(set(calls(notes))) == 7 + 3


def test_no_prompt_is_asked_again_after_a_loss(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    prompts, contexts = asked(spark, [(i, f"good: {i}") for i in range(80)])
    replies = answering.Replies(spark, str(tmp_path / "s"), model(notes, stop_at="good: 41"), tasks=3, flush=1)
    with pytest.raises(Exception, match="lost"):
        answering.complete(prompts, contexts, replies)
    before = len(calls(notes))
    assert journal.names(spark, replies.folder, "journal-") and replies.known().count() >= before - 3
    assert not journal.names(spark, replies.folder, "journal-")
    assert answering.complete(prompts, contexts, replies).where("NOT refused").count() == 80
    twice = [p for p in set(calls(notes)) if calls(notes).count(p) > 1]
    # The prompt that the lost call was for, and no other, but for calls in hand elsewhere.
    assert "good: 41" in twice and len(twice) <= 3
    n = len(calls(notes))
    assert answering.complete(prompts, contexts, replies).count() == 80 and len(calls(notes)) == n


def test_journal(spark, tmp_path):
    folder = f"file://{tmp_path}/j"
    assert journal.names(spark, folder, "a") == [] == list(journal.lines(folder))
    journal.write(f"{folder}/a.json", b"1\n2\n")
    (tmp_path / "j" / ".b.json.part").write_text("3\n")
    journal.write(f"{folder}/c.json.gz", gzip.compress("x\u2028y\n".encode()))
    assert journal.names(spark, folder, "a.") == ["json"] and sorted(journal.lines(folder)) == ["1", "2", "x\u2028y"]
    journal.remove(spark, folder)
    assert not (tmp_path / "j").exists()


def test_requery_equals_a_loop_over_questions(spark):
    """Against the rules applied to one question at a time."""
    index = {f"q{i}": [f"c{(i * k) % 11}" for k in range(1, 4 + 2 * (i % 4 == 0))] for i in range(30)} | {"none": []}
    follow = lambda q, held: "SUFFICIENT" if len(held) % 5 == 0 else f" insufficient: q{(len(held) * 7 + int(q[1:])) % 30}" if len(held) != 4 else "INSUFFICIENT"

    def by_hand(question):
        held, queries = list(dict.fromkeys(index[question])), [question]
        for _ in range(answering.MAX_REQUERIES):
            if not held:
                break
            reply = follow(question, held).strip()
            if not reply.upper().startswith("INSUFFICIENT"):
                break
            queries.append(reply.split(":", 1)[1].strip() if ":" in reply else question)
            held += [c for c in dict.fromkeys(index[queries[-1]]) if c not in held]
        return held, queries

    table = spark.createDataFrame([(q, c, r) for q, found in index.items() for r, c in enumerate(dict.fromkeys(found), 1)], "question string, chunk_id string, rank int")
    shown = []

    def decide(frame):
        rows = frame.collect()
        shown.append(len(rows))
        return spark.createDataFrame([(r.question_id, follow(r.question, r.chunks)) for r in rows], "question_id long, reply string")

    questions = spark.createDataFrame([(i, f"q{i}") for i in range(30)] + [(99, "none")], "question_id long, question string")
    chunks, steps = answering.requery(questions, lambda asked: asked.join(table, "question"), decide)
    held: dict[int, list] = {}
    for r in chunks.orderBy("question_id", "rank").collect():
        held.setdefault(r.question_id, []).append(r.chunk_id)
    queries: dict[int, list] = {}
    for r in steps.orderBy("question_id", "round").collect():
        queries.setdefault(r.question_id, []).append(r.query)
    for i in range(30):
        assert (held[i], queries[i]) == by_hand(f"q{i}"), i
    assert 99 not in held and queries[99] == ["none"]
    # Only questions whose reply asks for more are shown again.
    assert shown[0] == 30 and shown[1] == sum(len(q) > 1 for q in queries.values()) < 30
