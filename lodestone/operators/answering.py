"""Whole batches of questions through a model: completion with one repair, and the requery loop.

The model is a plain function of a prompt, called in tasks.  Its replies are
kept in a store keyed by the prompt's digest: a table a run, and until that is
whole a journal that the asking task writes as soon as a few replies are there.
A task that starts again, and a run after one that failed, take what the journal
holds; so whatever is retried, run again or asked by two questions, a prompt is
asked once.  Only the replies in hand when an executor is lost, ``flush`` at
most, are asked for again.  Two copies of one task that run at the same time
(speculation) may both ask.  One run at a time fills a store.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import REFUSAL, agent_decision, strip
from ..session import written
from ..sources import journal
from . import citations
from .retrieval import merge_new

#: Refusals that are matters of form and may be repaired once, and what the model is told about them.
REPAIRABLE = {
    "missing_citation": "it cites nothing",
    "malformed_citation": "a citation isn't written as [doc_id, p.X]",
    "uncited_line": "a line doesn't end in a citation",
}
MAX_REQUERIES = 2
REPLY = "digest string, text string, input_tokens long, output_tokens long, cost_usd double"


@dataclass
class Reply:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    cost_usd: float = 0.0


@dataclass
class Replies:
    """A store of replies in ``folder``, and the model that fills it.

    ``tasks`` ask at the same time; replies are written ``flush`` at a time.
    """

    spark: SparkSession
    folder: str
    ask: Callable[[str], Reply]
    tasks: int = 64
    flush: int = 16

    def known(self) -> DataFrame:
        """Every reply of whole runs, once; what journals of failed runs hold is taken in first."""
        for run in journal.names(self.spark, self.folder, "journal-"):
            rest = self.spark.read.schema(REPLY).json(f"{self.folder}/journal-{run}/*").dropDuplicates(["digest"]).join(self._told().select("digest"), "digest", "left_anti")
            rest.write.mode("overwrite").parquet(f"{self.folder}/told-{run}-saved")
            journal.remove(self.spark, f"{self.folder}/journal-{run}")
        return self._told()

    def _told(self) -> DataFrame:
        runs = [n for n in journal.names(self.spark, self.folder, "told-") if journal.names(self.spark, f"{self.folder}/told-{n}", "_SUCCESS")]
        return self.spark.read.schema(REPLY).parquet(*(f"{self.folder}/told-{n}" for n in runs)) if runs else self.spark.createDataFrame([], REPLY)

    def of(self, prompts: DataFrame) -> DataFrame:
        """(digest, text, input_tokens, output_tokens, cost_usd) of each distinct ``prompt``, asking for those not held; a ``digest`` beside it is taken as it is."""
        digest = F.col("digest") if "digest" in prompts.columns else F.sha2("prompt", 256)
        wanted = prompts.select(digest.alias("digest"), "prompt").where("prompt IS NOT NULL")
        known, run = self.known(), uuid.uuid4().hex
        missing = wanted.join(known.select("digest"), "digest", "left_anti").withColumn("shelf", F.substring("digest", 1, 2))
        folder, ask, flush = f"{self.folder}/journal-{run}", self.ask, self.flush
        columns = [field.split()[0] for field in REPLY.split(", ")]

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            again = TaskContext.get().attemptNumber() > 0
            earlier: dict[str, dict[str, dict]] = {}
            told: set[str] = set()
            held: list[dict] = []

            def put() -> pd.DataFrame:
                by_shelf: dict[str, list[dict]] = {}
                for row in held:
                    by_shelf.setdefault(row["digest"][:2], []).append(row)
                for shelf, rows in by_shelf.items():
                    journal.write(f"{folder}/{shelf}/{uuid.uuid4().hex}.json.gz", gzip.compress("".join(json.dumps(r) + "\n" for r in rows).encode(), 1))
                out = pd.DataFrame(held, columns=columns)
                held.clear()
                return out

            for own in batches:
                for digest, prompt, shelf in zip(own.digest, own.prompt, own.shelf, strict=True):
                    if digest in told:
                        continue
                    told.add(digest)
                    # What an earlier attempt of this task was told before it was lost.
                    if shelf not in earlier:
                        earlier[shelf] = {r["digest"]: r for r in map(json.loads, journal.lines(f"{folder}/{shelf}"))} if again else {}
                    if digest in earlier[shelf]:
                        yield pd.DataFrame([earlier[shelf][digest]], columns=columns)
                        continue
                    reply = ask(prompt)
                    held.append({"digest": digest, "text": reply.text, "input_tokens": reply.input_tokens, "output_tokens": reply.output_tokens, "cost_usd": reply.cost_usd})
                    if len(held) >= flush:
                        yield put()
            yield put()

        # Equal prompts meet in one task, on one of 256 shelves.
        missing.repartition(self.tasks, "shelf").mapInPandas(work, REPLY).write.parquet(f"{self.folder}/told-{run}")
        journal.remove(self.spark, folder)
        new = self.spark.read.schema(REPLY).parquet(f"{self.folder}/told-{run}")
        return new.unionByName(known.join(wanted.select("digest").distinct(), "digest", "left_semi"))


def repair_prompt(prompt: Column, reason: Column, previous: Column) -> Column:
    """The first prompt, what was wrong, and the answer that was."""
    why = F.create_map(*(F.lit(x) for pair in REPAIRABLE.items() for x in pair))[reason]
    said = F.concat(F.lit("\n\nYour last answer isn't usable: "), why, F.lit(f'. Write it again, each line one statement that ends in [doc_id, p.X] as in the context\'s headers, or only "{REFUSAL}"\n\nLast answer:\n'), previous)
    return F.concat(prompt, said)


def complete(prompts: DataFrame, contexts: DataFrame, replies: Replies) -> DataFrame:
    """(answer_id, refused, refusal_reason, served, raw, repaired, calls, input_tokens, output_tokens, cost_usd).

    ``prompts`` are (answer_id, prompt), ``contexts`` the chunks that each was
    made of.  Answers that fail a rule of form are asked for once more, and
    judged anew; counts and costs are sums over both calls, each answer's own
    even where two share a prompt.  Without a context nothing is asked.
    Prompts are written with their digests before they are asked, so that what
    they are made of is worked out once.
    """
    numbers = ("input_tokens", "output_tokens", "cost_usd")
    known = contexts.select("answer_id").distinct()

    def held(rows: DataFrame, name: str) -> DataFrame:
        return written(rows.withColumn("digest", F.sha2("prompt", 256)), name)

    asked = held(prompts.join(known, "answer_id", "left_semi").select("answer_id", "prompt"), "asked")

    def judged(asking: DataFrame, name: str) -> DataFrame:
        """Each answer with its verdict; its prompt and pages meet the reply by digest, so texts move once."""
        replied = replies.of(asking).withColumnRenamed("text", "answer")
        own = asking.select("answer_id", "digest").join(citations.shown_pages(contexts), "answer_id").join(replied, "digest")
        return written(citations.judge(own).select("answer_id", "answer", "refusal_reason", *numbers), name)

    first = judged(asked, "first")
    repairable = F.coalesce(F.col("refusal_reason").isin(*REPAIRABLE), F.lit(False))
    again = first.where(repairable)
    prompt = repair_prompt(F.col("prompt"), F.col("refusal_reason"), F.col("answer"))
    second = judged(held(asked.join(again.select("answer_id", "refusal_reason", "answer"), "answer_id").select("answer_id", prompt.alias("prompt")), "asked-again"), "second")
    sums = [(F.col(n) + F.col(f"_{n}")).alias(n) for n in numbers]
    twice = second.join(again.select("answer_id", *(F.col(n).alias(f"_{n}") for n in numbers)), "answer_id").select("answer_id", "answer", "refusal_reason", F.lit(2).alias("calls"), *sums)
    every = first.where(~repairable).select("answer_id", "answer", "refusal_reason", F.lit(1).alias("calls"), *numbers).unionByName(twice)
    refused = F.col("refusal_reason").isNotNull()
    out = every.select("answer_id", refused.alias("refused"), "refusal_reason", F.when(refused, F.lit(REFUSAL)).otherwise(strip(F.col("answer"))).alias("served"), F.col("answer").alias("raw"), (F.col("calls") == 2).alias("repaired"), "calls", *numbers)
    none = prompts.join(known, "answer_id", "left_anti").select(
        "answer_id", F.lit(True).alias("refused"), F.lit("no_context").alias("refusal_reason"), F.lit(REFUSAL).alias("served"), F.lit(None).cast("string").alias("raw"), F.lit(False).alias("repaired"), F.lit(0).alias("calls"),
        F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(0.0).alias("cost_usd"),
    )
    return out.unionByName(none)


def requery(questions: DataFrame, search: Callable[[DataFrame], DataFrame], decide: Callable[[DataFrame], DataFrame], most: int = MAX_REQUERIES) -> tuple[DataFrame, DataFrame]:
    """All questions searched until the model has enough or its requeries are used up: chunks and steps.

    ``search`` maps (question_id, question) to (question_id, chunk_id, rank);
    ``decide`` maps (question_id, question, chunks), the held ids in order, to
    (question_id, reply).  Only questions whose reply asks for more go on;
    those without a chunk don't.  Every round is written, so a lost executor
    costs one round, and nothing is asked twice.  Gives (question_id, rank,
    chunk_id, round) in order of arrival, each chunk once, and (question_id,
    round, query).
    """
    held = written(search(questions.select("question_id", "question")).select("question_id", "chunk_id", "rank", F.lit(0).alias("round")), "held-0")
    open_ = questions.select("question_id", "question", F.col("question").alias("query"))
    steps = [open_.select("question_id", F.lit(0).alias("round"), "query")]
    for number in range(1, most + 1):
        shown = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda c: c["chunk_id"])
        packed = held.join(open_.select("question_id"), "question_id", "left_semi").groupBy("question_id").agg(shown.alias("chunks"))
        replied = decide(open_.select("question_id", "question").join(packed, "question_id")).select("question_id", "reply")
        said = open_.select("question_id", "question").join(replied, "question_id").withColumn("_d", agent_decision(F.col("reply"), F.col("question")))
        open_ = written(said.where("NOT _d.sufficient").select("question_id", "question", "_d.query"), f"open-{number}")
        if open_.isEmpty():
            break
        steps.append(open_.select("question_id", F.lit(number).alias("round"), "query"))
        more = search(open_.select("question_id", F.col("query").alias("question"))).select("question_id", "chunk_id", "rank")
        own = held.join(open_.select("question_id"), "question_id", "left_semi")
        arrived = merge_new(own.select("question_id", "chunk_id", "rank"), more).withColumn("round", F.lit(number)).join(own.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
        held = written(held.unionByName(arrived.select(held.columns)), f"held-{number}")
    every = steps[0]
    for step in steps[1:]:
        every = every.unionByName(step)
    return held.select("question_id", "rank", "chunk_id", "round"), every
