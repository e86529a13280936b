"""Queries that put whole tables through a deterministic model: completion with repair, requeries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import answering, postings
from ..session import run_folder
from . import inputs
from .citation_plans import AT_ENDS, VALIDATE
from .registry import query

#: Between the parts of a repair prompt, and what the model makes of the last one.
LAST = "Last answer:\n"
WORDS = r"len(list_filter(regexp_split_to_array({x}, '[ \n]+'), lambda w: w <> ''))"


def echo(prompt: str) -> answering.Reply:
    """Says what follows the prompt's number; asked again, cites page 1 at each line's end, but for one document in five."""
    number, said = prompt.split(" ", 1)
    if LAST in said:
        said = said.split(LAST, 1)[1]
        answer = "\n".join(f"{line} [d{number}, p.1]" if line.strip() and int(number) % 5 else line for line in said.split("\n"))
    else:
        answer = said
    asked, told = len(said.split()), len(answer.split())
    return answering.Reply(answer, asked, told, (asked + 2 * told) / 1024)


def _second(sql: str) -> str:
    return re.sub(r"\b(FROM|JOIN) (answers|tokens|spans|cites|verified)\b", r"\1 \g<2>2", sql)


REPAIRED = f"""SELECT a.answer_id, array_to_string(list_transform(string_split(answer, chr(10)), lambda x: CASE WHEN {AT_ENDS.format(x='x')} <> '' AND a.answer_id % 5 > 0 THEN concat(x, ' [d', a.answer_id, ', p.1]') ELSE x END), chr(10)) AS answer
    FROM answers a JOIN first USING (answer_id) WHERE a.answer_id % 7 <> 6 AND refusal_reason IN ('missing_citation', 'malformed_citation', 'uncited_line')"""
COSTS = f"SELECT answer_id, {WORDS.format(x='answer')} AS n FROM "


@query(f"""WITH first AS ({VALIDATE}), answers2 AS ({REPAIRED}), {", ".join(f"{name}2 AS ({_second(inputs.SQL[name])})" for name in ("tokens", "spans", "cites", "verified"))}, second AS ({_second(VALIDATE)})
    SELECT answer_id, CASE WHEN k = 0 THEN true WHEN k = 2 THEN s.refused ELSE f.refused END AS refused, CASE WHEN k = 0 THEN 'no_context' WHEN k = 2 THEN s.refusal_reason ELSE f.refusal_reason END AS refusal_reason,
        CASE WHEN k = 0 THEN 'I don''t have a source for that.' WHEN k = 2 THEN s.served ELSE f.served END AS served, k = 2 AS repaired, k AS calls, k * n AS input_tokens, CASE k WHEN 0 THEN 0 WHEN 1 THEN n ELSE n + n2 END AS output_tokens,
        CASE k WHEN 0 THEN 0e0 WHEN 1 THEN 3 * n / 1024e0 ELSE (4 * n + 2 * n2) / 1024e0 END AS cost_usd
    FROM (SELECT *, CASE WHEN answer_id % 7 = 6 THEN 0 WHEN n2 IS NULL THEN 1 ELSE 2 END AS k FROM ({COSTS} answers) LEFT JOIN (SELECT answer_id, n AS n2 FROM ({COSTS} answers2)) USING (answer_id))
    JOIN first f USING (answer_id) LEFT JOIN second s USING (answer_id)""")
def answers_completed(spark, sf_dir):
    """Every document's answer judged, those that break a rule of form asked for again; a seventh has no context."""
    answers, contexts = inputs.answers(spark, sf_dir), inputs.contexts(spark, sf_dir).where("answer_id % 7 <> 6")
    prompts = answers.select("answer_id", F.concat("answer_id", F.lit(" "), "answer").alias("prompt"))
    return answering.complete(prompts, contexts, answering.Replies(spark, run_folder(spark, "replies"), echo, flush=2000)).drop("raw")


TERMS_OF = "regexp_extract_all(lower({x}), '[a-z0-9]+(?:[/.][a-z0-9]+)*')"
#: More is asked for while the ids held add up to an even number: for the second half of the question, then the first if that brought anything.
MORE = "GROUP BY question_id HAVING sum(chunk_id) % 2 = 0"
NEW = """SELECT question_id, chunk_id, n + row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank, {round} AS round FROM found JOIN ({open_}) o USING (question_id, v)
    JOIN (SELECT question_id, max(rank) AS n FROM {held} GROUP BY question_id) USING (question_id) WHERE NOT EXISTS (SELECT 1 FROM {held} h WHERE h.question_id = found.question_id AND h.chunk_id = found.chunk_id)"""


@query(f"""WITH asked_all AS (SELECT item_id * 3 + v AS question_id, unnest({TERMS_OF.format(x="CASE v WHEN 0 THEN text WHEN 1 THEN substr(text, 1 + length(text) // 2) ELSE substr(text, 1, length(text) // 2) END")}) AS term FROM benchmark, (SELECT unnest([0, 1, 2]) AS v)),
    bm25_all AS ({inputs.SQL["bm25"].replace("FROM asked", "FROM asked_all")}),
    found AS (SELECT question_id // 3 AS question_id, question_id % 3 AS v, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm25_all QUALIFY rank <= 5),
    held0 AS (SELECT question_id, chunk_id, rank, 0 AS round FROM found WHERE v = 0), open1 AS (SELECT question_id, 1 AS v FROM held0 {MORE}),
    held1 AS (SELECT * FROM held0 UNION ALL {NEW.format(round=1, open_="FROM open1", held="held0")}),
    open2 AS (SELECT question_id, CASE WHEN count(*) > 5 THEN 2 ELSE 1 END AS v FROM held1 WHERE question_id IN (SELECT question_id FROM open1) {MORE})
    SELECT question_id, chunk_id, rank, round FROM held1 UNION ALL {NEW.format(round=2, open_="FROM open2", held="held1")}""")
def requery_chunks(spark, sf_dir):
    """All benchmark questions through searches of a stored index until a decider has enough."""
    folder = run_folder(spark, "postings")
    postings.build(inputs.chunks(spark, sf_dir), folder)
    half = F.floor(F.length("question") / 2).cast("int")
    again = F.when(F.size("chunks") > 5, F.substring("question", F.lit(1), half)).otherwise(F.substring("question", half + 1, F.length("question")))
    more = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, x: a + x) % 2 == 0
    decide = lambda shown: shown.select("question_id", F.when(more, F.concat(F.lit("Insufficient: "), again)).otherwise(F.lit("SUFFICIENT")).alias("reply"))
    chunks, _ = answering.requery(inputs.questions(spark, sf_dir), lambda asked: postings.search(asked, folder, 5), decide)
    return chunks.select("question_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "round")
