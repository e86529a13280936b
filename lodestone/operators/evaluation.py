"""Evaluation: hits, citation precision, run metrics, agreement, comparisons."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.stats import ratio, sign_test
from ..session import written
from . import citations

#: Rows of a range whose running sums one task forms.
ROWS_A_RANGE = 100_000


def _count(when: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(when, F.lit(False)).cast("long")), F.lit(0).cast("long"))


def evidence_hits(evidence: DataFrame, contexts: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, any_hit, all_hit): a page covered; a page of every document covered.

    ``evidence`` is (item_id, doc_id, page); ``contexts`` are keyed alike.
    """
    covered = contexts.select("item_id", "doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct().withColumn("_hit", F.lit(1))
    pages = evidence.join(covered, ["item_id", "doc_id", "page"], "left")
    documents = pages.groupBy("item_id", "doc_id").agg(F.max(F.coalesce("_hit", F.lit(0))).alias("_d"))
    found = documents.groupBy("item_id").agg((F.max("_d") == 1).alias("any_hit"), (F.min("_d") == 1).alias("all_hit"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("any_hit", "all_hit")))


def raw_citation_counts(outputs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(answer_id, ok, total) of the pages that raw outputs cite, with repeats."""
    cites = citations.verify(citations.extract(outputs), contexts)
    counted = cites.groupBy("answer_id").agg(_count(F.col("verified")).alias("ok"), F.count(F.lit(1)).alias("total"))
    return outputs.select("answer_id").join(counted, "answer_id", "left").select("answer_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("ok", "total")))


def run_metrics(items: DataFrame) -> DataFrame:
    """One row of a run's ratios, each with its own denominator.

    ``items``: type, refused, ok, total, any_hit, all_hit, served_citations,
    served_unverified, served_with_section, repair_attempted, error, cost_usd.
    """
    answerable, refused = F.col("type") != "unanswerable", F.col("refused")
    served = lambda c: F.coalesce(F.sum(F.when(~refused, F.col(c))), F.lit(0))
    n, k = F.count(F.lit(1)), _count(answerable)
    every = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return items.agg(
        n.alias("n"),
        ratio(_count(answerable & ~refused), k).alias("answer_rate"),
        ratio(_count(~answerable & refused), _count(~answerable)).alias("refusal_recall"),
        ratio(_count(answerable & ~refused) + _count(~answerable & refused), n).alias("task_outcome"),
        ratio(every("ok"), every("total")).alias("raw_citation_precision"),
        served("served_citations").alias("served_citations"),
        served("served_unverified").alias("served_unverified_citations"),
        ratio(served("served_with_section"), served("served_citations")).alias("section_ref_rate"),
        ratio(_count(answerable & F.col("any_hit")), k).alias("retrieval_any_hit"),
        ratio(_count(answerable & F.col("all_hit")), k).alias("retrieval_all_hit"),
        _count(F.col("repair_attempted")).alias("repairs"),
        _count(F.col("error").isNotNull()).alias("failed_items"),
        F.bround(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd"),
    )


def judged_by_both(one: DataFrame, two: DataFrame, key: str, label: str) -> DataFrame:
    """(key, a, b): the two judges' labels of what both have judged."""
    return one.select(key, F.col(label).alias("a")).join(two.select(key, F.col(label).alias("b")), key)


def refusal_histogram(items: DataFrame) -> DataFrame:
    return items.where("refused").groupBy("refusal_reason").agg(F.count(F.lit(1)).alias("n"))


def first_hits(ranked: DataFrame, relevant: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, first_rank, reciprocal): 0 where nothing relevant was found.

    ``relevant`` is (question_id, chunk_id).
    """
    found = ranked.join(relevant, ["question_id", "chunk_id"], "left_semi").groupBy("question_id").agg(F.min("rank").alias("first_rank"))
    out = questions.select("question_id").join(found, "question_id", "left")
    return out.withColumn("reciprocal", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))


def retrieval_table(results: DataFrame, keys: list[str]) -> DataFrame:
    """Hits and mean reciprocal rank of each configuration.

    ``results``: keys, type, any_hit, all_hit, reciprocal; unanswerable items
    aren't part of it.
    """
    own = results.where("type <> 'unanswerable'")
    multi = F.col("type") == "multi"
    return own.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        _count(F.col("any_hit")).alias("any_hit"),
        _count(F.col("all_hit")).alias("all_hit"),
        _count(multi & F.col("all_hit")).alias("multi_all_hit"),
        _count(multi).alias("multi_n"),
        F.bround(F.avg("reciprocal"), 3).alias("mrr"),
    )


def run_results(ranked: DataFrame, relevant: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """What ``retrieval_table`` takes, of a run's best k: question_id, type, any_hit, all_hit, reciprocal.

    ``ranked`` is (question_id, chunk_id, rank), ``relevant`` (question_id,
    chunk_id). A question with several relevant chunks is of type multi, one
    with none unanswerable.
    """
    wanted = relevant.distinct()
    found = wanted.join(ranked.where(F.col("rank") <= k), ["question_id", "chunk_id"], "left").groupBy("question_id")
    found = found.agg(F.count(F.lit(1)).alias("_wanted"), F.count("rank").alias("_found"), F.min("rank").alias("_first"))
    n = F.coalesce("_wanted", F.lit(0))
    return questions.join(found, "question_id", "left").select(
        "question_id",
        F.when(n == 0, "unanswerable").when(n == 1, "single").otherwise("multi").alias("type"),
        F.coalesce(F.col("_found") > 0, F.lit(False)).alias("any_hit"),
        (F.coalesce(F.col("_found") == F.col("_wanted"), F.lit(False))).alias("all_hit"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal"),
    )


def median_latency(results: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """(keys, p50_ms): the median of each configuration's latencies, the mean of two middle ones, to a whole number."""
    places = {"_low": F.expr("(_n - 1) div 2"), "_high": F.expr("_n div 2")}
    found = stats.at_places(results.where("type <> 'unanswerable'"), keys, value, places)
    return found.select(*keys, F.bround((F.col("_low") + F.col("_high")) / 2).cast("long").alias("p50_ms"))


def judge_summary(labels: DataFrame) -> DataFrame:
    """One row of label counts: ``type, correctness, support``."""
    answerable = F.col("type") != "unanswerable"
    of = lambda field, value: _count(answerable & (F.col(field) == value))
    return labels.agg(
        _count(answerable).alias("answerable"),
        *(of("correctness", v).alias(v) for v in ("correct", "partial", "incorrect", "refused", "unparsed")),
        *(of("support", v).alias(f"support_{v}") for v in ("supported", "partial", "unsupported", "unparsed")),
        _count(F.col("correctness") == "answered_unanswerable").alias("answered_unanswerable"),
    )


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """Rows with a label that a person or judge really gave."""
    own = F.trim(F.col(column))
    return labels.withColumn(column, own).where(own.isNotNull() & ~own.isin("refused", "answered_unanswerable", "unparsed", ""))


def paired_compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """One row: shared, entered and left keys, means, wins, losses, ties, p."""
    a, b = before.select(key, F.col(value).cast("double").alias("_a"), F.lit(True).alias("_ia")), after.select(key, F.col(value).cast("double").alias("_b"), F.lit(True).alias("_ib"))
    both = F.col("_ia") & F.col("_ib")
    out = a.join(b, key, "full").agg(
        _count(both).alias("shared"),
        _count(F.col("_ia").isNull()).alias("entered"),
        _count(F.col("_ib").isNull()).alias("left"),
        F.avg(F.when(both, F.col("_a"))).alias("mean_before"),
        F.avg(F.when(both, F.col("_b"))).alias("mean_after"),
        _count(both & (F.col("_b") > F.col("_a"))).alias("wins"),
        _count(both & (F.col("_b") < F.col("_a"))).alias("losses"),
        _count(both & (F.col("_b") == F.col("_a"))).alias("ties"),
    )
    return out.withColumn("p_value", sign_test(F.col("wins"), F.col("losses")))


def budget_prefix(items: DataFrame, keys: list[str], order: str, cost: str, cap: float) -> DataFrame:
    """Items in order up to and with the first whose running cost exceeds the cap; costs aren't negative.

    Rows are dealt over ranges of key and order, ranges totalled, and only
    those that begin within the cap are summed row by row, so a key that holds
    all rows runs in many tasks. The ranges are written, as each pass reads them.
    """
    dealt = written(items.repartitionByRange(1 + items.count() // ROWS_A_RANGE, *keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    total = dealt.groupBy(*keys, "_range").agg(F.sum(cost).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast(total.schema["_total"].dataType)
    begun = total.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.col("_range").alias("_of"), F.coalesce(F.sum("_total").over(earlier), none).alias("_base")).where(F.col("_base") <= cap)
    same = (F.col("_range") == F.col("_of")) & reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)), F.lit(True))
    w = Window.partitionBy(*keys, "_range").orderBy(order)
    own = dealt.join(begun, same)
    running = F.col("_base") + F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)), none)
    before = F.col("_base") + F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), none)
    return own.withColumn("running", running).withColumn("_before", before).where(F.col("_before") <= cap).select(*items.columns, "running")


def hash_sample(items: DataFrame, seed: str, n: int, key: str = "id") -> DataFrame:
    """A fixed sample of n items, in the order of sha256(seed:id)."""
    return items.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).orderBy("digest", key).limit(n)


def fixture_sample(items: DataFrame, limit: int = 12) -> DataFrame:
    """All refused items, and answered ones by id up to ``limit`` in total."""
    refused = items.where("refused")
    room = refused.agg(F.greatest(F.lit(limit) - F.count(F.lit(1)), F.lit(0)).alias("_room"))  # one row
    order = Window.orderBy("id")
    answered = items.where("not refused").orderBy("id").limit(limit).withColumn("_r", F.row_number().over(order))
    return refused.unionByName(answered.crossJoin(F.broadcast(room)).where("_r <= _room").drop("_r", "_room"))


def explorer(items: DataFrame, baseline: DataFrame, labels: DataFrame, judges: list[str]) -> DataFrame:
    """Each item beside its closed-book answer and every judge's label.

    ``items`` and ``baseline`` are (id, answer), ``labels`` (id, run, judge, label).
    """
    columns = [f"{run}_{judge}" for run in ("rag", "closed") for judge in judges]
    own = labels.withColumn("_column", F.concat_ws("_", "run", "judge")).groupBy("id").pivot("_column", columns)
    wide = own.agg(F.min("label"))
    closed = baseline.select("id", F.col("answer").alias("closed_answer"))
    return items.join(closed, "id", "left").join(wide, "id", "left")


def first_items(items: DataFrame, n: int, order: str, kind: str | None = None) -> DataFrame:
    """The first n items in file order, of one type if given."""
    own = items if kind is None else items.where(F.col("type") == kind)
    return own.orderBy(order).limit(n)
