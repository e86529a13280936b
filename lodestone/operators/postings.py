"""A stored inverted index, and BM25's exact best k from it by block bounds.

Built once, in one pass over the chunks and without a shuffle of words: each
run of ``RANGE`` chunks that a task reads is a *range*, and a *block* holds one
term's postings in one range (chunk ids, counts, lengths).  Tables of a build:

* ``blocks``: bucket, term, range, ids, tfs, lens; in folders by a hash of the
  term, as many as the chunks ask for, so a question reads those of its terms;
* ``bounds``: bucket, term, range, n, most: the greatest part of a score, but
  for the term's weight, that a posting of the block gives;
* ``terms``: bucket, term, df;
* a record with the number and mean length of chunks and the mean weight of
  terms, written last.

A search leaves out most ranges.  A block's bound for a question is its greatest
part times the term's weight; a range's, the sum of its blocks', caps the score
of each of its chunks.  The ranges of greatest bound are scored first, and the
k-th best score there is the question's threshold: a range whose bound stays
below it holds nothing that could be among the best k, ties included, so the
result is exact.  Ranges are scored whole where their blocks meet, as one matrix
of questions by chunks, and give each question's best k of the range.

Empty and null texts have no terms; they count as chunks with length 0.  Ids
keep their type and tell chunks apart, as those of an index do.  A task's
chunks are put into ranges by length, as like lengths give closer bounds.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import TERM, terms
from ..session import written
from .retrieval import B, DIGITS, EPSILON, K1, top

#: Chunks of a range.
RANGE = 256
#: Chunks for each folder of blocks, and folders at most.
CHUNKS_A_BUCKET, MOST_BUCKETS = 20_000, 4096
#: Tasks that write a folder of blocks.
TASKS_A_BUCKET = 4
#: Ranges of greatest bound that a question's threshold comes from.
SEEDS = 2
#: Questions that meet a range's blocks in one task, and that are scored as one matrix.
QUESTIONS_A_PART, QUESTIONS_AT_ONCE = 5_000, 500


def _open(spark: SparkSession, folder: str, name: str, kind: str) -> DataFrame:
    """A table of a build whose chunk ids are of this type; one without rows has no files."""
    columns = {"blocks": f"range long, ids array<{kind}>, tfs array<int>, lens array<int>", "bounds": "range long, n int, most double", "terms": "df long"}
    return spark.read.schema(f"term string, {columns[name]}, bucket int").parquet(f"{folder}/{name}")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _blocks(chunks: DataFrame) -> DataFrame:
    """(term, range, ids, tfs, lens): every block, made where its chunks are read."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    schema = f"term string, range long, ids array<{kind}>, tfs array<int>, lens array<int>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = batch.column("chunk_id").to_pylist()
            # A chunk's words become numbers and counts at once; a batch's text is unpacked a range at a time.
            every: dict[str, int] = {}
            sizes: list[int] = []
            counted: list[tuple[np.ndarray, np.ndarray]] = []
            for low in range(0, len(keys), RANGE):
                for text in batch.column("text").slice(low, RANGE).to_pylist():
                    count = Counter(find(text) if text else [])
                    sizes.append(count.total())
                    counted.append((np.fromiter((every.setdefault(word, len(every)) for word in count), np.int32, len(count)), np.fromiter(count.values(), np.int32, len(count))))
            names = pa.array(list(every), pa.string())
            order = sorted(range(len(keys)), key=sizes.__getitem__)
            for low in range(0, len(order), RANGE):
                own = order[low : low + RANGE]
                used, term = np.unique(np.concatenate([counted[i][0] for i in own]), return_inverse=True)
                tf = np.concatenate([counted[i][1] for i in own])
                place = np.repeat(np.arange(len(own)), [len(counted[i][0]) for i in own])
                by_term = np.argsort(term, kind="stable")
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(used)))]).astype(np.int32))
                place = place[by_term]
                values = (pa.array([keys[i] for i in own], arrow.field("ids").type.value_type).take(pa.array(place)), pa.array(tf[by_term]), pa.array(np.array([sizes[i] for i in own], np.int32)[place]))
                lists = [pa.ListArray.from_arrays(ends, v).cast(arrow.field(name).type) for name, v in zip(("ids", "tfs", "lens"), values, strict=True)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(used)), pa.array(np.full(len(used), number, np.int64)), *lists], schema=arrow)
                number += 1

    return chunks.select("chunk_id", F.lower("text").alias("text")).mapInArrow(work, schema)


def _impact(tf, length, mean):
    """A posting's part of a score, but for its term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def build(chunks: DataFrame, folder: str) -> dict:
    """Write the index of ``chunks`` (chunk_id, text) to a new folder; returns its record."""
    spark = chunks.sparkSession
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    n = chunks.count()
    buckets = min(MOST_BUCKETS, 1 + n // CHUNKS_A_BUCKET)
    dealt = _blocks(chunks).withColumn("bucket", _bucket(buckets)).repartition(buckets * TASKS_A_BUCKET, "bucket", F.pmod(F.hash("term"), F.lit(TASKS_A_BUCKET)))
    dealt.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{folder}/blocks")
    blocks = _open(spark, folder, "blocks", kind)
    words = blocks.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    mean = words / n if n else 0.0
    parts = F.transform(F.arrays_zip("tfs", "lens"), lambda p: _impact(p["tfs"], p["lens"], F.lit(mean)))
    # Read as whole files, so a folder's bounds stay in about as many.
    blocks.select("bucket", "term", "range", F.size("ids").alias("n"), F.array_max(parts).alias("most")).write.partitionBy("bucket").parquet(f"{folder}/bounds")
    _open(spark, folder, "bounds", kind).groupBy("bucket", "term").agg(F.sum("n").alias("df")).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{folder}/terms")
    weight = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    record = {"chunks": n, "kind": kind, "buckets": buckets, "mean_length": mean, "mean_weight": _open(spark, folder, "terms", kind).agg(F.avg(weight)).first()[0] or 0.0}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(f"{folder}/record")
    return record


def _record(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/record").first().value)


def _read(spark: SparkSession, folder: str, name: str, buckets: list[int]) -> DataFrame:
    """A table's rows in some folders; others aren't opened."""
    return spark.read.parquet(f"{folder}/{name}").where(F.col("bucket").isin(buckets))


def search(questions: DataFrame, folder: str, k: int, seeds: int = SEEDS) -> DataFrame:
    """(question_id, chunk_id, score, rank): the best k of each question that share a term with it."""
    return Search(questions, folder, k, seeds).best()


def _score_range(k: int, mean: float, schema: pa.Schema):
    """A function of a range's blocks and the questions' entries there: each question's best ``k``, and what ties with them."""

    def work(blocks: pa.Table, entries: pa.Table) -> pa.Table:
        if not len(blocks) or not len(entries):
            return schema.empty_table()
        # Postings of all blocks in a row; a term has one block in a range.
        ids = blocks["ids"].combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy())
        keys = ids.flatten().dictionary_encode()
        chunk, width = keys.indices.to_numpy(), len(keys.dictionary)
        tf, length = (blocks[name].combine_chunks().flatten().to_numpy().astype(np.float64) for name in ("tfs", "lens"))
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        known = {term: i for i, term in enumerate(blocks["term"].to_pylist())}
        asked = entries["question_id"].combine_chunks().dictionary_encode()
        question, weight = asked.indices.to_numpy(), entries["w"].to_numpy()
        block = np.array([known[term] for term in entries["term"].to_pylist()])
        order = np.argsort(question, kind="stable")
        question, weight, block = question[order], weight[order], block[order]
        out = []
        for low in range(0, len(asked.dictionary), QUESTIONS_AT_ONCE):
            first, last = np.searchsorted(question, [low, low + QUESTIONS_AT_ONCE])
            own, n = block[first:last], sizes[block[first:last]]
            at = np.arange(n.sum()) + np.repeat(starts[own] - np.cumsum(n) + n, n)
            cell = np.repeat(question[first:last] - low, n) * width + chunk[at]
            count = min(QUESTIONS_AT_ONCE, len(asked.dictionary) - low)
            score = np.bincount(cell, np.repeat(weight[first:last], n) * impact[at], count * width).reshape(count, width)
            met = np.bincount(cell, minlength=count * width).reshape(count, width) > 0
            rank = np.where(met, score, -np.inf)
            least = np.partition(rank, -k, axis=1)[:, -k] if k < width else np.full(count, -np.inf)
            q, c = np.nonzero(met & (rank >= least[:, None] - 2 * 10.0**-DIGITS))
            out.append(pa.table([asked.dictionary.take(pa.array(q + low)), keys.dictionary.take(pa.array(c)), pa.array(score[q, c])], schema=schema))
        return pa.concat_tables(out)

    return work


class Search:
    """One batch's search, step by step; every step is written, so none is run twice."""

    def __init__(self, questions: DataFrame, folder: str, k: int, seeds: int = SEEDS):
        self.spark, self.folder, self.k = questions.sparkSession, folder, k
        record = _record(self.spark, folder)
        self.mean, self.kind = record["mean_length"], record["kind"]
        asked = questions.select("question_id", F.explode(terms(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("times")).withColumn("bucket", _bucket(record["buckets"]))
        # At most as many numbers as there are folders.
        self.buckets = sorted(r.bucket for r in asked.select("bucket").distinct().collect())
        raw = F.log(record["chunks"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        weight = F.when(raw < 0, F.lit(EPSILON * record["mean_weight"])).otherwise(raw)
        self.wanted = written(asked.join(self._read("terms"), ["bucket", "term"]).select("question_id", "bucket", "term", (F.col("times") * weight).alias("w")), "wanted")
        # Questions are dealt in parts, so that a range's entries are bounded.
        self.parts = 1 + self.wanted.select("question_id").distinct().count() // QUESTIONS_A_PART
        # A negative weight only takes from a score. A row a question, term and range, not one a posting.
        bound = F.greatest(F.col("w") * F.col("most"), F.lit(0.0))
        part = F.pmod(F.xxhash64("question_id"), F.lit(self.parts)).cast("int")
        self.entries = written(self._read("bounds").join(self.wanted, ["bucket", "term"]).select("question_id", "term", "range", "w", bound.alias("bound"), "n", part.alias("part")), "entries")
        ranges = self.entries.groupBy("question_id", "range").agg(F.sum("bound").alias("whole"))
        order = Window.partitionBy("question_id").orderBy(F.col("whole").desc(), "range")
        numbered = written(ranges.withColumn("_r", F.row_number().over(order)), "ranges")
        self.first = numbered.where(F.col("_r") <= seeds).select("question_id", "range")
        self.seeded = written(top(self._scores(self.first), k), "seeded")
        # Scores are compared after rounding, so what is nearly at the threshold stays.
        least = self.seeded.where(F.col("rank") == k).select("question_id", (F.col("score") - 2 * 10.0**-DIGITS).alias("least"))
        self.rest = numbered.where(F.col("_r") > seeds).join(least, "question_id", "left").where("least IS NULL OR whole >= least").select("question_id", "range")

    def _read(self, name: str) -> DataFrame:
        """A table's rows in the folders of the asked terms; others aren't opened."""
        return _open(self.spark, self.folder, name, self.kind).where(F.col("bucket").isin(self.buckets))

    def _scores(self, ranges: DataFrame) -> DataFrame:
        """(question_id, chunk_id, score): the best of each of these (question_id, range)."""
        entries = self.entries.join(ranges, ["question_id", "range"], "left_semi").select("part", "range", "question_id", "term", "w")
        blocks = self._read("blocks").join(self.wanted.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        met = blocks.join(ranges.select("range").distinct(), "range", "left_semi").select(F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part"), "range", "term", "ids", "tfs", "lens")
        schema = f"question_id {self.wanted.schema['question_id'].dataType.simpleString()}, chunk_id {self.kind}, score double"
        work = _score_range(self.k, self.mean, to_arrow_schema(StructType.fromDDL(schema)))
        return met.groupBy("part", "range").cogroup(entries.groupBy("part", "range")).applyInArrow(work, schema)

    def best(self) -> DataFrame:
        columns = ["question_id", "chunk_id", "score"]
        return top(self.seeded.select(columns).unionByName(self._scores(self.rest)), self.k)

    def counts(self) -> dict[str, int]:
        """Postings of the asked terms, and those of ranges that are scored; once a question."""
        n = lambda ranges: self.entries.join(ranges, ["question_id", "range"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return {"postings": self.entries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "added": n(self.first) + n(self.rest)}
