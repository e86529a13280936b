"""How filters interact, from Walsh-Hadamard sums.

A document's failures are a mask of bits, one a filter.  For each part and
label, the ``2 ** filters`` parity sums of the masks, ``sum((-1) ** |m & k|)``
over documents for each k, are aggregated in one pass (they add up over tasks
and tables, whatever is asked later).  Inverted exactly, they give the number
of documents of each mask: ``cell(m) = sum(W(k) * (-1) ** |m & k|) / 2 **
filters``, a whole number or the run ends.  Every order of the filters, and the
closed form of each filter's removals summed over all orders (a document that
fails f of n filters is removed by each of them in ``n! / f`` orders), are
arithmetic on those few cells.

A repeated text fails the last filter but for the smallest id that has it,
table-wide: texts meet by SHA-256 digest and length; a group keeps one id,
found by partial aggregation, and rows are joined to it by digest and id, so a
text that a third of all rows share splits by id.

Defined results: null texts are empty, null parts the empty string.  A null id
is smaller than none, so such a row never fails as a copy and makes none fail;
rows that share the smallest id stay both.  A document without a label, or id, is
neither good nor toxic; labels of a repeated id count once if any row has
them.  Texts of any length are taken whole.  Labels' and documents' other
columns play no part.  An empty table gives no part, so no row.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, whole_text

FILTERS = "ABCDE"
LABELS = ("all", "good", "toxic")


def failures(text: Column) -> list[Column]:
    """Whether a whole text fails the filters A to D."""
    words = F.array_remove(F.split(text, f"{ASCII_SPACE}+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 3 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def masks(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, label, mask) of every document, a row for each of ``LABELS`` that it has."""
    text = F.col("_text")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), whole_text(f"`{text_col}`").alias("_text"))
    own = sum((F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate(failures(text))), F.lit(0))
    rows = rows.select("id", "part", F.sha2(text, 256).alias("digest"), F.length(text).alias("size"), own.alias("own"))
    first = rows.where("id is not null").groupBy("digest", "size").agg(F.min("id").alias("id")).withColumn("_first", F.lit(True))
    copy = F.col("_first").isNull() & F.col("id").isNotNull()
    marked = rows.join(first, ["digest", "size", "id"], "left").select("id", "part", (F.col("own") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    both = marked.join(known, "id", "left")
    held = F.array(F.lit("all"), F.when(F.col("_good"), F.lit("good")), F.when(F.col("_toxic"), F.lit("toxic")))
    return both.select("part", F.explode(F.array_compact(held)).alias("label"), "mask")


def _sign(mask: Column, k: Column) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(k)) % 2)


def parity_sums(masked: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, label, sums): the signed sums for each k, which add up over any split of the documents."""
    sums = masked.groupBy("part", "label").agg(*(F.expr(f"sum(1L - 2 * (bit_count(mask & {k}) % 2))").alias(f"_{k}") for k in range(1 << filters)))
    return sums.select("part", "label", F.array(*(f"_{k}" for k in range(1 << filters))).alias("sums"))


def cells(sums: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, label, cells): documents of each mask, by the inverse transform."""
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    raw = F.transform(every, lambda m: F.aggregate(F.zip_with(F.col("sums"), every, lambda w, k: w * _sign(m, k)), F.lit(0).cast("long"), lambda a, x: a + x))
    whole = F.transform(raw, lambda c: F.when(c % (1 << filters) == 0, F.expr("1")).otherwise(F.raise_error(F.lit("parity sums of no set of documents")).cast("int")) * F.floor(c / (1 << filters)))
    return sums.select("part", "label", whole.alias("cells"))


def _total(cell: Column, holds, weight=None) -> Column:
    """The cells' sum where ``holds(mask)``, times ``weight(mask)``."""
    each = F.transform(cell, lambda n, m: F.when(holds(m), n if weight is None else n * weight(m)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def orders(celled: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row a part, order and step of the filters: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    none = F.array(*[F.lit(0).cast("long")] * (1 << len(filters)))
    parts = celled.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == label, F.col("cells"))), none).alias(label) for label in LABELS))
    every = F.split(F.lit(",".join("".join(order) for order in permutations(filters))), ",")
    rows = parts.select("*", F.explode(every).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    # Of the filters before this step, and of its own.
    earlier = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << bit).otherwise(0) for bit, x in enumerate(filters)), F.lit(0))
    own = sum((F.when(F.instr("filter_order", x) == F.col("step"), 1 << bit).otherwise(0) for bit, x in enumerate(filters)), F.lit(0))
    rows = rows.withColumns({"before": earlier, "bit": own})
    before, bit = F.col("before"), F.col("bit")
    here = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    share = F.lit(factorial(len(filters)))
    return rows.select(
        "part",
        "filter_order",
        "step",
        _total(F.col("all"), lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        _total(F.col("all"), here).alias("removed"),
        _total(F.col("all"), lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"),
        _total(F.col("all"), lambda m: m == bit).alias("unique_fails"),
        _total(F.col("good"), here).alias("good_lost"),
        _total(F.col("toxic"), here).alias("toxic_lost"),
        _total(F.col("all"), lambda m: m.bitwiseAND(bit) != 0, lambda m: F.floor(share / F.greatest(F.bit_count(m), F.lit(1)))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return orders(cells(parity_sums(masks(docs, labels))))


ORACLE_SQL = r"""
    WITH rows AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
            doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS later
        FROM documents
    ), flags AS (
        SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
            regexp_matches(t, '[#$%&*|]') AS d, coalesce(later, false) AS e,
            coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
        FROM (SELECT row_number() OVER () AS n, * FROM rows) LEFT JOIN labels USING (doc_id) GROUP BY n, part, t, w, later
    ), fails AS (SELECT part, good, toxic, [x for x in ['A', 'B', 'C', 'D', 'E'] if [a, b, c, d, e][ascii(x) - 64]] AS f FROM flags
    ), same AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM fails GROUP BY ALL
    ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
    ), perms AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
    ), steps AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[1 : step - 1], '') AS before FROM perms, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step))
    SELECT part, filter_order, step,
        CAST(coalesce(sum(n) FILTER (NOT list_contains(f, own) AND NOT list_has_any(f, before)), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (list_contains(f, own) AND NOT list_has_any(f, before)), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (list_contains(f, own) AND list_has_any(f, before)), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (f = [own]), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(n_good) FILTER (list_contains(f, own) AND NOT list_has_any(f, before)), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(n_toxic) FILTER (list_contains(f, own) AND NOT list_has_any(f, before)), 0) AS BIGINT) AS toxic_lost,
        CAST(coalesce(sum(n * 120 // greatest(len(f), 1)) FILTER (list_contains(f, own)), 0) AS BIGINT) AS shapley
    FROM same, steps GROUP BY part, filter_order, step"""
