"""Shards that each match the mixture: proportional stratified interleaving.

Within each source, rows are shuffled by a seeded digest of their id and
ranked; a row's fractional rank is (rank + u) / rows of the source, u in
[0, 1) being the source's own by the same seed (or all sources of one row
would meet in the middle).  Rows sorted by fractional rank, whatever their
source, are cut into shards whose row counts differ by one at most; each shard
holds of each source its share, give or take a row or two where sources are
few; many sources of a row or so fall as by chance, so together they differ by
about the root of their share, which moves the cuts of the others as much.

Both orders are made in two levels (``operators.prefix``): digests, then
fractional ranks, are dealt over as many ranges as the root of the rows, so a
source that holds most rows, or the whole table, is never sorted in one task.
The ranges' sizes are counted from ids and sources alone.  Nothing is sampled,
and a lost task redoes the same rows.

Defined results: a null source is a source of its own; a null id is shuffled
as one id.  Repeated ids keep their order by the columns in ``tie``; rows equal
in those too are alike, so either may come first.  Texts of any length pass
through whole.  Fewer rows than shards leave the last ones empty; an empty
table gives an empty result.  Carried columns are one struct, so their names
clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import prefix
from .common import materialise, run_folder, whole_text

SHARDS = 8
SEED = "interleave-1"


def _fraction(text: Column) -> Column:
    """A number in [0, 1) from a text's digest, the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def _text(column: Column) -> Column:
    """A text that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def interleave(docs: DataFrame, carried: dict[str, Column], tie: list[str], folder: str, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(row, shard, slot, position) of every row, ``row`` a struct of ``carried``.

    ``tie`` names fields of it that order rows of one id.
    """
    ids, sources = _text(F.col(f"`{id_col}`")), _text(F.col(f"`{source_col}`"))
    rows = docs.count()  # of the files' footers
    n = prefix.ranges(rows)
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), ids))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n / F.lit(float(1 << 32))).cast("int")
    keyed = docs.select(sources.alias("stratum"), shuffled.alias("key"), F.struct(*(c.alias(name) for name, c in carried.items())).alias("row")).withColumn("bucket", bucket)
    sized = docs.select(sources.alias("stratum"), shuffled.alias("key")).withColumn("bucket", bucket).groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    order = ["key", *(F.col(f"row.`{name}`") for name in tie)]
    within = prefix.ranked(keyed, ["stratum"], "bucket", order, sized)
    share = (F.col("place") + _fraction(F.concat(F.lit(f"{seed}:"), F.col("stratum")))) / F.col("whole")
    fractions = materialise(within.select("row", "stratum", "key", share.alias("share")).withColumn("bucket", F.floor(F.col("share") * n).cast("int")), folder, "fractions")
    spread = fractions.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    placed = prefix.ranked(fractions, [], "bucket", ["share", "key", "stratum", *order[1:]], spread)
    shard = F.floor(F.col("place") * shards / F.col("whole")).cast("int")
    # The first position of shard s is the least p with p * shards >= s * rows.
    first = F.floor((F.col("shard").cast("long") * F.col("whole") + (shards - 1)) / F.lit(shards)).cast("long")
    return placed.withColumn("shard", shard).select("row", "shard", (F.col("place") - first).alias("slot"), F.col("place").alias("position"))


def write_shards(docs: DataFrame, path: str, folder: str, shards: int = SHARDS, seed: str = SEED, **columns: str) -> DataFrame:
    """The rows with all their columns as Parquet, a folder ``shard=s`` each, by slot; returns the table.

    A shard is written by as many tasks as its size asks for, in slot order.
    """
    whole = interleave(docs, {c: F.col(f"`{c}`") for c in docs.columns}, [], folder, shards, seed, **columns)
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op12(docs: DataFrame) -> DataFrame:
    """The query's digest: where each document lies, under the law ``rows``."""
    text = whole_text().cast("binary")
    carried = {"doc_id": F.col("doc_id").cast("long"), "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text)}
    placed = interleave(docs, carried, ["size", "text_crc32"], run_folder(docs.sparkSession, "shards"))
    return placed.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no crc32: the table of its bytes, and the fold over a text's.
_CRC = """
    crc_steps AS (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i)),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps),
    crcs AS (SELECT text, xor(list_reduce(list_transform(range(octet_length(encode(text))), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
        FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), crc_table)"""

ORACLE_SQL = f"""
    WITH {_CRC},
    rows AS (
        SELECT doc_id, octet_length(encode(coalesce(d.text, ''))) + 1 AS size, crc AS text_crc32, coalesce('=' || source, '') AS stratum,
            md5('{SEED}:' || coalesce('=' || doc_id, '')) AS key
        FROM documents d JOIN crcs ON crcs.text = coalesce(d.text, '')
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n FROM rows
    ), fractions AS (
        SELECT *, (r + ('0x' || substr(md5('{SEED}:' || stratum), 1, 8))::BIGINT / 4294967296e0) / n AS share FROM ranked
    ), placed AS (
        SELECT *, row_number() OVER (ORDER BY share, key, stratum, size, text_crc32) - 1 AS p, count(*) OVER () AS n_all FROM fractions
    ), cut AS (SELECT *, CAST(p * {SHARDS} // n_all AS INT) AS shard FROM placed)
    SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY p) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM cut"""
