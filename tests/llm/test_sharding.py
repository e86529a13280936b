"""Sharding: row counts, the mixture, gapless slots, written files, odd inputs."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm import sharding as S
from lodestone.llm.common import run_folder

SCHEMA = "doc_id long, text string, source string, shard string"


def rows(n: int) -> list[tuple]:
    """A source with two thirds of the rows, many of one row, none, repeated ids."""
    out = [(i, f"text {i % 50} é" * (i % 7), "hot" if i % 3 else f"rare{i}" if i % 2 else "some", "x") for i in range(n)]
    return out + [(None, None, None, None), (None, "", None, None), (5, "other", "hot", "y"), (5, "other", "hot", "y")]


def test_shards_match_the_mixture(spark):
    given = rows(3000)
    got = S.op12(spark.createDataFrame(given, SCHEMA)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in given)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and sorted(slots) == list(range(8))
    kind = {i: ("hot" if s == "hot" else "some" if s == "some" else "rare") for i, _, s, _ in given if i is not None}
    whole = Counter(kind.values())
    for shard in range(8):
        own = Counter(kind[r.doc_id] for r in got if r.shard == shard and r.doc_id is not None)
        for name, n in whole.items():
            assert abs(own[name] - n / 8) <= 3 + 4 * (whole["rare"] / 8) ** 0.5 * (n / len(given) if name != "rare" else 1), (shard, name, own[name], n / 8)


def test_order_is_that_of_fractional_ranks(spark):
    """One window over everything gives the same positions."""
    docs = spark.createDataFrame(rows(400)[:-4], SCHEMA)
    got = {r.id: r.position for r in S.interleave(docs, {"id": F.col("doc_id")}, [], run_folder(spark, "t")).select("row.id", "position").collect()}
    import hashlib

    digest = lambda x: hashlib.md5(f"{S.SEED}:{x}".encode()).hexdigest()
    groups = defaultdict(list)
    for i, _, source, _ in rows(400)[:-4]:
        groups[source].append((digest(f"={i}"), i))
    order = []
    for source, members in groups.items():
        u = int(digest(f"={source}")[:8], 16) / 2**32
        order += [((r + u) / len(members), key, i) for r, (key, i) in enumerate(sorted(members))]
    assert got == {i: p for p, (_, _, i) in enumerate(sorted(order))}


def test_seed_and_few_rows(spark):
    docs = spark.createDataFrame(rows(100), SCHEMA)
    place = lambda seed: {(r.id, r.position) for r in S.interleave(docs, {"id": F.col("doc_id")}, [], run_folder(spark, "t"), seed=seed).select("row.id", "position").collect()}
    assert place("a") != place("b")
    few = S.op12(docs.limit(3)).collect()
    assert len(few) == 3 and {r.slot for r in few} == {0} and len({r.shard for r in few}) == 3
    assert S.op12(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame(rows(200), "doc_id long, text string, source string, bucket string")
    table = S.write_shards(docs, str(tmp_path / "out"), run_folder(spark, "t"), shards=5)
    assert Counter(tuple(r) for r in table.select("row.*").collect()) == Counter(rows(200))
    sizes = Counter(r.shard for r in table.collect())
    assert sorted(sizes) == list(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
