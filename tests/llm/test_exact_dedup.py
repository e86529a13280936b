import hashlib
import re

from lodestone.llm.common import documents
from lodestone.llm.exact_dedup import deduplicate, equal_text_groups


def brute(rows):
    norm = {}
    for i, t in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in norm.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_matches_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, equal_text_groups(docs).collect()), key=str) == brute(rows)


def test_edges(spark):
    rows = [(5, "a  b"), (3, "a\n\x0bb"), (9, "a b"), (9, "a b"), (None, "a b"), (None, None), (None, ""), (1, "  "), (2, "\t"), (4, "A b"), (6, "a\xa0b"), (7, " a b"), (8, "x" * 200_000), (10, "x" * 200_000), (11, "  " * 3 + "q")]
    docs = spark.createDataFrame([(i, t, "k", "d") for i, t in rows], "doc_id long, text string, kept string, id string")
    assert sorted(map(tuple, equal_text_groups(docs).collect()), key=str) == brute(rows)
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    assert equal_text_groups(docs.limit(0)).count() == 0


def test_hot_group(spark):
    docs = spark.range(5000).selectExpr("id + 10 as doc_id", "if(id % 3 = 0, 'hot  text', concat('t', id)) as text")
    got = equal_text_groups(docs)
    assert got.where("keep_id = 10").count() == 1667 and got.where("kept").count() == 5000 - 1666
