import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.common import documents, run_folder
from lodestone.llm.graph import connected_components
from lodestone.llm import near_dedup
from lodestone.llm.near_dedup import components, estimate, representatives
from lodestone.llm.shingles import shingle_sets


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for at, (i, own) in enumerate(sets):
        if i is not None:
            for s in own:
                holders.setdefault(s, []).append(at)
    tried = set()
    for group in holders.values():
        for x, p in enumerate(group):
            for q in group[x + 1 :]:
                if (p, q) not in tried:
                    tried.add((p, q))
                    (i, a), (j, b) = sets[p], sets[q]
                    if 100 * len(a & b) >= 75 * len(a | b):
                        a, b = sorted((root(i), root(j)))
                        parent[b] = a
    return sorted([(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets], key=str)


def result(spark, docs):
    return sorted(map(tuple, components(spark, docs).collect()), key=str)


def test_matches_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(spark, docs) == brute(rows)


def family(rng, words, copies, edits):
    base = [f"w{rng.integers(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        own = list(base)
        for _ in range(edits):
            own[rng.integers(words)] = f"v{rng.integers(10**6)}"
        out.append(" ".join(own))
    return out


def test_families_chains_and_edges(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \t ", "one", "One\n", "a b c d", "a b c d e", "a b c d e f g h", "a b c d e f g h i", "x " * 5000, "x " * 4000]
    for words, copies, edits in ((12, 20, 1), (60, 30, 2), (80, 30, 3), (300, 60, 8), (70, 10, 2), (1000, 5, 20)):
        texts += family(rng, words, copies, edits)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.integers(10**6)}" for _ in range(rng.integers(5, 60))) for _ in range(60)]
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join(chain[i * 8 :] + [f"d{i}{j}" for j in range(i * 8)]) for i in range(6)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)] + [(None, texts[-1]), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, n long")
    want = brute(rows)
    assert result(spark, docs) == want
    assert representatives(spark, docs).columns == docs.columns
    assert representatives(spark, docs).count() == sum(r[3] for r in want)
    assert components(spark, docs.limit(0)).count() == 0


def test_sets_equal_words():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "B", "c\x0b", "é", "\xa0", "dd"], rng.integers(0, 40))) for _ in range(500)]
    hashes = {}
    for text, own in zip(texts, shingle_sets(texts), strict=True):
        assert len(own) == len(shingles(text))
        known = hashes.setdefault(frozenset(shingles(text)), own.tobytes())
        assert known == own.tobytes()
    assert len(set(hashes.values())) == len(hashes)


def test_estimate():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.75, 1.0):
        every = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
        shared = rng.random(len(every)) < share
        side = rng.random(len(every)) < 0.5
        a, b = every[shared | side], every[shared | ~side]
        true = len(np.intersect1d(a, b)) / len(every)
        assert estimate(a[:128], b[:128]) == pytest.approx(true, abs=0.25)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 202), (200, 202), (7, 7)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), run_folder(spark, "g"))
    rows = {r.node: r.component for r in got.collect()}
    assert rows == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys(range(200, 203), 200)}
    none = connected_components(spark.createDataFrame([], "src long, dst long"), run_folder(spark, "g"))
    assert none.count() == 0


def test_long_words_differ():
    a = "x"
    for _ in range(11):
        a += a.translate(str.maketrans("xy", "yx"))
    b = a.translate(str.maketrans("xy", "yx"))
    one, two, again = shingle_sets([a, b, a.upper()])
    assert one.tobytes() != two.tobytes() and one.tobytes() == again.tobytes()


def test_templates_make_no_pairs(spark):
    """Pages of one template without a link: entries that leave no room go before pairs are formed."""
    rng = np.random.default_rng(2)
    for count in (200, 400):
        docs = spark.createDataFrame(list(enumerate(family(rng, 300, count, 12))), "doc_id long, text string")
        sets = near_dedup.profiles(docs, retain=None).selectExpr("doc_id as id", "n_shingles as n", "sketch")
        entries = near_dedup.list_entries(sets, True).withColumn("c", F.col("id"))
        assert near_dedup.banded_pairs(entries).count() <= 4 * count


def test_banded_pairs_lose_no_link(spark):
    rng = np.random.default_rng(8)
    texts = [t for words, copies, edits in ((40, 15, 1), (60, 20, 3), (90, 20, 4), (120, 10, 5)) for t in family(rng, words, copies, edits)]
    texts += [" ".join(t.split()[: len(t.split()) * int(rng.integers(70, 100)) // 100]) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = near_dedup.profiles(docs, retain=None).selectExpr("doc_id as id", "n_shingles as n", "sketch")
    got = {tuple(r) for r in near_dedup.banded_pairs(near_dedup.list_entries(sets, True).withColumn("c", F.col("id"))).collect()}
    own = [shingles(t) for t in texts]
    want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j])}
    # Equal sets are one class in the operator.
    assert len(want) > 50 and want <= got
