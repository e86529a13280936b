"""The audit against filters applied one by one, in every order."""

from __future__ import annotations

import re
from itertools import permutations

import pytest

from lodestone.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, part string"
LABELS = "doc_id long, quality int, toxic int, mask int"


def fails(rows):
    """Each row's failed filters by the contract's words."""
    out = []
    for i, text, *_ in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        own = set()
        if len(words) < 200:
            own.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            own.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            own.add("C")
        if re.search(r"[#$%&*|]", t):
            own.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows):
            own.add("E")
        out.append(own)
    return out


def by_hand(rows, labels):
    out = {}
    masks = fails(rows)
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x, *_ in labels if x == 1 and i is not None}
    for part in {lang or "" for _, _, lang, _ in rows}:
        own = [(i, m) for (i, _, lang, _), m in zip(rows, masks, strict=True) if (lang or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        table = []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, m) for i, m in left if x in m]
                left = [(i, m) for i, m in left if x not in m]
                total[x] += len(gone)
                redundant = sum(x in m for _, m in own) - len(gone)
                table.append((part, "".join(order), step, len(left), len(gone), redundant, sum(m == {x} for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x))
        out |= {row[:3]: (*row[3:9], total[row[9]]) for row in table}
    return out


def cases():
    long = " ".join(f"w{k}" for k in range(210))
    dull = "same words here " * 80
    texts = ["", None, long, long + " #", dull, dull + "%", long.upper(), "SHORT | text", long + " A", "plain", "plain", long, None, dull]
    rows = [(k, t, ("en", "de", None, "")[k % 4], "x") for k, t in enumerate(texts * 3)]
    rows += [(None, "plain", "en", None), (None, "plain", "en", None), (3, texts[3], "en", None), (500, "once more", "fr", None)]
    labels = [(k, k % 2, (k // 2) % 2, 0) for k in range(0, 40, 2)] + [(4, 0, 1, 0), (4, None, None, 0), (None, 1, 1, 0), (9999, 1, 1, 0)]
    return rows, labels


def test_audit_equals_brute_force(spark):
    rows, labels = cases()
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in A.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert got == by_hand(rows, labels)
    assert len(got) == 600 * 4


def test_empty_tables(spark):
    rows, labels = cases()
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    assert A.audit(docs.limit(0), known).count() == 0
    assert A.audit(docs, known.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_sums_add_up_over_splits(spark):
    """Sums of two halves, added, are the sums of the whole."""
    rows, labels = cases()
    masked = A.masks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    schema = "part string, label string, mask int"
    sums = lambda some: {(r.part, r.label): r.sums for r in A.parity_sums(spark.createDataFrame(some, schema)).collect()}
    one, two, both = sums(masked[::2]), sums(masked[1::2]), sums(masked)
    for key, value in both.items():
        assert [a + b for a, b in zip(one.get(key, [0] * 32), two.get(key, [0] * 32), strict=True)] == value


def test_sums_that_no_documents_give_are_refused(spark):
    wrong = spark.createDataFrame([("en", "all", [1] * 31 + [2])], "part string, label string, sums array<long>")
    with pytest.raises(Exception, match="no set of documents"):
        A.cells(wrong).collect()
