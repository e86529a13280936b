"""Periodic runs against brute force over every period."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import periodic_runs as P


def brute(x: list, shortest: int) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for period in range(1, len(x) // 2 + 1):
        low = 0
        while low + period < len(x):
            high = low
            while high + period < len(x) and x[high] == x[high + period]:
                high += 1
            if high + period - low >= max(shortest, 2 * period):
                found.setdefault((low, high + period), period)
            low = high + 1
    return sorted(((low, high, period) for (low, high), period in found.items()), key=lambda r: (r[0], r[2]))


def pieces(seed: int) -> list[int]:
    """Words of small vocabularies with repeated passages put in."""
    dice = random.Random(seed)
    x = [dice.randrange(dice.choice([1, 2, 3, 9])) for _ in range(dice.randrange(90))]
    for _ in range(dice.randrange(5)):
        if x:
            at = dice.randrange(len(x))
            x[at:at] = x[dice.randrange(len(x)) :][: dice.randint(1, 25)] * dice.randint(1, 6)
    return x


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_equal_brute_force(shortest):
    for seed in range(400):
        x = pieces(seed)
        assert P.runs(x, shortest) == brute(x, shortest), (seed, x)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_any_words(x):
    assert P.runs(x, 4) == brute(x, 4)


def test_factors_are_the_longest_with_an_earlier_start():
    for seed in range(100):
        x = pieces(seed)
        at = 0
        for start, length, earlier in P.factors(x):
            assert start == at
            at += length
            known = [j for j in range(start) if x[j : j + length] == x[start : start + length]]
            assert (earlier in known) if earlier >= 0 else not known and length == 1
            if at < len(x):
                assert not any(x[j : j + length + 1] == x[start : start + length + 1] for j in range(start)) or earlier < 0
        assert at == len(x)


def test_special_words():
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 600:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert P.runs(fibonacci[1], 2) == brute(fibonacci[1], 2)
    assert P.runs(["a"] * 20_000) == [(0, 20_000, 1)]
    assert P.runs(["a"] * 11) == P.runs([]) == []
    assert P.runs(list("ab") * 6 + ["x"]) == [(0, 12, 2)]


def test_time_is_linear():
    """The dearest forms: one letter, a long period, two passages many times over."""
    dice = random.Random(5)
    passage = [dice.randrange(4) for _ in range(5000)]
    for x in (["a"] * 100_000, passage * 20, [w for k in range(20) for w in (passage[:2500] if k % 3 else passage[2500:])]):
        assert P.runs(x)


def test_collapsed_keeps_what_no_run_drops():
    for seed in range(100):
        x = pieces(seed)
        found = brute(x, 12)
        kept = [w for i, w in enumerate(x) if not any(low + period <= i < high for low, high, period in found)]
        assert P.collapsed(x, found) == kept


def by_hand(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 12)
    kept = [w for i, w in enumerate(words) if not any(low + q <= i < high for low, high, q in found)]
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], (best[1] - best[0]) * 1000 // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    return doc_id, len(found), *top, sha256(listed.encode()).hexdigest(), sha256(" ".join(kept).encode()).hexdigest()


def test_query_digest(spark):
    rows = [(i, " ".join("abcé"[w % 4] + str(w) for w in pieces(i))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "no break " * 9), (None, "a b " * 9), (4, "a b\tc\nd " * 9), (4, "a b\tc\nd " * 9)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, runs string")
    got = [tuple(r) for r in P.op11(docs).collect()]
    assert sorted(got, key=repr) == sorted((by_hand(i, t) for i, t in rows), key=repr)
    assert P.op11(docs.limit(0)).count() == 0


def test_rows_and_texts(spark):
    docs = spark.createDataFrame([(1, "say it again " * 5 + "done", None), (1, None, "z")], "doc_id long, text string, runs string")
    got = {tuple(r.row): ([tuple(x) for x in r.runs], r.collapsed) for r in P.with_runs(docs).collect()}
    assert got == {(1, None, "z"): ([], ""), (1, "say it again " * 5 + "done", None): ([(0, 15, 3)], "say it again done")}
