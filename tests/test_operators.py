import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import stats, text
from lodestone.operators import checks, chunking, citations, evaluation, indexing, ingest, retrieval, usage

REFUSAL = "I don't have a source for that."


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


def test_boilerplate(spark):
    lines = [("d", p, 0, "Footer") for p in range(1, 9)] + [("d", 1, n, "same page") for n in (1, 2, 3)] + [("d", p, 5, f"own {p}") for p in range(1, 9)]
    frame = spark.createDataFrame(lines, "doc_id string, page int, line_no int, text string")
    pages = spark.createDataFrame([("d", 8)], "doc_id string, n long")
    found = ingest.boilerplate_lines(frame, "doc_id", "page", pages)
    assert rows(found, "text") == [("d", "Footer", 8)]
    assert ingest.strip_boilerplate(frame, found, "doc_id").count() == 11


def test_elements(spark):
    lines = [("d", 1, 0, "1. Scope", 10.0), ("d", 1, 1, "hy-", 10.0), ("d", 1, 2, "brid debt", 10.0), ("d", 2, 3, "08 July 2020", 10.0), ("d", 2, 4, "Large", 14.0), ("d", 3, 5, "Part .... 4", 10.0)]
    frame = spark.createDataFrame(lines, "doc_id string, page int, line_no int, text string, size double")
    got = ingest.elements(frame, spark.createDataFrame([("d", 3)], "doc_id string, n long"))
    assert rows(got, "elem_no") == [("d", 1, "heading", "1. Scope", 1), ("d", 2, "paragraph", "hybrid debt", 1), ("d", 3, "paragraph", "08 July 2020", 2), ("d", 4, "heading", "Large", 2)]


def test_ocr(spark):
    pages = spark.createDataFrame([("d", 1, "4.1 Scope\n \none-\ntwo\nthree\n\n\n")], "doc_id string, page int, text string")
    assert rows(ingest.ocr_elements(pages), "elem_no") == [("d", 1, "heading", "4.1 Scope", 1), ("d", 2, "paragraph", "onetwo three", 1)]


def words(n, prefix="w"):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_packer():
    pack = chunking.Packer(target=50, overlap=5).pack
    assert pack([]) == []
    got = pack([("heading", "1. A", 1), ("paragraph", words(30), 1), ("paragraph", words(30, "x"), 2)])
    # The first part is below the least size but there is none before it; the second merges into it.
    assert [(c["page_start"], c["page_end"], c["section"]) for c in got] == [(1, 2, "1. A")]
    got = pack([("paragraph", words(45), 1), ("paragraph", words(45, "x"), 2), ("heading", "2. B", 3), ("paragraph", words(45, "y"), 3)])
    assert [c["text"].split()[-1] for c in got] == ["w44", "x44", "y44"]
    assert got[1]["text"].startswith("w40 w41 w42 w43 w44 x0") and got[1]["page_start"] == 1
    assert [c["index"] for c in got] == [0, 1, 2]
    long = pack([("paragraph", words(120), 4)])
    assert [len(c["text"].split()) for c in long[:2]] == [50, 50] and long[0]["text"].split()[-5:] == long[1]["text"].split()[:5]
    twice = pack([("paragraph", words(60), 1), ("paragraph", words(60, "z"), 2)])
    assert len({c["text"] for c in twice}) == len(twice)
    with pytest.raises(ValueError):
        chunking.Packer(target=5, overlap=5)
    with pytest.raises(ValueError):
        chunking.Packer(target=0)


def test_cosine_takes_questions_in_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([("a", [0.0, 5.0]), ("b", [3.0, 0.0])], "chunk_id string, vector array<double>")
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "question_id long, vector array<double>")
    whole = rows(retrieval.cosine_scores(asked, chunks), "question_id", "chunk_id")
    monkeypatch.setattr(retrieval, "MOST_QUESTIONS", 2)
    assert rows(retrieval.cosine_scores(asked, chunks), "question_id", "chunk_id") == whole and len(whole) == 10
    assert retrieval.cosine_scores(asked.limit(0), chunks).count() == 0


def test_cosine(spark):
    chunks = spark.createDataFrame([("a", [0.0, 5.0]), ("b", [3.0, 0.0]), ("c", [-1.0, 0.0]), ("z", [0.0, 0.0])], "chunk_id string, vector array<double>")
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "question_id int, vector array<double>")
    got = retrieval.top(retrieval.cosine_scores(questions, chunks), 4)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == ["b", "a", "c", "z"]
    assert got.where("chunk_id = 'z'").first().score is None


def test_bm25_finds_identifiers(spark):
    chunks = spark.createDataFrame([("c1", "Directive 8/2025 on capital"), ("c2", "Directive 3/2020 on liquidity"), ("c3", "other words"), ("c4", "more of it")], "chunk_id string, text string")
    questions = spark.createDataFrame([(1, "What does Directive 8/2025 say?")], "question_id int, question string")
    got = retrieval.top(retrieval.bm25_scores(questions, chunks), 5).orderBy("rank").collect()
    assert got[0].chunk_id == "c1" and {r.chunk_id for r in got} <= {"c1", "c2"}


def test_fusion(spark):
    kind = "question_id int, chunk_id string, rank int"
    lists = [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], kind) for ids in ("xyz", "y")]
    assert [r.chunk_id for r in retrieval.fuse(lists, 3).orderBy("rank").collect()] == ["y", "x", "z"]


def test_names(spark):
    manifest = [{"id": "d1", "title": "Directive 3/2020: Liquidity"}, {"id": "d2", "title": "Directive 3/2021: Liquidity"}, {"id": "i9", "title": "IFRS 9 (2014): Issued text"}]
    names = retrieval.alias_table(spark.createDataFrame([(e["id"], e.get("title"), i) for i, e in enumerate(manifest)], "id string, title string, manifest_ord int"))
    questions = spark.createDataFrame([(1, "What does directive 3/2021 need?"), (2, "and 3/2020?"), (3, "the IFRS 9 issued text and D3/2020"), (4, "")], "question_id int, question string")
    assert rows(retrieval.resolve_names(questions, names).select("question_id", "doc_id"), "question_id", "doc_id") == [(1, "d2"), (3, "d1"), (3, "i9")]


def test_named_balanced(spark):
    kind = "question_id int, chunk_id string, doc_id string, score double"
    pool = spark.createDataFrame([(1, "a1", "a", 0.9), (1, "a2", "a", 0.8), (1, "a3", "a", 0.7)], kind)
    named = spark.createDataFrame([(1, "a1", "a", 0.9), (1, "b1", "b", 0.1)], kind)
    resolved = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "c", 2)], "question_id int, doc_id string, manifest_ord int")
    got = retrieval.named_balanced(pool, named, resolved, 3)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == ["b1", "a1", "a2"]
    cover = retrieval.coverage(got, resolved, pool.unionByName(named)).first()
    assert (cover.requested, cover.resolved, cover.represented, cover.incomplete) == (["b", "a", "c"], ["b", "a"], ["b", "a"], True)


CONTEXTS = [(0, "c1", "a", 3, 4, "81. Powers"), (0, "c0", "a", 4, 5, None), (0, "c2", "b", 1, 1, None)]


@pytest.mark.parametrize("answer,reason", [
    (REFUSAL, "model_refusal"), (f"  {REFUSAL}\n", "model_refusal"), (f"Sorry. {REFUSAL.upper()}", "malformed_refusal"), ("No citation.", "missing_citation"), ("Fact (a, p. 3)", "malformed_citation"),
    ("Fact [a, p.3]\nand more", "uncited_line"), ("Fact [a, p.9]\nand more", "uncited_line"), ("Fact [a, p.9]", "unverified_citation"), ("Fact [a, p.3-5]\n\nB [b, p.1, 2.1] [a, p.4] ", None), ("Fact [a, p.5-3]", "malformed_citation"), ("see (d3 page 4)", "missing_citation"),
])
def test_validator(spark, answer, reason):
    answers = spark.createDataFrame([(0, answer)], "answer_id int, answer string")
    contexts = spark.createDataFrame(CONTEXTS, "answer_id int, chunk_id string, doc_id string, page_start int, page_end int, section string")
    got = citations.validate(answers, contexts).first()
    assert got.refusal_reason == reason and got.refused == (reason is not None) and got.served == (REFUSAL if reason else answer.strip())


def test_coverage_is_a_union_and_first_section_wins(spark):
    answers = spark.createDataFrame([(0, "x [a, p.3] y [a, p.4] z [a, p.5] w [a, p.9] [b, p.1-2]")], "answer_id int, answer string")
    contexts = spark.createDataFrame(CONTEXTS, "answer_id int, chunk_id string, doc_id string, page_start int, page_end int, section string")
    manifest = spark.createDataFrame([("a", "primary_legislation")], "id string, authority_level string")
    got = citations.with_reference(citations.verify(citations.extract(answers), contexts), manifest)
    assert rows(got.select("cite_no", "page", "verified", "section_ref"), "cite_no") == [(1, 3, True, "s 81"), (2, 4, True, "s 81"), (3, 5, True, None), (4, 9, False, None), (5, 1, True, None), (6, 2, False, None)]
    counts = evaluation.raw_citation_counts(answers, contexts).first()
    assert (counts.ok, counts.total) == (4, 6)


def test_statistics(spark):
    frame = spark.createDataFrame([(0, 0), (5, 10), (10, 10), (48, 60)], "k int, n int")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = frame.select(low.alias("a"), high.alias("b"), stats.ratio(F.col("k"), F.col("n")).alias("r")).collect()
    assert got[0].r.rate is None and got[0].r.lo is None
    assert (round(got[1].a, 3), round(got[1].b, 3)) == (0.237, 0.763) and got[2].b == 1.0 and (round(got[3].a, 2), round(got[3].b, 2)) == (0.68, 0.88)
    pairs = lambda text: spark.createDataFrame([(a, b) for a, b in text], "a string, b string")
    of = lambda text: stats.kappa(pairs(text), "a", "b").first().kappa
    assert of([("y", "y"), ("y", "n"), ("n", "n"), ("n", "n")]) == pytest.approx(0.5)
    assert of([]) == 0.0 and of([("y", "y")] * 3) == 1.0
    p = spark.createDataFrame([(0, 0), (5, 0), (3, 3), (9, 1)], "w int, x int").select(stats.sign_test(F.col("w"), F.col("x")).alias("p")).collect()
    assert [round(r.p, 6) for r in p] == [1.0, 0.0625, 1.0, 0.021484]
    values = spark.createDataFrame([("k", v) for v in (1, 2, 3, 4)], "k string, v int")
    assert stats.upper_median(values, ["k"], "v", "m").first().m == 3
    assert rows(stats.nearest_rank(values, ["k"], "v", {"p50": 0.5, "p95": 0.95}), "k") == [("k", 3, 4)]
    assert rows(stats.histogram(values, "v", 3), "bin") == [(0, 1), (1, 1), (2, 2)]


def test_log(spark):
    log = spark.createDataFrame([], usage.LOG_SCHEMA)
    assert tuple(usage.log_stats(log).first()) == (0, 0.0, 0.0, 0.0)
    old = spark.createDataFrame([(1, 10.0, "q", 1), (2, 20.0, None, 0)], "id long, timestamp double, question string, refused int")
    new = usage.migrate(old)
    assert new.columns == log.columns and usage.log_stats(new).first().refusal_rate == 0.5
    assert [r.id for r in usage.retain(new, 20.0 + 86400, 1).collect()] == [2]
    held = new.withColumn("content_logged", F.when(F.col("id") == 1, 1).otherwise(0))
    n, after = usage.purge(held)
    assert n == 1 and after.where("question is not null").count() == 0 and usage.purge(held, True)[1].where("question is not null").count() == 1


def test_cache(spark):
    cache = spark.createDataFrame([("a", 1.0, 10.0), ("b", 1.0, 11.0)], "question_hash string, created_at double, expires_at double")
    assert [r.question_hash for r in usage.live(cache, 10.0).collect()] == ["b"]
    more = spark.createDataFrame([("a", 2.0, 20.0)], cache.schema)
    assert rows(usage.upsert(cache, more), "question_hash") == [("a", 2.0, 20.0), ("b", 1.0, 11.0)]
    requests = spark.createDataFrame([("k", 0.0, 1), ("k", 5.0, 2), ("k", 10.0, 3), ("k", 19.0, 4), ("j", 3.0, 5)], "key string, at double, seq long")
    assert [r.hit for r in usage.ttl_hits(requests, 10.0).orderBy("seq").collect()] == [False, True, False, True, False]


def test_metrics(spark):
    evidence = spark.createDataFrame([(1, "a", 3), (1, "b", 9), (2, "a", 9)], "item_id int, doc_id string, page int")
    contexts = spark.createDataFrame([(1, "a", 2, 3), (2, "a", 1, 2)], "item_id int, doc_id string, page_start int, page_end int")
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    assert rows(evaluation.evidence_hits(evidence, contexts, items), "item_id") == [(1, True, False), (2, False, False), (3, False, False)]
    budget = evaluation.budget_prefix(spark.createDataFrame([("k", i, 4.0) for i in range(5)], "k string, i int, c double"), ["k"], "i", "c", 8.0)
    assert [r.i for r in budget.orderBy("i").collect()] == [0, 1, 2]
    assert rows(indexing.index_diff(spark.createDataFrame([("a",), ("b",)], "chunk_hash string"), spark.createDataFrame([("b",), ("c",)], "chunk_hash string")), "chunk_hash") == [("a", "add"), ("b", "keep"), ("c", "delete")]


def test_quotes_over_a_page_end(spark):
    pages = spark.createDataFrame([("d", 1, "one two"), ("d", 2, "three four"), ("d", 4, "five")], "doc_id string, page int, text string")
    quotes = spark.createDataFrame([(1, "d", 1, "Two THREE"), (2, "d", 2, "four five"), (3, "d", 3, "five"), (4, "d", 4, "five")], "quote_id int, doc_id string, page int, quote string")
    assert rows(checks.quote_hits(quotes, pages).select("quote_id", "found"), "quote_id") == [(1, True), (2, False), (3, False), (4, True)]


def test_sign_test_of_any_size(spark):
    pairs = [(0, 0), (3, 0), (5, 5), (1834, 37), (12_000, 11_800), (2_000_000, 1_999_000), (10**9, 10**9 - 10)]
    got = spark.createDataFrame(pairs, "w long, l long").select(stats.sign_test(F.col("w"), F.col("l")).alias("p")).collect()
    for (w, x), r in zip(pairs, got, strict=True):
        n = w + x
        if n < 30_000:
            want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(w, x) + 1)) / 2**n) if n else 1.0
            assert abs(r.p - want) < 1e-9
        else:
            assert abs(r.p - math.erfc(abs(abs(w - x) - 1) / math.sqrt(n) / math.sqrt(2))) < 1e-4


def test_quotes_of_compatibility_characters(spark):
    texts = ["Ｆｕｌｌ ｗｉｄｔｈ ５%", "ﬁne oﬀer", "x²", "K", "E\u0301t\u00e9", "soft-\n hyphen", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.normal_quote(F.col("t")).alias("n")).orderBy("i").collect()
    want = [t and re.sub(r"[^a-z0-9%]+", " ", re.sub(r"-\s*\n\s*", "", unicodedata.normalize("NFKC", t).lower())).strip() for t in texts]
    assert [r.n for r in got] == want


def test_ranges_of_pages(spark):
    answers = spark.createDataFrame([(1, "A [d1, p.1-4]."), (2, "A [d1, p.2-3]"), (3, "A [d1, p.1-999999999]"), (4, "A [d1, p.1-5]")], "answer_id int, answer string")
    contexts = spark.createDataFrame([(i, "c1", "d1", 1, 2, None) for i in (1, 2, 3, 4)] + [(i, "c2", "d1", 2, 4, None) for i in (1, 2, 3)] + [(4, "c3", "d1", 4, 5, None)], "answer_id int, chunk_id string, doc_id string, page_start int, page_end int, section string")
    got = {r.answer_id: r.refusal_reason for r in citations.validate(answers, contexts).collect()}
    assert got == {1: "uncited_line", 2: None, 3: "unverified_citation", 4: "unverified_citation"}
    wide = spark.createDataFrame([(1, "A [d1, p.5-25004]")], "answer_id int, answer string")
    found = citations.extract(wide)
    assert found.count() == 25_000 and found.agg(F.min("page"), F.max("page"), F.max("cite_no")).first() == (5, 25_004, 25_000)


def test_places(spark):
    import random

    rng = random.Random(4)
    values = [("a", rng.choice([rng.random(), 0.5, 0.25])) for _ in range(3000)] + [("b", 1.0)] + [("c", float(i)) for i in (3, 1, 2, 2)] + [("a", None), ("d", None)]
    frame = spark.createDataFrame(values, "k string, v double")
    got = {r.k: r for r in stats.nearest_rank(frame, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    middle = {r.k: r.m for r in stats.upper_median(frame, ["k"], "v", "m").collect()}
    assert set(got) == set(middle) == {"a", "b", "c"}
    for k in got:
        own = sorted(v for q, v in values if q == k and v is not None)
        assert [got[k][f"p{p}"] for p in (0, 50, 95, 100)] == [own[min(len(own) - 1, len(own) * p // 100)] for p in (0, 50, 95, 100)]
        assert middle[k] == own[len(own) // 2]
    assert {r.k: r.m for r in stats.upper_median(frame, ["k"], "v", "m", 9.0).collect()}["d"] == 9.0


def test_small_readers(spark, tmp_path):
    from lodestone.sources import files

    items = spark.createDataFrame([(2, "single"), (1, "single"), (3, "multi")], "id int, type string")
    assert [r.id for r in evaluation.first_items(items, 1, "id", "single").collect()] == [1]
    assert [r.id for r in evaluation.first_items(items, 2, "id").collect()] == [1, 2]
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, "two"), ("e", 1, "three")], "doc_id string, page int, text string")
    assert [r.text for r in files.page_text(pages, "d", 2).collect()] == ["two"] and files.page_text(pages, "e", 9).count() == 0
    assert rows(files.uncached_pages(pages, pages.where("doc_id = 'd'").select("doc_id", "page")), "doc_id") == [("e", 1)]
    files.write_items(items, str(tmp_path / "items"))
    assert spark.read.json(str(tmp_path / "items")).count() == 3
    labels = spark.createDataFrame([(1, " good "), (2, "refused"), (3, None), (4, ""), (5, "unparsed")], "id int, label string")
    assert rows(evaluation.clean_labels(labels, "label"), "id") == [(1, "good")]


def test_aliases(spark):
    titles = {
        "a": "Guidance  note 4 of 2019 (draft): Over-the-counter trades 2018",
        "b": "IFRS 9 (2014): issued text",
        "c": None,
        "d": "Circular D7/2020 and guideline 12/2021: notes",
    }
    table = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(titles.items())], "id string, title string, manifest_ord int")
    got = {i: {r.alias for r in retrieval.alias_table(table).where(F.col("doc_id") == i).collect()} for i in titles}
    assert got["a"] == {
        "a", "guidance note 4 of 2019 draft over the counter trades 2018", "guidance note 4 of 2019 draft", "guidance note 4 of 2019 over the counter trades 2018",
        "guidance note 4 of over the counter trades", "over the counter trades 2018", "over the counter trades", "guidance note 4 of otc trades", "guidance note 4 2019", "g4 2019",
    }
    assert {"b", "2014 issued ifrs 9 text", "ifrs 9 2014", "ifrs 9 issued text", "issued text"} <= got["b"] and got["c"] == {"c"}
    assert {"circular 7 2020", "circular d7 2020", "d7 2020", "guideline 12 2021", "g12 2021"} <= got["d"]
    # A name of two entries is nobody's.
    both = table.unionByName(spark.createDataFrame([("e", "Other: issued text", 9)], table.schema))
    assert retrieval.alias_table(both).where("alias = 'issued text'").count() == 0


def test_budget_prefix_of_one_hot_key_runs_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "ROWS_A_RANGE", 50)
    items = spark.range(1000).select(F.lit("hot").alias("key"), F.col("id").alias("n"), (F.col("id") % 7).alias("cost")).unionByName(spark.createDataFrame([(None, 1, 5), (None, 2, 5), ("small", 1, 9000), ("small", 2, 1)], "key string, n long, cost long")).repartition(5)
    for cap in (0, 400, 1500, 10_000):
        want = set()
        for key, rows_ in (("hot", [(i, i % 7) for i in range(1000)]), (None, [(1, 5), (2, 5)]), ("small", [(1, 9000), (2, 1)])):
            total = 0
            for n, cost in rows_:
                if total > cap:
                    break
                total += cost
                want.add((key, n, cost, total))
        assert {tuple(r) for r in evaluation.budget_prefix(items, ["key"], "n", "cost", cap).collect()} == want, cap
    assert evaluation.budget_prefix(items.limit(0), ["key"], "n", "cost", 5).count() == 0
