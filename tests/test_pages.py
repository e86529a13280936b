import json
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.sources import files, pages


def corpus(tmp_path, n=6):
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(n):
        (folder / f"f{i}.bin").write_text("\x0c".join(f"doc {i} page {p}" for p in (1, 2, 3)))
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps([{"id": f"d{i}", "filename": f"f{i}.bin", "text_layer": "ocr" if i == 2 else None} for i in reversed(range(n))]))
    opened = tmp_path / "opened"

    def parse(raw):
        with open(opened, "a") as log:
            log.write("x")
        return raw.decode().split("\x0c")

    return str(folder), str(manifest), parse, lambda: len(opened.read_text()) if opened.exists() else 0


def test_a_lookup_opens_one_file(spark, tmp_path):
    folder, manifest, parse, opened = corpus(tmp_path)
    read = lambda **own: pages.read_pages(spark, folder, manifest, parse, docs_per_task=2, **own)
    assert [r.text for r in read(doc_ids=["d4"], numbers=[2]).collect()] == ["doc 4 page 2"] and opened() == 1
    assert read(doc_ids=["d0", "d1"], numbers=[1, 3]).where("text LIKE '%3'").count() == 2 and opened() == 3
    assert read(doc_ids=[]).count() == 0 and read(doc_ids=["none"]).count() == 0 and opened() == 3
    every = read()
    assert [r.text for r in files.page_text(every, "d4", 2).collect()] == ["doc 4 page 2"] and opened() == 8
    rows = every.orderBy("manifest_ord", "page").collect()
    assert [(r.doc_id, r.page) for r in rows] == [(f"d{i}", p) for i in (5, 4, 3, 1, 0) for p in (1, 2, 3)]


def test_recognition_reads_through_its_cache(spark, tmp_path):
    cache, asked = str(tmp_path / "cache"), tmp_path / "asked"

    def recognise(doc_id, page):
        with open(asked, "a") as log:
            log.write(f"{doc_id}/{page}\n")
        if doc_id == "bad":
            raise ValueError("no such page")
        return f"text of {doc_id} {page}"

    wanted = spark.createDataFrame([("d2", 1), ("d2", 2), ("d2", 2), (None, 1)], "doc_id string, page int")
    for _ in range(2):
        got = pages.recognised(wanted, cache, recognise)
        assert sorted(map(tuple, got.collect())) == [("d2", 1, "text of d2 1"), ("d2", 2, "text of d2 2")]
    assert sorted(asked.read_text().split()) == ["d2/1", "d2/2"]
    with pytest.raises(Exception, match="no such page"):
        pages.recognised(wanted.union(spark.createDataFrame([("bad", 1), ("d3", 1)], wanted.schema)), cache, recognise)
    assert pages.read_cache(spark, cache).count() == 2
    folder, manifest, parse, _ = corpus(tmp_path)
    every = pages.all_pages(pages.read_pages(spark, folder, manifest, parse), files.read_manifest(spark, manifest), pages.read_cache(spark, cache))
    assert [(r.doc_id, r.text) for r in every.where("doc_id = 'd2'").orderBy("page").collect()] == [("d2", "text of d2 1"), ("d2", "text of d2 2")] and every.count() == 17


PAGES = [
    (0, "b", 1, "Some (c) text\nof the   \n OF it. The of"), (0, "b", 2, "theof a.b*c"), (1, "a", 1, None), (1, "a", 2, ""), (2, "c", 1, "\U0001f600" * 100 + " tHe　oF " + "x" * 100),
    (2, "c", 1, "the of"), (9, "d", 7, "FÜR A.B*C axb*c (C)"), (None, "e", 1, "the of"),
]


def brute(phrase, most):
    pattern = re.compile(re.escape(phrase).replace(r"\ ", r"\s+"), re.IGNORECASE)
    found = []
    for order, doc, page, text in PAGES:
        if order is not None and text is not None and (m := pattern.search(text)):
            found.append((order, page, " ".join(text[max(0, m.start() - 80) : m.end() + 80].split()), doc))
    return sorted(found)[:most]


def test_phrases(spark, monkeypatch):
    monkeypatch.setattr(search, "FIRST_RANGE", 1)
    monkeypatch.setattr(search, "GROWTH", 2)
    table = spark.createDataFrame(PAGES, "manifest_ord long, doc_id string, page int, text string").withColumn("phrase_id", F.lit(1))
    phrases = ["the of", "(c)", "a.b*c", "für", "[", "", "nowhere", "ür a"]
    for most in (1, 2, 30):
        got = search.first_hits(table, phrases, most)
        for phrase in phrases:
            rows = got.where(F.col("phrase") == phrase).collect()
            assert sorted((r.manifest_ord, r.page, r.snippet, r.doc_id) for r in rows) == brute(phrase, most), (phrase, most)
    assert {r.doc_id for r in search.first_hits(table, ["the of"], doc_ids=["c"]).collect()} == {"c"}
    assert search.first_hits(table.limit(0), ["x"]).count() == 0


def test_a_full_report_reads_no_further(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "FIRST_RANGE", 10)
    read = spark.sparkContext.accumulator(0)
    table = spark.range(1000).selectExpr("id AS manifest_ord", "concat('d', id) AS doc_id", "1 AS page", "concat('some word ', id) AS text")
    stored = pages.write_pages(table, str(tmp_path / "pages"))

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    got = search.first_hits(stored.withColumn("text", counted("text")), ["some WORD"], 5)
    assert [r.manifest_ord for r in got.orderBy("manifest_ord").collect()] == [0, 1, 2, 3, 4] and read.value < 100
