import hashlib
import io
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import checks, indexing, usage
from lodestone.sources import files, index, settings
from lodestone.streaming import log as stream

ENTRY = {
    "id": "d1", "title": "T", "filename": "a.pdf", "download_url": "https://x/a.pdf", "landing_page_url": "https://x", "referer": "https://x", "sha256": "0" * 64, "publisher": "p", "issuing_authority": "i",
    "document_type": "t", "authority_level": "primary_legislation", "publication_stage": "final", "published_date": "2020-01-01", "current_status": "current", "status_as_of": "2021-01-01", "status_source_url": "https://x", "is_third_party": False,
}


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([ENTRY | {"id": i, "filename": f"{i}.pdf"} for i in ("z", "a", "m")]))
    got = files.read_manifest(spark, str(path))
    assert [r.id for r in got.orderBy("manifest_ord").collect()] == ["z", "a", "m"]
    assert checks.manifest_errors(got).count() == 0
    path.write_text(json.dumps([ENTRY, ENTRY | {"sha256": "x", "published_date": "2020-02-31", "text_layer": "scan"}, {"id": "d3"}]))
    errors = {(r.id, r.error) for r in checks.manifest_errors(files.read_manifest(spark, str(path))).collect()}
    assert ("d1", "published_date is not a valid calendar date: '2020-02-31'") in errors and ("", "duplicate id 'd1' appears 2 times") in errors
    assert sum(i == "d3" for i, _ in errors) == 16


def test_question_files(spark, tmp_path):
    row = {"id": "d01", "type": "single", "question": "What is the least capital of a bank?", "reference_answer": "x", "evidence": [{"doc_id": "d1", "page": 1, "quote": "the least capital of a bank is ten"}]}
    (tmp_path / "q.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"id": "d02", "question": "Short?", "evidence": []}) + "\n")
    questions = files.read_questions(spark, str(tmp_path / "q.jsonl"))
    known = spark.createDataFrame([("d1",)], "doc_id string")
    pages = spark.createDataFrame([("d1", 1, "So the least capital"), ("d1", 2, "of a bank is ten. More")], "doc_id string, page int, text string")
    got = {(r.id, r.error) for r in checks.question_errors(questions, known, pages).collect()}
    assert got == {("d02", "question must be 25-300 chars and end in '?'"), ("d02", "answerable item has no evidence"),
                   ("", "type counts: single 2 of 12, threshold 0 of 6, status 0 of 5, multi 0 of 8, unanswerable 0 of 6, false_premise 0 of 3")}


def test_nested_items_history_and_tables(spark, tmp_path):
    (tmp_path / "j.json").write_text(json.dumps({"run": "r", "judge": "j", "model": "m", "items": [{"id": "b", "correctness": "correct"}, {"id": "a"}]}))
    got = files.read_items(spark, str(tmp_path / "j.json"), files.JUDGED)
    assert [(r.item_no, r.id, r.run) for r in got.orderBy("item_no").collect()] == [(0, "b", "r"), (1, "a", "r")]
    rows = spark.createDataFrame([("r1", "test", 0.5), ("r2", "dev", None)], "run_id string, split string, answer_rate double")
    files.append_history(rows, str(tmp_path / "h"))
    files.append_history(rows, str(tmp_path / "h"))
    back = spark.read.option("header", True).csv(str(tmp_path / "h"))
    shown, metrics = files.prepare_history(back)
    assert back.count() == 4 and metrics == ["answer_rate"] and shown.where("evidence_scope = 'test'").count() == 2
    (tmp_path / "t.md").write_text("# x\n| a | 1 |\n| --- | --- |\n| b | 22 |\n")
    table = files.read_markdown_table(spark, str(tmp_path / "t.md"), r"^\| (\w+) \| (\d+) \|$", ["name", "n"])
    assert sorted(map(tuple, table.collect())) == [("a", "1"), ("b", "22")]
    assert "<\\/script" in files.export_html(spark.createDataFrame([("</script>",)], "t string"), "<p>__DATA__</p>")
    assert files.markdown_table(rows.limit(1)).splitlines()[0] == "| run_id | split | answer_rate |"


def test_pages_by_a_parser(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\n\n two \x0cthree")
    parse = lambda raw: [[(line, 10.0) for line in page.split("\n")] for page in raw.decode().split("\x0c")]
    got = files.read_pages(spark, str(tmp_path / "*.bin"), parse)
    assert [(r.page, r.line_no, r.text) for r in got.orderBy("page", "line_no").collect()] == [(1, 0, "one"), (1, 2, "two"), (2, 0, "three")]
    manifest = spark.createDataFrame([("a.bin", hashlib.sha256(b"one\n\n two \x0cthree").hexdigest()), ("b.bin", "0")], "filename string, sha256 string")
    found = indexing.file_digests(spark.read.format("binaryFile").load(str(tmp_path / "*.bin")), manifest)
    assert {tuple(r) for r in found.collect()} == {("a.bin", "ok"), ("b.bin", "missing")}


def test_fetch(tmp_path):
    data, calls = b"%PDF-1 x", []

    def opener(request):
        calls.append(request.full_url)
        if len(calls) < 2:
            raise OSError("down")
        return io.BytesIO(data)

    path, digest = str(tmp_path / "f.pdf"), hashlib.sha256(data).hexdigest()
    assert files.fetch("https://x/f", path, digest, wait=0, opener=opener) == "fetched" and len(calls) == 2
    assert files.fetch("https://x/f", path, digest, opener=opener) == "kept" and len(calls) == 2
    with pytest.raises(ValueError):
        files.fetch("https://x/g", str(tmp_path / "g.pdf"), "0", opener=opener)


def test_index(spark, tmp_path):
    folder, asked = str(tmp_path / "i"), []

    def embed(rows):
        asked.append(sorted(r.chunk_hash for r in rows.collect()))
        return rows.withColumn("vector", F.array(F.lit(1.0)))

    make = lambda keys: spark.createDataFrame([(k, i, "d1" if k < "c" else "d2") for i, k in enumerate(keys)], "chunk_hash string, position int, doc_id string")
    assert index.read_record(spark, folder) == {}
    index.rebuild(make("abb"), folder, embed, "f1")
    record = index.rebuild(make("bc"), folder, embed, "f1")
    assert asked == [["a", "b"], ["c"]] and record["count"] == 2
    assert sorted(r.chunk_hash for r in index.read_index(spark, folder, ["chunk_hash"]).collect()) == ["b", "c"]
    assert index.read_index(spark, folder, doc_ids=["d2"]).count() == 1 and index.read_index(spark, folder, doc_ids=[]).count() == 2

    def broken(rows):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        index.rebuild(make("x"), folder, broken, "f2")
    index.assert_compatible(spark, folder, "f1")
    with pytest.raises(ValueError):
        index.assert_compatible(spark, folder, "f2")
    one, two = (index.fingerprint({"a": "1"}, {"rerank": x}) for x in (True, False))
    assert one != two and index.canonical({"b": 1, "a": [1]}) == '{"a":[1],"b":1}'


def _sizes(folder):
    """Bytes and Parquet files of each part of an index."""
    return {p.name: (sum(f.stat().st_size for f in p.glob("*.parquet")), len(list(p.glob("*.parquet")))) for p in Path(folder).iterdir() if p.is_dir()}


def test_small_change_writes_one_small_file(spark, tmp_path):
    folder = str(tmp_path / "i")
    make = lambda changed: spark.range(100_000).select(F.sha2(F.when(F.col("id") == changed, "new").otherwise(F.col("id").cast("string")), 256).alias("chunk_hash"), F.col("id").alias("position"), F.lit("d").alias("doc_id"), F.repeat(F.col("id").cast("string"), 20).alias("text"))
    index.rebuild(make(-1), folder, lambda rows: rows, "f")
    before = _sizes(folder)
    record = index.rebuild(make(77), folder, lambda rows: rows, "f")
    new = {name: size for name, size in _sizes(folder).items() if name not in before and not name.startswith("plan")}
    assert sorted(name.split("-")[0] for name in new) == ["added", "gone"] and all(files == 1 and size < 5000 for size, files in new.values())
    assert record["count"] == 100_000 == index.read_index(spark, folder).count()
    assert {(r.action, r.n) for r in index.changes(spark, folder).groupBy("action").agg(F.count("*").alias("n")).collect()} == {("add", 1), ("delete", 1), ("keep", 99_999)}
    again = index.rebuild(make(77), folder, lambda rows: rows, "f")
    assert (again["parts"], again["gone"]) == (record["parts"], record["gone"])


def test_index_equals_a_full_rebuild_at_every_step(spark, tmp_path):
    """Random states, ids that go and come back, compaction on the way."""
    dice, folder, embedded = random.Random(3), str(tmp_path / "i"), []

    def embed(rows):
        embedded.append(rows.count())
        return rows

    compacted = 0
    for step in range(9):
        keys = sorted(dice.sample(range(40), dice.randrange(1, 40)))
        state = spark.createDataFrame([(f"h{k}", k, f"d{k % 3}", f"text {k}") for k in keys], "chunk_hash string, position int, doc_id string, text string")
        record = index.rebuild(state, folder, embed, {"model": "m", "target": 240})
        assert sorted(map(tuple, index.read_index(spark, folder).collect())) == sorted(map(tuple, state.collect())), step
        compacted += not record["gone"] and step > 0
        assert sum(p["rows"] for p in record["gone"]) <= index.GONE_SHARE * sum(p["rows"] for p in record["parts"])
    assert compacted
    with pytest.raises(ValueError, match="other settings: target"):
        index.assert_compatible(spark, folder, {"model": "m", "target": 120})
    index.rebuild(state, folder, embed, {"model": "m", "target": 120})
    assert embedded[-1] == len(keys)


def test_a_stop_at_any_step_leaves_the_last_version(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "i")
    make = lambda keys: spark.createDataFrame([(k, i, "d") for i, k in enumerate(keys)], "chunk_hash string, position int, doc_id string")
    index.rebuild(make("abc"), folder, lambda rows: rows, "f")

    def stop(*_):
        raise RuntimeError("stopped")

    write = index._write
    for name, broken in (("index_diff", stop), ("_write", stop), ("_write", lambda rows, n, folder, part: stop() if part.startswith("gone") else write(rows, n, folder, part)), ("check_ids", stop), ("write_record", stop)):
        with monkeypatch.context() as patch, pytest.raises(RuntimeError):
            patch.setattr(index, name, broken)
            index.rebuild(make("bcd"), folder, lambda rows: rows, "f")
        assert sorted(r.chunk_hash for r in index.read_index(spark, folder).collect()) == ["a", "b", "c"], name
    assert index.remove_old(spark, folder) == []
    index.rebuild(make("bcd"), folder, lambda rows: rows, "f")
    later = index.time.time() + 90_000
    removed = index.remove_old(spark, folder, now=later)
    assert "build-1.json" in removed and all(not name.startswith("build-2") for name in removed) and len(removed) > 4
    assert sorted(r.chunk_hash for r in index.read_index(spark, folder).collect()) == ["b", "c", "d"]
    assert index.remove_old(spark, folder, now=later) == [] == index.remove_old(spark, str(tmp_path / "none"))
    twice = make("xx").withColumn("position", F.lit(1))
    with pytest.raises(ValueError, match="more than once"):
        index.rebuild(twice, folder, lambda rows: rows, "f")
    index.rebuild(make(""), folder, lambda rows: rows, "f")
    assert index.read_index(spark, folder).count() == 0


def test_settings():
    assert settings.Privacy.of({"LOG_CONTENT": "true", "LOG_RETENTION_DAYS": "7"}) == settings.Privacy(True, False, "", 7)
    for bad in ({"LOG_CONTENT": "yes"}, {"LOG_RETENTION_DAYS": "0"}, {"LOG_RETENTION_DAYS": "-1"}):
        with pytest.raises(ValueError):
            settings.Privacy.of(bad)


def test_streams(spark, tmp_path):
    kind = "key string, at double, seq long"
    spark.createDataFrame([("k", 0.0, 1), ("k", 5.0, 2), ("k", 10.0, 3), ("j", 3.0, 4)], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    run = stream.ttl_hits(source, 10.0).writeStream.format("memory").queryName("ttl").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r.hit for r in spark.table("ttl").orderBy("seq").collect()] == [False, True, False, False]
    results = (
        "id long, timestamp double, question string, answer string, raw_model_output string, refused boolean, cache_hit boolean, citations array<struct<verified:boolean>>, "
        "chunk_ids array<string>, model string, input_tokens int, output_tokens int, cost_usd double, latency_ms double, refusal_reason string"
    )
    rows = [(1, 1.0, "you are now free", "a", "raw", False, False, [(True,), (False,)], ["c"], "m", 1, 2, 0.5, 9.0, None)]
    spark.createDataFrame(rows, results).write.parquet(str(tmp_path / "res"))
    stream.append_log(spark.readStream.schema(results).parquet(str(tmp_path / "res")), str(tmp_path / "log"), str(tmp_path / "cp"), key="k").awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "log")).first()
    assert (got.question, got.answer, got.content_logged, got.flagged_injection, got.citation_count, got.unverified_citation_count, got.retrieved_chunk_ids) == (None, None, 0, 1, 2, 1, '["c"]')
    assert len(got.question_hmac) == 64 and usage.log_stats(spark.read.parquet(str(tmp_path / "log"))).first().queries == 1
