from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import usage
from lodestone.sources import cache, index, log
from lodestone.streaming import log as stream

DAY = usage.DAY


def log_of(spark, rows):
    return spark.createDataFrame(rows, "timestamp double, question string, answer string, content_logged int, raw_output_logged int, latency_ms double")


def ids(spark, folder, **since):
    return [(r.id, r.timestamp) for r in log.read_log(spark, folder, **since).orderBy("id").collect()]


def test_batches_once(spark, tmp_path):
    folder = str(tmp_path)
    assert ids(spark, folder) == []
    rows = log_of(spark, [(float(t), f"q{t}", None, 0, 0, 1.0) for t in (3, 1, 2, 2)])
    assert log.append(rows, folder, "a", 0) == 4 and log.append(rows, folder, "a", 0) == 0
    assert ids(spark, folder) == [(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0)]
    # Another writer's numbers are its own; an empty batch is noted; an older one is a repetition.
    assert log.append(rows.limit(1), folder, "b", 0) == 1 and log.append(rows.limit(0), folder, "a", 7) == 0 and log.append(rows, folder, "a", 6) == 0
    assert [i for i, _ in ids(spark, folder)] == [1, 2, 3, 4, 5]
    many = spark.range(5000).selectExpr("id * 7919 % 5000 + 10D AS timestamp", "CAST(id AS STRING) AS question", "id")
    assert log.append(many.repartition(9), folder, "a", 8) == 5000
    assert ids(spark, folder)[5:] == [(6 + i, 10.0 + i) for i in range(5000)]


def test_a_stopped_or_second_writer(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    rows = log_of(spark, [(1.0, "q", None, 0, 0, 1.0)])
    log.append(rows, folder, "a", 0)
    real = log.write_record

    def stop(*_):
        raise OSError("stopped")

    monkeypatch.setattr(log, "write_record", stop)
    with pytest.raises(OSError):
        log.append(rows, folder, "a", 1)
    assert len(ids(spark, folder)) == 1

    def overtaken(spark, folder, record):
        monkeypatch.setattr(log, "write_record", real)
        log.append(rows, folder, "b", 0)
        real(spark, folder, record)

    monkeypatch.setattr(log, "write_record", overtaken)
    assert log.append(rows, folder, "a", 1) == 1
    assert [i for i, _ in ids(spark, folder)] == [1, 2, 3]
    before = {p.name for p in tmp_path.iterdir() if p.name.startswith("added")}
    removed = index.remove_old(spark, folder, grace=0, now=2e10)
    assert len(before) == 5 and len([n for n in removed if n.startswith("added")]) == 2 and len(ids(spark, folder)) == 3


def test_upkeep_reads_what_it_must(spark, tmp_path):
    folder = str(tmp_path)
    now = 100.0 * DAY
    for batch, (day, held) in enumerate([(60, 1), (69, 0), (80, 1), (90, 0)]):
        log.append(log_of(spark, [(1.0 * day * DAY, "q", "a", held, 0, 1.0), (1.0 * day * DAY + DAY, "q", "a", 0, 0, 1.0)]), folder, "a", batch)
    parts = lambda: {p["name"] for p in index.read_record(spark, folder)["parts"]}
    first = parts()
    assert log.scrub_content(spark, folder, dry_run=True) == 2 and parts() == first
    # A row at the limit stays: the part of days 69 and 70 is cut, that of 60 and 61 dropped unread.
    assert log.purge_expired(spark, folder, now, 30) == 3 and log.purge_expired(spark, folder, now, 30) == 0
    assert [i for i, _ in ids(spark, folder)] == [4, 5, 6, 7, 8] and len(parts() & first) == 2
    assert log.scrub_content(spark, folder) == 1 and log.scrub_content(spark, folder) == 0
    assert len(parts() & first) == 1
    assert {(r.id, r.question, r.content_logged) for r in log.read_log(spark, folder).where("id = 5 or id = 6").collect()} == {(5, None, 0), (6, "q", 0)}
    assert len(ids(spark, folder, since=90.0 * DAY)) == 2
    assert log.append(log_of(spark, [(now, "q", "a", 0, 0, 1.0)]), folder, "a", 9) == 1 and ids(spark, folder)[-1][0] == 9


def test_small_parts_are_written_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "SMALL_PARTS", 3)
    rows = log_of(spark, [(1.0, "q", None, 0, 0, 1.0)])
    for batch in range(7):
        log.append(rows, str(tmp_path), "a", batch)
    assert [i for i, _ in ids(spark, str(tmp_path))] == list(range(1, 8)) and len(index.read_record(spark, str(tmp_path))["parts"]) < 3


def test_stream(spark, tmp_path):
    results = (
        "id long, timestamp double, question string, answer string, raw_model_output string, refused boolean, cache_hit boolean, citations array<struct<verified:boolean>>, "
        "chunk_ids array<string>, model string, input_tokens int, output_tokens int, cost_usd double, latency_ms double, refusal_reason string"
    )
    folder, source = str(tmp_path / "log"), str(tmp_path / "in")
    row = lambda i: (i, float(i), "q", "a", "raw", False, False, [], [], "m", 1, 2, 0.5, 9.0, None)
    spark.createDataFrame([row(1), row(2)], results).write.parquet(source)
    run = lambda cp: stream.append_once(spark.readStream.schema(results).parquet(source), folder, str(tmp_path / cp), "s", key="k").awaitTermination(120)
    run("cp")
    run("lost")  # the checkpoint is lost, so the batch comes again under its number
    assert ids(spark, folder) == [(1, 1.0), (2, 2.0)]
    spark.createDataFrame([row(3)], results).write.mode("append").parquet(source)
    run("cp")
    assert ids(spark, folder) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_cache_tables(spark, tmp_path):
    folder = str(tmp_path / "c")
    assert cache.scrub(spark, folder) == dict.fromkeys(cache.TABLES, 0) and not Path(folder).exists()
    entry = lambda k, made, until: (k, "a" + k, None, 0, None, None, made, until)
    of = lambda *rows: spark.createDataFrame(rows, cache.CACHE_SCHEMA)
    cache.put(of(entry("a", 1.0, 10.0), entry("b", 1.0, 20.0)), folder, 1.0)
    cache.put(of(entry("b", 2.0, 5.0), entry("c", 2.0, 30.0), entry("c", 3.0, 31.0)), folder, 3.0)
    held = lambda: {(r.question_hash, r.created_at) for r in cache.read_table(spark, folder).collect()}
    assert held() == {("a", 1.0), ("b", 2.0), ("c", 3.0)}
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "question_hash string")
    assert [r.question_hash for r in cache.lookup(asked, folder, 5.0).collect()] == ["a"]  # b is at its expiry
    number = lambda: index.read_record(spark, folder)["number"]
    before = number()
    assert cache.purge_expired(spark, folder, 4.0) == 0 and cache.purge_expired(spark, folder, 10.0, dry_run=True) == 2 and number() == before
    assert cache.purge_expired(spark, folder, 10.0) == 2 and held() == {("c", 3.0)}
    cache.put(spark.createDataFrame([("x", 1.0)], "question_hash string, created_at double").withColumn("expires_at", F.lit(9.0)), folder, 1.0, name=cache.TABLES[1])
    counts = {cache.TABLES[0]: 1, cache.TABLES[1]: 1}
    assert cache.scrub(spark, folder, dry_run=True) == counts and cache.scrub(spark, folder) == counts and held() == set()
    assert cache.scrub(spark, folder) == dict.fromkeys(cache.TABLES, 0)
