import hashlib
import math
import zlib

import numpy as np
import pytest

from lodestone.llm import media
from lodestone.llm.common import documents, open_random, run_folder


def check(spark, docs):
    texts = {}
    for d in docs.collect():
        texts.setdefault(d.doc_id, []).append(d.text or "")
    rows = media.op10(spark, docs).collect()
    assert len(rows) == sum(map(len, texts.values()))
    seen = {}
    for r in rows:
        options = []
        for t in texts[r.doc_id]:
            raw = t.encode()
            size = max(1, -(-len(raw) // 576)) * 576
            payload = raw.ljust(size, b"\xff")
            options.append((len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in options
        values = (r.media_bytes, r.media_sha256, r.feature)
        assert seen.setdefault(r.payload_sha256, values) == values


def test_round_trip(spark, sf_dir):
    check(spark, documents(spark, sf_dir))
    rows = [(1, None), (2, ""), (3, "a" * 576), (4, "a" * 577), (5, "é" * 100_000), (5, "é" * 100_000), (None, "x"), (6, "\x00\xff")]
    check(spark, spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, feature string"))
    assert media.op10(spark, documents(spark, sf_dir).limit(0)).count() == 0


def test_ranges_cover_each_member_once(spark, sf_dir):
    docs = documents(spark, sf_dir)
    folder = run_folder(spark, "m")
    media.write_archives(docs, folder)
    spark.dataSource.register(media.MediaArchive)
    for size in (1000, 5000, 10**9):
        got = spark.read.format("media_archive").option("rangeBytes", size).load(folder)
        assert got.count() == docs.count() == got.select("doc_id").distinct().count()


def test_png_and_damage():
    payload = media.payload_of("hello" * 1000)
    png = media.encode_png(payload)
    assert media.decode_png(png).tobytes() == payload
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(png[:40] + bytes([png[40] ^ 1]) + png[41:])
    with pytest.raises(ValueError):
        media.decode_png(b"GIF" + png[3:])


def test_member_is_read_again_by_offset(tmp_path):
    png = media.encode_png(media.payload_of("abc"))
    (tmp_path / "a").write_bytes(b"####" + png)
    calls = []

    def flaky(name):
        calls.append(name)
        if len(calls) < 3:
            raise OSError("lost")
        return open_random(name)

    got, samples = media.read_member(str(tmp_path / "a"), 4, len(png), zlib.crc32(png), flaky, 0)
    assert got == png and len(calls) == 3 and isinstance(samples, np.ndarray)
    with pytest.raises(ValueError):
        media.read_member(str(tmp_path / "a"), 3, len(png), zlib.crc32(png), wait=0)


def test_one_stream_a_range(tmp_path):
    """A range is opened once; a failure in it costs the member alone."""
    pngs = [media.encode_png(media.payload_of("abc" * i)) for i in range(1, 40)]
    (tmp_path / "a").write_bytes(b"".join(pngs))
    offsets = np.cumsum([0, *map(len, pngs)])
    members = [(int(o), len(p), zlib.crc32(p)) for o, p in zip(offsets, pngs)]
    opened = []

    class Flaky:
        def __init__(self, name):
            opened.append(name)
            self.file, self.reads = open_random(name), 0

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def close(self):
            self.file.close()

        def read(self, n):
            self.reads += 1
            if self.reads == 10 and len(opened) == 1:
                raise OSError("lost")
            return self.file.read(n)

    got = [m for m, _ in media.read_members(str(tmp_path / "a"), members, Flaky, 0)]
    assert got == pngs and len(opened) == 3
    with pytest.raises(ValueError):
        list(media.read_members(str(tmp_path / "a"), [(1, 50, 7)], wait=0))


def feature_by_hand(payload):
    n, rows = len(payload), [payload[i : i + 24] for i in range(0, len(payload), 24)]
    mean = sum(payload) / n
    deviation = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
    shares = [payload.count(bytes([x])) / n for x in set(payload)]
    entropy = abs(-sum(p * math.log2(p) for p in shares))
    high = len(rows) // 8
    grid = [sum(sum(r[c * 3 : c * 3 + 3]) for r in rows[b * high : (b + 1) * high]) for b in range(8) for c in range(8)]
    bits = "".join("1" if 64 * g > sum(grid) else "0" for g in grid)
    return mean, deviation, entropy, f"{int(bits, 2):016x}"


def test_feature_by_hand(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in documents(spark, sf_dir).collect()}
    for r in media.op10(spark, documents(spark, sf_dir)).collect():
        *numbers, ahash = feature_by_hand(media.payload_of(texts[r.doc_id]))
        got = dict(part.split("=") for part in r.feature.split(";"))
        assert got["ahash"] == ahash
        for name, value in zip(("mean", "dev", "entropy"), numbers, strict=True):
            assert abs(float(got[name]) - value) < 1e-4
