import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing, token_files
from lodestone.llm.common import documents, run_folder
from lodestone.llm.tokens import ChunkEncoder, default_vocabulary

ODD = ["", None, "   \n\t ", "Don't STOP, it's 1234 ... <|endoftext|>x", "É́ ﬁ İstanbul ΣΑΣ K \x1c\x85\xa0z", "日本語 テキスト한글", "a" * 30_000, "word " * 20_000, "x\x0by\x0cz", "1,2.3 a.b,c. end,", "<|EndOfText|> a<|ENDOFTEXT|>b <|endoftext|>", "it's' 's can't. a_b (c) x's!! É,*** ß&&& a............ ab'''"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library, spark, sf_dir):
    texts = ODD + [r.text for r in documents(spark, sf_dir).select("text").collect()]
    for capacity in (500, 20_000, 160_000_000):
        own = ChunkEncoder(default_vocabulary(), capacity)
        for _ in range(3):
            found = own.encode(texts)
            assert [np.frombuffer(f, own.dtype).tolist() for f in found] == [ids_of(library, t) for t in texts]


def frame(spark, texts):
    return spark.createDataFrame([(i * 3, t, "x", "s") for i, t in enumerate(texts)], "doc_id long, text string, start string, length string")


def check_packed(library, rows, docs):
    want = {i: [*ids_of(library, t), 2] for i, t in docs}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        part = want[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert pieces.keys() == want.keys()
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(want[i])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_packing(library, spark, sf_dir):
    docs = documents(spark, sf_dir)
    check_packed(library, packing.pack_rows(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check_packed(library, packing.pack_rows(frame(spark, ODD)).collect(), [(i * 3, t) for i, t in enumerate(ODD)])
    assert packing.pack_rows(docs.limit(0)).count() == 0


def test_blocks_balance_and_lose_nothing():
    rng = np.random.default_rng(1)
    pieces = [(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 4096, 3000))]
    sequences, held = packing.pack_block(pieces, False)
    assert all(sum(n for _, _, n in s) == 4096 for s in sequences)
    assert sum(n for s in [*sequences, held] for _, _, n in s) == sum(n for _, _, n in pieces)
    assert sum(n for _, _, n in held) < 4096
    covered = sorted((i, a, a + n) for s in [*sequences, held] for i, a, n in s)
    for i, _, n in pieces:
        own = [(a, b) for j, a, b in covered if j == i]
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    costs = [sum(packing.cost(n) for _, _, n in s) for s in sequences]
    assert max(costs) < 1.2 * min(costs)


def test_token_files(library, spark, sf_dir):
    docs = documents(spark, sf_dir)
    for source in (docs, frame(spark, ODD)):
        start = 0
        got = sorted(token_files.op4(spark, source).collect())
        assert len(got) == source.count()
        for r, d in zip(got, sorted(source.collect(), key=lambda d: d.doc_id)):
            ids = [*ids_of(library, d.text), 1]
            assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            start += len(ids)
    assert token_files.op4(spark, docs.limit(0)).count() == 0
    twice = frame(spark, ["b", "a"]).selectExpr("7L as doc_id", "text")
    assert [r.start for r in sorted(token_files.op4(spark, twice).collect())] == [0, 2]
    with pytest.raises(Exception, match="without an id"):
        token_files.write_token_files(frame(spark, ["a"]).selectExpr("cast(null as long) doc_id", "text"), run_folder(spark, "t"))


def test_small_shards_follow_each_other(library, spark, sf_dir):
    docs = documents(spark, sf_dir).limit(100)
    same = docs.selectExpr("CASE WHEN doc_id % 3 = 0 THEN 7 ELSE doc_id END AS doc_id", "text")
    shards = token_files.write_token_files(same, run_folder(spark, "t"), shard_tokens=5000)
    assert len(shards) > 8 and all(a.base + a.tokens == b.base for a, b in zip(shards, shards[1:]))
    assert max(s.tokens for s in shards if s.documents > 1) < 5000 + max(len(ids_of(library, r.text)) + 1 for r in same.collect())
    got = token_files.token_file_rows(spark, shards).collect()
    starts = {r.start: r for r in got}
    assert len(starts) == len(got) == 100
    ordered = [starts[s].doc_id for s in sorted(starts)]
    assert ordered == sorted(ordered)
    want = sorted((r.doc_id, len(ids_of(library, r.text)) + 1) for r in same.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want


def test_cache_keeps_what_comes_again():
    own = ChunkEncoder(default_vocabulary(), 100_000)
    learned = []
    learn = own._learn
    own._learn = lambda runs: learned.append(set(runs)) or learn(runs)
    common = [f"often{i:c}".encode() for i in range(97, 122)]
    for batch in range(40):
        own.encode([b" ".join(common), " ".join(f"rare{batch}x{i}" for i in range(100)).encode(), b"y" * 10_000])
        assert own.held <= own.capacity
    assert all(not learned[i] & set(common) for i in range(1, 40)) and all(b"y" * 10_000 in runs for runs in learned)
