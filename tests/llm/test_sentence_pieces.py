import hashlib
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import sentence_pieces as sp
from lodestone.llm.common import documents

ODD = ["", "a", " ", "  lead and  gap ", "tab\tnew\nline\r\n\x00\x7f", "▁ mark▁inside ▁▁", "日本語 テキスト 한글 🙂🙂", "<s> </s> <0x41> <unk>", "x" * 50_000, "ab " * 30_000, "é" * 3000 + "́", "\x85\xa0 "]


@pytest.fixture(scope="module")
def own():
    return sp.lattice(sp.default_model())


def test_lossless_and_reproducible(own):
    keys = list(range(len(ODD)))
    raw = [t.encode() for t in ODD]
    got = own.sample(raw, keys)
    for text, ids in zip(ODD, got):
        assert own.decode(ids.tolist()) == text
    for i, text in enumerate(raw):
        assert own.sample([text], [i])[0].tolist() == got[i].tolist()
    assert any(a.tolist() != b.tolist() for a, b in zip(got, own.sample(raw, [k + 100 for k in keys])))
    assert own.sample([b"the same words"], [None])[0].tolist() == own.sample([b"", b"the same words"], [1, None])[1].tolist()


def ways(own, unit):
    """All segmentations of a unit by brute force, with their chances."""
    known = {own.bytes_of[i].decode(): i for i in np.flatnonzero(own.weights)}
    done = {"": [((), 1.0)]}

    def of(rest):
        if rest not in done:
            done[rest] = []
            for size in range(1, min(len(rest), own.longest) + 1):
                piece = rest[:size]
                if piece in known:
                    edges = ((known[piece],), own.weights[known[piece]])
                elif size == 1:
                    edges = (tuple(own.byte_ids[list(piece.encode())].tolist()), sp._BYTES)
                else:
                    continue
                done[rest] += [(edges[0] + ids, edges[1] * weight) for ids, weight in of(rest[size:])]
        return done[rest]

    found = of(unit)
    total = sum(w for _, w in found)
    return {ids: w / total for ids, w in found}


@pytest.mark.parametrize("word", ["there", "nation", "aé\n", "inging", "  b", "   "])
def test_samples_follow_the_lattice(own, word):
    want = ways(own, " " + word)
    draws = 20_000
    got = Counter(tuple(ids.tolist()) for ids in own.sample([word.encode()] * draws, list(range(draws))))
    assert set(got) <= set(want)
    for ids, chance in want.items():
        assert abs(got[ids] / draws - chance) < 0.02


@pytest.mark.parametrize("word", ["there", "inging", "aé\n", "   b"])
def test_long_units_follow_the_lattice(own, word, monkeypatch):
    monkeypatch.setattr(sp, "LONG_UNIT", 3)
    monkeypatch.setattr(sp, "WINDOW", 2)
    want = ways(own, " " + word)
    draws = 5000
    got = Counter(tuple(ids.tolist()) for ids in own.sample([word.encode()] * draws, list(range(draws))))
    assert set(got) <= set(want)
    for ids, chance in want.items():
        assert abs(got[ids] / draws - chance) < 0.04


def test_windows_and_groups_change_nothing(own, monkeypatch):
    text = ("日本語テキスト한글abcdefghi" * 2000 + "  x " + "long words here " * 3000).encode()
    whole = own.sample([text, b"a b"], [7, 8])
    assert own.decode(whole[0].tolist()) == text.decode()
    monkeypatch.setattr(sp, "WINDOW", 1000)
    monkeypatch.setattr(sp, "GROUP_BYTES", 5000)
    assert [x.tolist() for x in own.sample([text, b"a b"], [7, 8])] == [x.tolist() for x in whole]


def test_text_without_blanks_in_bounded_memory(own):
    script = """
import resource, sys, time
from lodestone.llm import sentence_pieces as sp
own = sp.lattice(sp.default_model())
text = ("日本語テキスト한글abcdefghijklmnop" * 200_000).encode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids = own.sample([text], [1])[0]
assert own.decode(ids.tolist()).encode() == text
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, len(text) >> 20)
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(out[1]) >= 8 and int(out[0]) < 900


def test_query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sp.op8(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_pieces > 0
    other = {r.doc_id: r.ids_crc32 for r in sp.op8(docs.repartition(7)).collect()}
    assert other == {r.doc_id: r.ids_crc32 for r in rows}
    edge = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "null key", "y")], "doc_id long, text string, ids string")
    assert sorted(r.n_pieces for r in sp.op8(edge).collect())[:2] == [0, 0]
    assert sp.op8(docs.limit(0)).count() == 0
