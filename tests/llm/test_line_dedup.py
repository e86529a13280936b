import hashlib
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import line_dedup
from lodestone.llm.common import documents, run_folder
from lodestone.llm.line_dedup import CuckooFilter, LineIndex, op7


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def key(line):
    return lower(line.strip(" \t\n\r\x0b\x0c"))


def brute(rows):
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(h := holders.get(key(x), [])) < 3 or max((j for j in h if j is not None), default=i) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted(map(tuple, frame.collect()), key=str)


LONG = "A line of more than Twenty characters"
EDGES = [
    (1, None), (2, ""), (3, f"{LONG}\nx\n{LONG.lower()}"), (4, f"\t{LONG} \x0b\nshort"), (9, f"{LONG}\r\ny"), (5, "é" * 20), (6, "é" * 20 + " "), (7, "É" * 20 + "\n" + "é" * 20),
    (8, "n" * 19), (10, "n" * 19), (11, "n" * 19), (None, LONG), (12, ("q" * 50 + "\n") * 5000), (13, "q" * 50), (13, "q" * 50), (14, "\xa0" + LONG), (15, "z\n\n\n"),
]


def test_matches_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert result(op7(spark, docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    edge = spark.createDataFrame([(i, t, "a", "b") for i, t in EDGES], "doc_id long, text string, digest string, _drop string")
    assert result(op7(spark, edge)) == brute(EDGES)
    assert op7(spark, docs.limit(0)).count() == 0


def test_deleting_documents_restores_decisions(spark):
    index = LineIndex(spark, run_folder(spark, "l"))
    frame = lambda ids: spark.createDataFrame([(i, f"{LONG}\nown line number {i} of this test\n{'even' if i % 2 == 0 else 'odd'} lines are shared too") for i in ids], "doc_id long, text string")

    def decided(docs, references):
        return {r.row.doc_id: (r.n_dropped, r.kept_text) for r in index.apply(docs, references).collect()}

    first = frame(range(6))
    references = index.insert(first)
    index.commit()
    before = decided(first, references)
    assert [before[i][0] for i in range(6)] == [2, 2, 2, 2, 1, 0]
    index.insert(frame(range(6, 9)))
    index.commit()
    assert [decided(first, references)[i][0] for i in range(6)] == [2] * 6
    index.delete(frame(range(6, 9)))
    index.commit()
    assert decided(first, references) == before
    index.delete(frame(range(1, 6)))
    index.commit()
    assert {n for n, _ in decided(first, references).values()} == {0}


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = np.array([rng.bytes(15) + b"\x01" for _ in range(5000)], dtype="S16")
    table = CuckooFilter.sized(5000)
    assert table.insert(keys) and table.contains(keys).all()
    others = np.array([rng.bytes(15) + b"\x01" for _ in range(5000)], dtype="S16")
    assert table.contains(others).mean() < 0.01
    table.delete(keys[:2500])
    assert table.contains(keys[2500:]).all() and table.contains(keys[:2500]).mean() < 0.01
    assert not CuckooFilter(1).insert(keys[:50])
    with pytest.raises(KeyError):
        CuckooFilter(4).delete(keys[:1])
    again, end = CuckooFilter.from_buffer(table.to_bytes())
    assert end == len(table.to_bytes()) and (again.table == table.table).all()


def test_commits_merge_what_changed(spark, monkeypatch):
    """Insertions, deletions, splits and a reopened index against counting from scratch."""
    monkeypatch.setattr(line_dedup, "SHARD_REFERENCES", 40)
    folder = run_folder(spark, "l")
    rng = np.random.default_rng(6)
    text = lambda: "\n".join(f"shared line number {rng.integers(30)} of thirty" for _ in range(rng.integers(1, 8)))
    kinds = "doc_id long, text string"
    held: list[tuple] = []
    number = 0
    sizes = []
    for step in range(6):
        index = LineIndex(spark, folder)  # another driver
        assert index.state["version"] == step
        new = [(number + i, text()) for i in range(12)]
        number += 12
        index.insert(spark.createDataFrame(new, kinds))
        held += new
        if step > 1:
            gone = [held[i] for i in rng.choice(len(held), 9, replace=False)]
            if step == 3:
                gone.append(max(held))
                gone = list(dict.fromkeys(gone))
            index.delete(spark.createDataFrame(gone, kinds))
            held = [r for r in held if r not in gone]
        index.commit()
        sizes.append(index.state["bits"])
        want = defaultdict(list)
        for i, t in held:
            for k in {key(x) for x in t.split("\n")}:
                want[hashlib.blake2b(k.encode(), digest_size=16).digest()].append(i)
        again = LineIndex(spark, folder)
        got = {bytes(r.digest): (r.n, r.keep) for r in again.counts().collect()}
        assert got == {k: (len(v), max(v)) for k, v in want.items()}
        docs = spark.createDataFrame(held, kinds)
        rows = again.apply(docs, again.references(docs)).selectExpr("row.doc_id", "n_lines", "n_dropped", "sha2(kept_text, 256)")
        assert result(rows) == brute(held)
    assert sizes[-1] > sizes[0]


def test_untouched_shards_keep_their_files(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_REFERENCES", 100)
    folder = run_folder(spark, "l")
    index = LineIndex(spark, folder)
    lines = [f"a line of its own, number {i}" for i in range(300)]
    index.insert(spark.createDataFrame([(d, "\n".join(lines)) for d in range(3)], "doc_id long, text string"))
    index.commit()
    index.insert(spark.createDataFrame([(9, lines[0])], "doc_id long, text string"))
    index.commit()
    versions = list(index.state["counts"].values())
    assert len(versions) == 16 and versions.count(2) == 1 and list(index.state["filters"].values()).count(2) == 1
    index.commit()
    assert index.state["version"] == 2
