import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(entry.queries())


def test_rest_works_without_the_llm_folders(tmp_path):
    shutil.copytree(HERE, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 70 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def rounded(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    frame = registry.queries()[name](spark, sf_dir)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted((tuple(map(rounded, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(rounded, r)) for r in frame.select(*names).collect()), key=repr) == want
