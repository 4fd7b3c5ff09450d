import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tilespan.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_without_the_training_data_operators(tmp_path):
    gone = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=gone)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES))]


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    got = sorted((tuple(map(rounded, r)) for r in found.select(columns).collect()), key=repr)
    assert got == sorted((tuple(rounded(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
