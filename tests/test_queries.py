"""Every registered query against its DuckDB oracle (at the scale the oracles' constants are for), and the registry."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strata.plans.registry import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone(tmp_path):
    """Without the training-data part the entry imports and keeps the other queries."""
    for p in ROOT.rglob("*.py"):
        at = p.relative_to(ROOT)
        if "llm" not in at.parts and at.name != "corpus_pipeline.py":
            (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / at).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rankings' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
