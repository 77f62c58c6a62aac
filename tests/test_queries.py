"""The driver contract, queries against their SQL, and the stream."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from conftest import ROOT, SF

from lexgrove import catalog
from lexgrove.operators.rules import RuleSet
from lexgrove.streaming.pipes import match_stream, read_documents, run_batches, write_matches

NAMES = sorted(catalog.ORACLE)


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        made.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return made


def _norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(_norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(_norm(r[c]) for c in columns) for r in got.collect()) == want and want


def test_entry_imports_alone():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 50)"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("True"), done.stderr


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3).write.parquet(str(folder))
    rules = RuleSet().add("the", [[{"LOWER": "the"}]])
    write_matches(match_stream(read_documents(spark, str(folder), 1), rules), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    want = catalog.QUERIES["match_lower"](spark, SF).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want
    run_batches(read_documents(spark, str(folder)), lambda b: b.groupBy().count(), str(tmp_path / "b"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "b")).agg({"count": "sum"}).first()[0] == 200
