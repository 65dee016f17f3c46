"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from crossweave.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def rows(frame):
    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return str(list(v))
        if v is None or v != v:
            return "NULL"
        return f"{float(v):.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = rows(got), rows(want)
    # The last digit may differ where a sum runs in another order.
    assert a == b or all(all(x == y or abs(float(x) - float(y)) < 3e-5 for x, y in zip(p, q)) for p, q in zip(a, b))


def test_every_query_is_named(spark):
    assert set(catalogue.ORACLES) == set(catalogue.QUERIES)


def test_entry_without_the_corpus_part(tmp_path):
    """The entry imports without the corpus operators, and doesn't hide errors in them."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "crossweave"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "crossweave" / "llm", ignore_errors=True)

    def run():
        return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})

    n = len(catalogue.QUERIES)
    assert run().stdout.split() == [str(n), str(n)]
    (tmp_path / "corpus_pipeline.py").write_text("raise AssertionError")
    assert run().stdout.split() == [str(n), str(n)]
    (tmp_path / "crossweave" / "llm").mkdir()
    for name in ("__init__", "oracles", "queries"):
        (tmp_path / "crossweave" / "llm" / f"{name}.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_missing")
    assert "a_module_that_is_missing" in run().stderr
