"""Every registered query against its DuckDB twin, or for rows where it has none."""

import glob
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tallyweave.plans import catalog

REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "None"
        if hasattr(v, "isoformat"):
            return str(v)[:26]
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in catalog.ORACLE:
        assert rows
        return
    want = con.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert plain(rows) == plain([[r[i] for i in order] for r in want.fetchall()])


def test_every_twin_has_its_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_entry_without_the_corpus_folder(tmp_path):
    """The entry imports and lists the other queries where the corpus operators are not installed."""
    shutil.copytree(REPO / "tallyweave", tmp_path / "tallyweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_filters_reach_the_scan(spark, sf):
    plan = catalog.QUERIES["results_page"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan
    plan = catalog.QUERIES["person_exact"](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
