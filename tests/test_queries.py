"""Each graph query against its SQL in DuckDB, and the entry module."""

import subprocess
import sys

import duckdb
import pytest

from motifloom.plans.oracles import ORACLE_SQL
from motifloom.plans.queries import QUERIES

from .conftest import ROOT, TINY


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{TINY}/lineitem.parquet'")
    return con


#: Too many sets or draws for SQL; held against enumeration and against each other in test_cuts.
NO_SQL = {"copurchase_graphlet5", "copurchase_orbits5", "copurchase_psrw5"}


def test_all_have_sql():
    assert set(QUERIES) - NO_SQL == set(ORACLE_SQL)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, db, name):
    got = QUERIES[name](spark, TINY)
    cur = db.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(cols)
    rows = sorted(map(str, ([r[c] for c in cols] for r in got.collect())))
    assert rows == sorted(str(list(r)) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["type", "name", "cnt"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_text_operators():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('motifloom.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'graphlet4' in e.queries() and 'pipeline' not in e.queries() and not any(q.startswith('op') for q in e.queries())\n"
        "assert 'graphlet4' in e.oracle_sql()\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
