"""Every core query that has SQL gives the rows DuckDB gives."""

import glob
import os

import duckdb
import pytest

from millrace.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(DIR + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    if name not in registry.ORACLE:
        assert got
        return
    rel = duck.sql(registry.ORACLE[name])
    order = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    assert [rel.columns[k] for k in order] == sorted(df.columns)
    assert got == sorted((tuple(row[k] for k in order) for row in rel.fetchall()), key=str)


def test_csv(spark, tmp_path):
    from millrace.sources.tables import read_csv

    (tmp_path / "a.csv").write_text("name, age,w\nann, 3,1.5\nbob,n/a,2\n")
    d = read_csv(spark, str(tmp_path / "a.csv"))
    assert d.dtypes == [("name", "string"), ("age", "bigint"), ("w", "double")]
    assert [tuple(x) for x in d.collect()] == [("ann", 3, 1.5), ("bob", None, 2.0)]


def test_the_entry_is_imported_without_a_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, cwd=os.path.dirname(os.path.dirname(__file__)), timeout=120)
