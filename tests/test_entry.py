"""Every query runs on the smallest tables, and equals its SQL where it has some."""

import glob
import os

import duckdb
import pytest

from strandlake.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
#: Slow ones run in the driver's own check.
SLOW = {"kmer_containment_filter", "positive_read_filter", "negative_read_filter", "viterbi_events"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, names):
    def cell(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.7g}" if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE_SQL) - SLOW))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got, want = df.collect(), duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(got, df.columns) == plain(want.fetchall(), names)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 70
    assert e.entry(spark).columns == ["doc_id", "n_kmers", "n_hits", "fraction", "passed"]
