"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("driver tables are not here")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.9g}")
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, con, name):
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    expected = rows(names, cur.fetchall())
    df = entry.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_papers_are_spread_over_the_cores(spark):
    from orrery.plans import model_queries as M
    from orrery.plans.tables import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    papers = M._papers(tables)
    assert papers.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > tables.part.rdd.getNumPartitions()
    assert papers.count() == tables.part.count()
