"""Every query of the catalogue against the same in SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SMALL
from vellum.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return made


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(str, r)) for r in frame.where(frame.notna(), None).values)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLE:
        want = con.execute(ORACLE[name]).df()
        assert sorted(found.columns) == sorted(want.columns) and rows(found) == rows(want)


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["bib_key", "arxiv_id", "score", "rank"] and found.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
