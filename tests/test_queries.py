"""Every query with SQL against DuckDB, on the smallest tables."""

from functools import cache

import duckdb
import pytest

from quillgraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def shared_parts():
    """What several queries begin with is computed once for all of them."""
    with pytest.MonkeyPatch.context() as m:
        for name in ("_start", "_state", "_ingested", "_entity_list", "_groups", "_stateful"):
            m.setattr(catalogue, name, cache(getattr(catalogue, name)))
        yield


def rows(table, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in table)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_catalogue_is_complete():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL) and len(catalogue.QUERIES) >= 80
