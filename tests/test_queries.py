"""Every registered query of the text engine against its DuckDB oracle, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from warraq.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None).map(lambda x: x.item() if hasattr(x, "item") else x)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


def test_all_have_oracles():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) <= catalogue.ROWS_ONLY


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
