"""Every registered query of the library against its SQL, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from editfray.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(DATA).glob("*.parquet")]


def rows(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(map(str, ([plain(v) for v in r] for r in frame[columns].itertuples(index=False, name=None))))


@pytest.mark.skipif(not TABLES, reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(c.execute(ORACLES[name]).df())


def test_entry_imports_without_the_optional_parts():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
