"""Each query of the extraction engine against its SQL answer, on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import pytest

from provenia.oracles import ORACLES
from provenia.queries import QUERIES, result_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    out = duckdb.connect()
    out.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        out.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return out


def plain(x):
    if isinstance(x, float | Decimal):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    return x


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    told = db.execute(ORACLES[name])
    columns = [d[0] for d in told.description]
    assert sorted(df.columns) == sorted(columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(told.fetchall(), columns)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship_is_whole(spark):
    """Each bill has a row for each of its ten fields, and none without its evidence."""
    rows = result_rows(spark, SF)
    assert rows.groupBy("file", "instance_id").count().filter("count <> 10").isEmpty()
    assert rows.filter("(value is null) <> (origin is null)").isEmpty()


def test_entry_module_names_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
