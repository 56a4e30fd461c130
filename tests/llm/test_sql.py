"""Each query that SQL can express against its SQL, on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

pytest.importorskip("provenia.llm")
from provenia.llm.oracles import ORACLES  # noqa: E402
from provenia.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_as_sql(spark, name):
    db = pytest.importorskip("duckdb").connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    told = db.execute(ORACLES[name])
    columns = sorted(d[0] for d in told.description)
    want = Counter(tuple(dict(zip([d[0] for d in told.description], r, strict=True))[c] for c in columns) for r in told.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns and Counter(tuple(r[c] for c in columns) for r in df.collect()) == want
