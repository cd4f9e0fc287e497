import math

import duckdb
import pytest

from losslens.llm import queries
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries.queries()[name](spark, SMALL)
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v)
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in found.fetchall())
