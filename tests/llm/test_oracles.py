"""The operators' queries against their SQL on the smallest tables; those without SQL give a row for each input row."""

import duckdb
import pytest

from ledgerloom.llm import registry, whitening
from tests.test_parity import SF, TABLES, plain


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        table = "embeddings" if "vec_id" in got.columns else "documents"
        each = whitening.COMPONENTS if name == "op13_whitening" else 1
        assert len(rows) == each * con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
        return
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=repr)
