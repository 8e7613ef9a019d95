"""Every query beside its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sorrel.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "item") else str(v)
    return sorted(map(repr, (tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name in catalog.ORACLES:
        want = db.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0


def test_a_user_of_very_many_events_is_read_whole(spark, tmp_path):
    events = spark.range(12_000).selectExpr("id as event_id", "id % 2 as user_id", "if(id % 2 = 0, 'signup', 'view') as event_type")
    events.unionByName(events.selectExpr("event_id + 12000 as event_id", "user_id", "event_type")).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.file_id, r.capture): r.n for r in catalog.syntax_captures(spark, str(tmp_path)).collect()}
    assert got[("0", "root")] == got[("1", "root")] == 1 and not any(c == "error" for _, c in got)
    assert got[("0", "hoist.definition.function")] == got[("1", "local.definition.macro")] == 12_000
