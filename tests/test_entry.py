import duckdb
import pytest

import __spark_entry__ as entry
from seqsim.plans import registry

SF = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "lineitem", "orders"):
        db.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want, got = db.execute(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["seq_a", "seq_b", "dist"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_histogram_of_all_orders(spark, sf):
    path = f"/root/testdata/{sf}"
    got = registry.QUERIES["hist_whole_range"](spark, path).toPandas()
    want = duckdb.sql(f"SELECT count(*) FROM '{path}/orders.parquet'").fetchall()[0][0]
    assert got["n"].sum() == want and sorted(got["bin"]) == list(range(64))
