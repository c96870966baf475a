import duckdb
import pytest

from canopy.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["nation", "customer", "part", "orders", "lineitem", "events"]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([None if v != v else round(float(v), 4) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v) for v in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
