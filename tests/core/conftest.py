import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def same():
    """Compare a query with its DuckDB oracle on the smallest tables."""

    def check(spark, query, sql):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        found, got = con.sql(sql), query(spark, DATA)
        names = sorted(found.columns)
        assert sorted(got.columns) == names
        at = [found.columns.index(c) for c in names]
        want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want

    return check
