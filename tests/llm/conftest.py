import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle():
    """Run DuckDB SQL over a table folder; rows sorted, columns by name."""

    def run(sql, sf_dir=DATA):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = con.sql(sql)
        names = sorted(found.columns)
        at = [found.columns.index(c) for c in names]
        return names, sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)

    return run


@pytest.fixture(scope="session")
def same(oracle):
    def check(spark, query, sql, sf_dir=DATA):
        got = query(spark, sf_dir)
        names, want = oracle(sql, sf_dir)
        assert sorted(got.columns) == names
        assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want

    return check
