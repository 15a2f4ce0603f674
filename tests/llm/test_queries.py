"""The problems' queries with SQL against DuckDB on the smallest test data, and that every other one runs."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")

from quarrymill.llm import queries  # noqa: E402

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    df = queries.queries()[name](spark, DIR)
    cur = c.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    got = sorted(tuple(r[x] for x in sorted(cols)) for r in df.collect())
    assert got == sorted(tuple(r[cols.index(x)] for x in sorted(cols)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_runs_and_repeats_no_row(spark, name):
    rows = queries.queries()[name](spark, DIR).collect()
    assert len(rows) == len({repr(r) for r in rows}) or name in ("p3_scores", "p4_redacted", "p7_ids")


def test_cues_of_training_windows_are_short():
    """Cues are a few words, so that no sentence pattern of any text is learned."""
    from quarrymill.llm import pii_train

    assert max(len(c.split()) for cues in (*pii_train.BEFORE.values(), *pii_train.AFTER.values()) for c in cues) <= 4
