"""Every registered query of the engine's own operators against its SQL."""

import duckdb
import pytest

from siltstone.plans import queries as own
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", list(own.queries()))
def test_query(spark, sf_dir, name):
    df = own.queries()[name](spark, sf_dir)
    sql = own.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert_same(df, connect(sf_dir), sql)


def test_parts_of_seconds(spark, tmp_path):
    """An event half a second before a minute is in the minute before, for the query and its SQL alike."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT id AS event_id, 1 AS user_id, type AS event_type, ts::TIMESTAMP AS ts FROM (VALUES
        (1, 'signup', '2024-01-01 00:00:59.700000'), (2, 'view', '2024-01-01 00:00:59.600000'), (7, 'signup', '2024-01-03 00:01:00'),
        (4, 'view', '2024-01-04 00:01:59.999999'), (5, 'view', '2024-01-04 00:02:00'), (6, 'view', '1969-12-31 23:59:59.6')) v(id, type, ts)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = own.innermost_container(spark, str(tmp_path))
    assert_same(df, con, own.oracle_sql()["innermost_container"])
    assert {(r[0], r[1]) for r in df.collect()} == {(2, 1), (4, 7)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "relative_path"
