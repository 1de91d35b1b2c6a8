"""ts6_rank equals its SQL on repeated events where no order of additions changes a mean: values in steps of 1/64."""

import duckdb
import pytest

from tellumen.plans.registry import QUERIES, SQL

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.mark.parametrize("user", ["user_id", "user_id + 1500 * k"])
def test_rank_of_exact_sums(spark, tmp_path, user):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT event_id + 1000 * k AS event_id, ts, {user} AS user_id, event_type, round((value + k) * 64) / 64 AS value, props FROM '{EVENTS}', (SELECT unnest(range(12)) AS k)) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES["ts6_rank"](spark, str(tmp_path))
    theirs = con.sql(f"SELECT {', '.join(df.columns)} FROM ({SQL['ts6_rank']})").fetchall()
    assert theirs and sorted(map(tuple, df.collect())) == sorted(theirs)
