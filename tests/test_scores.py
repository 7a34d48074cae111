"""Scores at the edge of a step do not depend on the order in which values are added."""

import datetime as dt

import duckdb
import pytest

from cohortlens.catalog import outputs
from cohortlens.sources import TABLE_SCHEMAS

#: The exact mean is 15, the first value of score 2; added as doubles in this order, 44.99999999999999 comes out, and 45 in ascending order.
EDGE = [20.7, 15.93, 8.37]


@pytest.mark.parametrize("query", ["M1_scorecard", "M2_rank_cards"])
def test_means_are_exact(spark, tmp_path, query):
    at = dt.datetime(2024, 1, 1)
    rows, n = [], 0
    for user, values in enumerate([EDGE, [0.1] * 10 + [29.9] * 10, [16.97, 13.12, 21.64, 21.47, 1.7, 15.1], [-3.0], [None]]):
        for kind in outputs.CRITERIA:
            for v in values:
                rows.append((n, at, user, kind, v, ""))
                n += 1
    got = {}
    for name, order in (("as", rows), ("by", sorted(rows, key=lambda r: (r[4] is None, r[4]))), ("off", sorted(rows, key=lambda r: -(r[4] or 0)))):
        folder = tmp_path / name
        spark.createDataFrame(order, TABLE_SCHEMAS["events"]).coalesce(1).write.parquet(f"{folder}/events.parquet")
        got[name] = sorted(tuple(r) for r in outputs.QUERIES[query](spark, str(folder)).collect())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        assert sorted(con.execute(outputs.SQL[query]).fetchall()) == got[name]
    assert got["as"] == got["by"] == got["off"]
    if query == "M1_scorecard":
        assert [r[4] for r in got["as"]] == [2.0, 2.0, 2.0, None, None]
