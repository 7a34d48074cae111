"""Streams give what the same rows give in one batch, whatever files they arrive in."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.streaming import arrivals

SCHEMA = "event_id INT, user_id INT, ts TIMESTAMP, value DOUBLE"
START = dt.datetime(2024, 1, 1)


def batch(spark, rows):
    return spark.createDataFrame([(i, u, START + dt.timedelta(hours=h), v) for i, u, h, v in rows], SCHEMA)


def feed(spark, tmp_path, files, build):
    """Write each list of rows as one file, then run the stream a file at a time."""
    source = str(tmp_path / "in")
    for rows in files:
        batch(spark, rows).coalesce(1).write.mode("append").parquet(source)
    stream = build(arrivals.read_file_stream(spark, source, SCHEMA, files_per_trigger=1))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    arrivals.write_once(stream, out, marks)
    return spark.read.parquet(out)


FIRST = [(1, 1, 0, 5.0), (2, 2, 1, 6.0), (3, 1, 30, 7.0)]
SECOND = [(4, 2, 40, 8.0), (5, 3, 41, None)]


def test_replayed_file_is_dropped(spark, tmp_path):
    got = feed(spark, tmp_path, [FIRST, FIRST, SECOND], lambda s: arrivals.stream_dedup(s, "event_id", "ts", "10 days"))
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4, 5]


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    cohort = spark.createDataFrame([(1, 50.0), (2, None)], "user_id INT, age DOUBLE")
    score = lambda df: arrivals.stream_score(df, cohort, "user_id", {"value": 0.5, "age": -0.1}, 0.2)
    got = feed(spark, tmp_path, [FIRST, SECOND], score).select("event_id", "score")
    want = score(batch(spark, FIRST + SECOND)).select("event_id", "score")
    got, want = ({r.event_id: r.score for r in df.collect()} for df in (got, want))
    assert got == pytest.approx(want) and got[5] is None and got[4] is not None


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, arrivals.ROCKSDB)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("cut", [1, 3, 6])
def test_overdue_alerts_do_not_depend_on_files(spark, tmp_path, rocksdb, cut):
    # User 1 pauses from hour 0 to 100, user 2 never pauses two days, user 3 stops at hour 10.
    rows = [(1, 1, 0, 0.0), (2, 2, 1, 0.0), (3, 3, 10, 0.0), (4, 2, 40, 0.0), (5, 2, 80, 0.0), (6, 1, 100, 0.0), (7, 2, 120, 0.0)]
    files = [rows[i : i + cut] for i in range(0, len(rows), cut)]
    got = feed(spark, tmp_path, files, lambda s: arrivals.stream_overdue(s, "user_id", "ts", 2, "200 hours"))
    assert got.count() == 0
    late = files + [[(8, 9, 1000, 0.0)]]
    got = feed(spark, tmp_path / "late", late, lambda s: arrivals.stream_overdue(s, "user_id", "ts", 2, "200 hours"))
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    hours = sorted((r.id, (r.last_ms - base) / 3_600_000) for r in got.collect())
    assert hours == [(1, 0), (1, 100), (2, 120), (3, 10)]


def test_a_gap_a_little_over_due_is_an_alert(spark, tmp_path, rocksdb):
    """48 hours are due: 48.5 hours are too long and 47.5 are not, wherever in an hour they begin."""
    rows = [(1, 1, 0.75, 0.0), (2, 1, 49.25, 0.0), (3, 2, 0.25, 0.0), (4, 2, 47.75, 0.0), (5, 2, 48.1, 0.0), (6, 1, 49.5, 0.0), (7, 1, 97.4, 0.0), (8, 2, 96.1, 0.0), (9, 9, 1000, 0.0)]
    got = feed(spark, tmp_path, [rows[:4], rows[4:]], lambda s: arrivals.stream_overdue(s, "user_id", "ts", 2, "200 hours"))
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    found = sorted((r.id, round((r.last_ms - base) / 3_600_000, 2)) for r in got.collect())
    assert found == [(1, 0.75), (1, 97.4), (2, 96.1)] and all(r.due_ms - r.last_ms == 48 * 3_600_000 for r in got.collect())


def test_state_grows_with_open_sessions_not_with_visits(spark, tmp_path, rocksdb):
    """One row per open session: a user with a visit in each of 400 hours takes no more state than one with a single visit."""
    source = str(tmp_path / "in")
    batch(spark, [(i, 1, i, 0.0) for i in range(400)]).coalesce(1).write.mode("append").parquet(source)
    batch(spark, [(400, 9, 1000, 0.0)]).coalesce(1).write.mode("append").parquet(source)
    stream = arrivals.stream_overdue(arrivals.read_file_stream(spark, source, SCHEMA, files_per_trigger=1), "user_id", "ts", 2, "2 hours")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress) <= 4
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert [(r.id, (r.last_ms - base) / 3_600_000) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 399)]


def test_a_visit_at_the_due_time_itself_is_in_time(spark, tmp_path, rocksdb):
    day = 24.0
    rows = [(1, 1, 0.0, 0.0), (2, 1, 2 * day, 0.0), (3, 2, 0.0, 0.0), (4, 2, 2 * day + 0.001 / 3600, 0.0), (5, 9, 1000, 0.0)]
    for cut in (1, 5):
        files = [rows[i : i + cut] for i in range(0, len(rows), cut)]
        got = feed(spark, tmp_path / str(cut), files, lambda s: arrivals.stream_overdue(s, "user_id", "ts", 2, "200 hours"))
        base = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        assert sorted((r.id, r.last_ms - base) for r in got.collect()) == [(1, 172_800_000), (2, 0), (2, 172_800_001)]
