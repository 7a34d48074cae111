"""A task reads a bounded share of the input, whatever the session's own numbers."""

from cohortlens import session


def test_tasks_read_a_bounded_share(spark):
    names = [*session.TASK_BYTES, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    size, read, parts = names[1], names[0], names[2]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.unset(parts)
        spark.conf.set(size, "64MB")
        spark.conf.set(read, "8m")
        session.configure(spark)
        assert session._bytes(spark.conf.get(size)) == 16 << 20
        assert spark.conf.get(read) == "8m"  # smaller already
        assert int(spark.conf.get(parts)) >= session.PARTS
        groups = spark.range(3_000_000).selectExpr("id * 7 as k", "uuid() as u").groupBy("k").agg({"u": "max"})
        assert groups.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))  # 4 of 40 MB each before
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_sizes_are_read_as_spark_writes_them():
    assert [session._bytes(s) for s in ("128MB", "16m", "67108864b", "67108864", "1g")] == [128 << 20, 16 << 20, 64 << 20, 64 << 20, 1 << 30]
