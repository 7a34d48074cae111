"""The plans are the ones meant for large data."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortlens import sources
from cohortlens.catalog import base
from cohortlens.functions.keys import order_key
from cohortlens.operators import cleaning, cohort, endpoints, scoring, splits, temporal
from cohortlens.operators.evaluation import decision_table
from cohortlens.plans import sizes
from cohortlens.plans.flows import time_to_crossing
from cohortlens.plans.skew import lookup_join, skew_join
from cohortlens.sources.codes import harmonize_codes
from cohortlens.session import materialized

D = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def exchanges(text):
    tree = text.split("\n\n")[0]
    return len(re.findall(r"[^t]Exchange \(", tree))


def test_scan_reads_only_what_is_used(spark):
    text = plan(sources.load(spark, D, "orders").where("o_totalprice > 1000").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "out")
    sources.write_table(base.visits(spark, D), path, "status")
    text = plan(spark.read.parquet(path).where("status = 'F'"))
    assert "PartitionFilters: [isnotnull(status" in text


def test_dedup_prunes_before_the_shuffle(spark):
    text = plan(cleaning.dedup(base.visits(spark, D), "id", ["t", "vk"]))
    assert text.count("WindowGroupLimit") >= 2 and exchanges(text) == 1


def test_asof_shuffles_once_without_a_join(spark):
    v = base.visits(spark, D).select("id", "t", "vk", "x")
    text = plan(temporal.asof(v, v, by="id", t="t", left_order=["vk"], right_order=["vk"]))
    assert exchanges(text) == 1 and "Join" not in text


def test_split_needs_no_shuffle(spark):
    assert exchanges(plan(splits.split_entity(base.visits(spark, D), "id", {"a": 0.5, "b": 0.5}))) == 0


def test_crossing_flow_shuffles_visits_once(spark):
    v, people = base.visits(spark, D), spark.createDataFrame([(1, "a")], "id BIGINT, g STRING")
    df = time_to_crossing(v, people, id="id", order=["t", "vk"], x="x", rise=1.0, level=2.0, keep=["g"])
    text = plan(df)
    assert len(re.findall(r"Scan parquet", text.split("\n\n")[0])) == 1
    # One for the visits and at most one for each side of the final join with the entities.
    assert exchanges(text) <= 2


def test_decision_table_does_not_repeat_rows_per_cutoff(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 0)], "p DOUBLE, y INT")
    text = plan(decision_table(df, "p", "y", [0.2, 0.5, 0.8]))
    tree = text.split("\n\n")[0].splitlines()
    assert max(i for i, line in enumerate(tree) if "Exchange" in line) > min(i for i, line in enumerate(tree) if "Generate" in line or "Inline" in line)


def test_small_lookup_is_broadcast_and_large_is_not(spark, monkeypatch):
    df = base.visits(spark, D)
    table = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    small = lookup_join(df, table, "id")
    assert "BroadcastHashJoin" in plan(small)
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(sizes, "LOOKUP_ROWS", 10)
    assert sizes.small_broadcast(table) is None
    assert lookup_join(df, table, "id").exceptAll(small).isEmpty()


def test_sizes_are_known_without_a_job(spark):
    v = base.visits(spark, D)
    joined = v.join(base.patients(spark, D), "id")
    assert 0 < sizes.input_bytes(v) <= sizes.plan_bytes(v) < 10**7
    assert sizes.input_bytes(joined) < 10**7 < sizes.plan_bytes(joined)


def test_materialized_keeps_rows_and_types(spark):
    df = base.visits(spark, D)
    again = materialized(df)
    assert again.schema == df.schema and again.count() == df.count()


def test_skewed_join_is_left_to_adaptive_execution_when_allowed(spark, monkeypatch):
    from cohortlens.plans import skew

    v = base.visits(spark, D)
    one = v.groupBy("id").agg(F.max("x").alias("m"))
    assert "BroadcastHashJoin" in plan(skew_join(v, one, "id"))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    assert "_salt" not in plan(skew_join(v, one, "id"))
    assert "_salt" in plan(skew_join(v, one, "id", group_rows=5))


SLOW = ("I", "N", "E9", "flow")


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(SLOW)])
def test_no_query_pairs_rows_without_a_key(spark, name):
    text = plan(entry.queries()[name](spark, D))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_small_files_with_many_rows_are_probed(spark, tmp_path):
    """A column of one value compresses to nothing; its rows still count."""
    spark.range(50_000).select((F.col("id") * 0).alias("id")).coalesce(1).write.parquet(f"{tmp_path}/a")
    df = spark.read.parquet(f"{tmp_path}/a")
    assert sizes.input_bytes(df) < 10_000 and sizes.input_rows(df) == 50_000
    assert sizes.few_rows(df, 50_000, 1 << 20) and not sizes.few_rows(df, 49_999, 1 << 20)


def test_a_long_list_is_pruned_in_two_steps(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("site"), F.xxhash64("id").alias("score"), "id")
    got = scoring.flag_list(df, F.lit(True), [F.desc("score")], 2000, "site").collect()
    want = scoring.flag_list(df, F.lit(True), [F.desc("score")], 900, "site").collect()
    best = {s: [r.id for r in sorted(got, key=lambda r: r.list_rank) if r.site == s] for s in range(3)}
    assert all(len(v) == 2000 for v in best.values()) and all(best[r.site][r.list_rank - 1] == r.id for r in want)


def test_repeated_labels_and_codes_do_not_pair_up(spark):
    a = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0)], "id INT, y INT")
    assert sorted(tuple(r) for r in endpoints.label_counts(a, a, "id", "y", "y").collect()) == [(0, 0, 1), (1, 1, 1)]
    codes = spark.createDataFrame([("a", "X"), ("a", "Y")], "code STRING, canonical STRING")
    rows = spark.createDataFrame([("a",), ("b",)], "code STRING")
    assert sorted(r.canonical for r in harmonize_codes(rows, codes, "code").collect()) == ["X", "b"]


def test_competing_risks_read_each_table_once_and_hash(spark):
    text = plan(base.competing_table(spark, D))
    tree = text.split("\n\n")[0]
    assert tree.count("Scan parquet") <= 4 and "SortAggregate" not in tree  # line items, orders, and the written row per entity


def test_first_values_hash(spark):
    text = plan(cohort.index_event(base.visits(spark, D), "id", "t", ["x"], "vk"))
    assert "SortAggregate" not in text and "HashAggregate" in text
    assert "SortAggregate" not in plan(base.cohort(spark, D))


@pytest.mark.parametrize("kind", ["DATE", "TIMESTAMP", "INT"])
def test_packed_order_is_the_order(spark, kind):
    """Times before and after 1970, ties of both signs, the least and greatest, and null."""
    big = 2**63 - 1
    rows = [(k, t, v) for k, (t, v) in enumerate((t, v) for t in (-40_000, -1, 0, 1, 30_000) for v in (None, -big - 1, -7, 0, 3, big))]
    df = spark.createDataFrame(rows, "k INT, n INT, vk BIGINT")
    t = {"DATE": F.date_from_unix_date("n"), "TIMESTAMP": F.timestamp_seconds(F.col("n").cast("bigint") * 86_400), "INT": F.col("n")}[kind]
    df = df.select("k", t.alias("t"), "vk")
    packed = [r.k for r in df.orderBy(order_key(df, ["t", "vk"])).collect()]
    assert packed == list(range(len(rows)))
    first = cohort.index_event(df.withColumn("id", F.lit(1)), "id", "t", ["k"], "vk").first()
    assert first.index_k == 0 and first.n_visits == len(rows)
    assert order_key(df, ["vk", "t"]) is None and order_key(df, ["t"]) is not None
