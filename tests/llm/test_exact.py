"""The stream's classes against grouping by the normalised text in plain Python."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import exact, queries, rows
from cohortlens.session import materialized


def brute(rows):
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc_id is None, doc_id or 0, k))
    return {k: (None if min(own)[0] else min(own)[1], len(own)) for own in groups.values() for *_, k in own}


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, " a b"), (2, "a b"), (None, None), (4, ""), (4, ""), (7, " "), (8, "\n\r"), (None, "only"), (None, "only"), (6, "x" * 100_000), (11, "x" * 100_000)]


@pytest.mark.parametrize("bits", [256, 4, 0])
def test_equals_grouping_even_when_digests_collide(spark, tmp_path, bits):
    """A digest of few bits puts different texts under one; the full comparison parts them."""
    rows = ROWS + [(100 + i, f"t{i % 7}") for i in range(60)]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, k int, digest string")
    digest = exact.sha256 if bits == 256 else lambda t: F.pmod(F.xxhash64(t), F.lit(max(1, bits))).cast("string")
    docs = exact.located(df.withColumn("row", F.lit(1)))
    classes = exact.dedup(docs, digest=digest)
    places = {(r._path, r._row): r.k for r in docs.select("_path", "_row", "k").collect()}
    got, expected = classes.collect(), brute(rows)
    assert {places[r.path, r.row]: (r.keep_id, r.group_size) for r in got} == expected and len(got) == len(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows}) and all(r.id == r.keep_id for r in kept)
    assert exact.kept_rows(docs, classes).columns == ["doc_id", "text", "k", "digest", "row"] and exact.kept_rows(docs, classes).count() == len(kept)


def test_state_goes_on_over_batches_and_calls(spark, tmp_path):
    """Rows that arrive later meet the state of earlier calls; every batch takes a file."""
    df = spark.createDataFrame([(i, f"t{i % 5}") for i in range(40, 0, -1)], "doc_id long, text string").repartition(4)
    df.where("doc_id > 20").write.parquet(f"{tmp_path}/docs/a")
    first = exact.located(spark.read.parquet(f"{tmp_path}/docs/a"))
    one = exact.dedup(first, folder=f"{tmp_path}/state", batch_bytes=1).collect()
    assert sorted({r.keep_id for r in one}) == [21, 22, 23, 24, 25]
    df.where("doc_id <= 20").write.parquet(f"{tmp_path}/docs/b")
    second = exact.located(spark.read.parquet(f"{tmp_path}/docs/b"))
    two = exact.dedup(first.unionByName(second), folder=f"{tmp_path}/state", arrived=second, batch_bytes=1).collect()
    assert len(two) == 40 and sorted({r.keep_id for r in two}) == [1, 2, 3, 4, 5] and {r.group_size for r in two} == {8}


def test_empty(spark):
    docs = exact.located(spark.createDataFrame([], "doc_id long, text string"))
    assert exact.dedup(docs).count() == 0


def test_query_runs_no_python(spark):
    plan = queries.op3_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_kept_rows_are_told_by_marks_or_by_a_join(spark, monkeypatch, most):
    """Several files, marks on every kind of place in a word of bits, columns called as the marks."""
    monkeypatch.setattr(rows, "MARK_BYTES", most)
    df = spark.range(700).select(F.col("id").alias("doc_id"), (F.col("id") % 450).cast("string").alias("text"), F.lit("x").alias("_bits_gone"), F.lit(1).alias("path")).repartition(3)
    docs = exact.located(materialized(df))
    kept = exact.kept_rows(docs, exact.dedup(docs))
    assert kept.columns == ["doc_id", "text", "_bits_gone", "path"] and sorted(r.doc_id for r in kept.collect()) == list(range(450))
    assert exact.kept_rows(docs.limit(0), exact.dedup(exact.located(df.limit(0)))).count() == 0
