"""Targets against repeated resharing, words taken against targets, and the sample's rules."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import queries
from cohortlens.llm.mixing import mixed, source_targets


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(target[s] - most * sizes[s] for s in open_ if target[s] > most * sizes[s])
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 10, "b": 1000, "é": 5, "B": 70, None: 33}, {"a": 0, "b": 9}, {f"s{i}": i * i + 1 for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df, "source", (5, 2, 1), 1.5, 2.0).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op10_source_mix(spark, d).collect()
    again = queries.op10_source_mix(spark, d).collect()
    assert sorted(rows) == sorted(again) and len(rows) == len(docs)
    by = defaultdict(list)
    for r in rows:
        assert r.size == len([w for w in docs[r.doc_id].text.translate({c: " " for c in b"\t\n\x0b\x0c\r"}).split(" ") if w])
        assert r.taken == r.copies * r.size <= 2 * r.size and r.source == docs[r.doc_id].source
        by[r.source].append(r)
    expected = reshared({s: sum(r.size for r in own) for s, own in by.items()})
    for s, own in by.items():
        assert own[0].target == pytest.approx(expected[s]) and own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
    assert len({r.copies for r in rows}) == 3


def test_inclusion_grows_with_size(spark):
    """Over many seeds, a longer document is taken more often per word."""
    df = spark.createDataFrame([(i, "w " * (2 if i % 2 else 200), "a") for i in range(200)] + [(1000 + i, "w " * 100, "b") for i in range(300)], "doc_id long, text string, source string")
    long = short = 0
    for seed in range(3):
        rows = mixed(df, seed=seed, tilt=1.0, share=0.5).collect()
        long += sum(r.copies for r in rows if r.size == 200)
        short += sum(r.copies for r in rows if r.size == 2)
    assert long > short


def test_nulls_ties_and_empty(spark):
    rows = [(None, None, None)] * 5 + [(1, "a b c", "x")] * 30 + [(2, "", "x"), (3, "a " * 90_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("s"), "target": F.lit(0), "_tie": F.lit(1)})
    got = mixed(df).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    assert mixed(df.limit(0)).count() == 0
