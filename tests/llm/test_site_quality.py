"""Posteriors against the same sums in plain Python, and the classifier on labels it has not seen."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import queries
from cohortlens.llm import site_quality as S


def brute(rows):
    """rows: (id, host, path, odds). Scores by id."""
    y = [1 / (1 + math.exp(-r[3])) for r in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for r, p in zip(rows, y):
        hosts[r[1]].append(p)
        paths[r[1], r[2]].append(p)
    mean = sum(y) / len(y)

    def worth(groups, above):
        k, n = len(groups), sum(map(len, groups.values()))
        if k < 2 or n <= k:
            return S.MOST
        within = max(1e-9, sum(sum((v - np.mean(g)) ** 2 for v in g) for g in groups.values())) / (n - k)
        between = sum(len(g) * (np.mean(g) - above(key)) ** 2 for key, g in groups.items()) - (k - 1) * within
        between /= max(1e-9, n - sum(len(g) ** 2 for g in groups.values()) / n)
        return min(S.MOST, within / between) if between > 0 else S.MOST

    a, b = worth(hosts, lambda h: mean), worth(paths, lambda key: np.mean(hosts[key[0]]))
    logit = lambda p: math.log(p / (1 - p))
    out = {}
    for r, p in zip(rows, y):
        h = (sum(hosts[r[1]]) - p + a * mean) / (len(hosts[r[1]]) - 1 + a)
        q = (sum(paths[r[1], r[2]]) - p + b * h) / (len(paths[r[1], r[2]]) - 1 + b)
        out[r[0]] = 1 / (1 + math.exp(-(r[3] + logit(min(max(q, 1e-4), 1 - 1e-4)) - logit(mean))))
    return out


def made():
    rng = np.random.default_rng(3)
    rows = []
    for h in range(12):
        level = rng.normal(0, 1.5)
        for k in range(int(rng.integers(1, 40))):
            rows.append((len(rows), f"h{h}" if h else None, f"p{k % 3}" if k % 5 else None, float(level + rng.normal(0, 1))))
    return rows + [(len(rows), "alone", "p", 0.3)]


def test_scores(spark):
    rows = made()
    df = spark.createDataFrame(rows, "id long, host string, path string, odds double")
    got = {r.id: r.score for r in S.scored(df).collect()}
    assert got == pytest.approx(brute(rows))
    assert S.scored(df.limit(0)).count() == 0


def test_a_site_moves_an_undecided_document(spark):
    rows = [(1000 + i, "good", "a", 3.0) for i in range(50)] + [(2000 + i, "bad", "a", -3.0) for i in range(50)] + [(1, "good", "a", 0.0), (2, "bad", "a", 0.0), (3, "new", "a", 0.0)]
    got = {r.id: r.score for r in S.scored(spark.createDataFrame(rows, "id long, host string, path string, odds double")).collect()}
    assert got[1] > 0.8 and got[2] < 0.2 and got[3] == pytest.approx(0.5, abs=0.02)


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 6000")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = S.classified(docs, labels.where("doc_id % 2 = 0"), F.col("source"), F.col("lang"))
    seen = out.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in seen}
    assert kept[1] > 0.99 and kept[0] < 0.03


def test_odd_input(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "a " * 100_000, None), (2, "b", "x"), (2, "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"score": F.lit(1), "_h": F.lit("c"), "kept": F.lit("d")})
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert S.classified(docs, labels, F.col("source"), F.lit(None).cast("string")).count() == len(rows)
    assert S.classified(docs.limit(0), labels.limit(0), F.col("source"), F.col("source")).count() == 0


def test_query(spark):
    got = queries.op6_site_quality(spark, "/root/testdata/sf0.001").collect()
    assert len({r.doc_id for r in got}) == len(got) == 200 and all(0 <= r.score <= 1 for r in got)


def test_good_documents_of_a_language_with_many_poor_ones_stay(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    quality = labels.groupBy("doc_id").agg(F.min("quality").alias("q"))
    docs = spark.read.parquet(f"{d}/documents.parquet").join(quality, "doc_id", "left")
    poor = (F.col("q") == 0) | ((F.col("q") == 1) & (F.col("doc_id") % 50 == 1))  # a language of the poor, and a few good ones
    docs = docs.withColumn("lang", F.when(poor, "qq").otherwise(F.col("lang"))).drop("q").cache()
    out = S.classified(docs, labels.where("doc_id % 50 <> 1"), F.lit("one host"), F.col("lang"))
    there = out.join(docs.where("lang = 'qq'").select("doc_id"), "doc_id").join(quality, "doc_id").collect()
    good = [r for r in there if r.q == 1]
    assert 0 < 5 * len(good) < len(there) and all(r.path_quality < 0.5 for r in good)
    assert all(r.kept for r in good)
