"""Counts and ratios against plain Python, over odd texts and the registered query."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import queries
from cohortlens.llm import quality_rules as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


ODD = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a b a a a", "x\nx\n x\n\nx\r\nx", "#é|😀 $\n#é|😀 $", "la " * 40_000, "a b c d a b c e a b c", "w1 w2 w3 " * 30]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_words string").withColumn("_w", F.lit(1))
    got = {r.doc_id: r for r in Q.judged(df, F.lit(None).cast("boolean")).collect()}
    for i, t in enumerate(ODD):
        r, n = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and r.ratio == pytest.approx(0.0)
        assert r.kept == (not r.base_failed)
    assert Q.judged(df.limit(0), F.lit(True)).count() == 0


def test_hashes_that_differ_in_upper_bits_only(spark):
    """A place takes bits of the packed number; windows whose hashes differ only there are not repeats."""
    far = [k << 60 for k in range(-8, 8)]
    cases = [[1, 1 + (1 << 62), 5], [1, 1 + (1 << 62), 1], far, far + far[3:5], far * 2, [7, 7], [-1, (1 << 63) - 1] * 3 + [0], [3, 4, 5] * 9]
    df = spark.createDataFrame(list(enumerate(cases)), "id long, w array<long>")
    got = {r.id: r.n for r in df.select("id", Q._covered(F.col("w")).alias("n")).collect()}
    assert got == {i: len({k + j for k, x in enumerate(w) if w.count(x) > 1 for j in range(3)}) for i, w in enumerate(cases)}


def test_ratio(spark):
    """With the buckets that Spark gives words and pairs, the ratio follows from counts."""
    texts = ["good fine words here", "good fine words there", "bad worse ### words", "bad bad bad"] * 3
    df = spark.createDataFrame([(i, t, i % 4 < 2) for i, t in enumerate(texts)], "doc_id long, text string, good boolean")
    grams = {r.doc_id: r.g for r in df.select("doc_id", Q.grams(Q.word_hashes(F.col("text")), 64).alias("g")).collect()}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        target.update(g if i % 4 < 2 else [])
    p = {b: (target[b] + raw[b] / raw.total() * 64) / (target.total() + 64) for b in raw}
    expected = {i: sum(math.log(p[b] * raw.total() / raw[b]) for b in g) / len(g) for i, g in grams.items()}
    got = {r.doc_id: r.ratio for r in Q.judged(df, F.col("good"), buckets=64).collect()}
    assert got == pytest.approx(expected) and all((got[i] > 0) == (i % 4 < 2) for i in got)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    df = queries.op5_quality_rules(spark, d)
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
    good = [r.kept for r in rows if r.doc_id in labels and labels[r.doc_id].quality and not labels[r.doc_id].toxic and not r.base_failed]
    poor = [r.kept for r in rows if r.doc_id in labels and not labels[r.doc_id].quality]
    assert sum(good) > 0.98 * len(good) and sum(poor) < 0.1 * len(poor)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


D = "/root/testdata/sf0.001"


def test_query_with_columns_called_as_those_that_are_added(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    docs.withColumns({c: F.lit(True) for c in ("trusted", "ratio", "kept", "n_words", "_hashes")}).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: r.doc_id
    assert sorted(queries.op5_quality_rules(spark, str(tmp_path)).collect(), key=key) == sorted(queries.op5_quality_rules(spark, D).collect(), key=key)
