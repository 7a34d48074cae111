"""Kernels against sets in plain Python, and accuracy on documents that were not learned from."""

import zlib

import numpy as np
import pytest

from cohortlens.llm import language as L
from cohortlens.llm import queries


def ngrams(text):
    folded = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode())
    data = b" " + b" ".join(folded.split()) + b" "
    return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


TEXTS = ["The end.", "Größe über alles!", "ñ", "a" * 5000, "être ou ne pas être 42", "x y " * 100_000]


def test_kernels_are_normalised_intersections(monkeypatch):
    grams = L.Grams()
    sets = [grams(t) for t in TEXTS]
    assert [len(s) for s in sets] == [len(ngrams(t)) for t in TEXTS]
    monkeypatch.setattr(L, "BLOCK", 7)  # blocks do not change the result
    assert all(set(grams(t)) == set(s.tolist()) for t, s in zip(TEXTS[:5], sets))
    model = L.fitted(TEXTS[:4], ["a", "b", "a", "b"], landmarks=2)
    order = [0, 2, 1, 3]
    expected = [[len(ngrams(t) & ngrams(TEXTS[i])) / (len(ngrams(t)) * len(ngrams(TEXTS[i]))) ** 0.5 for i in order] for t in TEXTS]
    assert np.allclose(model.kernels(sets), expected, atol=1e-5)


def test_with_all_texts_as_landmarks_it_is_kernel_ridge_regression():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcde " if i % 2 else "defgh "), 40)) for i in range(30)]
    labels = ["x" if i % 2 else "y" for i in range(30)]
    model = L.fitted(texts, labels, landmarks=30)
    grams = L.Grams()
    sets = [grams(t) for t in texts]
    k = np.array([[len(np.intersect1d(a, b)) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets]) + 1  # the bias is a constant kernel
    y = np.where(np.array(labels) == "x", 1.0, -1.0)
    exact = k @ np.linalg.solve(k + L.RIDGE * np.eye(30), y)
    assert np.allclose(model.values(sets)[:, 0], exact, atol=0.02)


@pytest.mark.parametrize("text", [None, "", "123 ### \n", "…"])
def test_nothing_to_tell(text):
    langs, scores = L.predicted(L.fitted(["abc def", "xyz uvw"], ["a", "b"]), [text])
    assert langs == ["und"] and scores.tolist() == [0.0]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op7_language_id(spark, d).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_odd_tables(spark):
    rows = [(None, "the cat sat on the mat again", "en", 1), (5, "der Hund liegt auf dem Sofa", "de", 2), (5, "der Hund liegt auf dem Sofa", "de", 2), (7, None, "de", 3), (8, "la casa es de mi padre ahora", None, 4)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    assert L.identified(df).count() == len(rows)
    assert L.identified(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identified(df.where("lang is null")).collect()} == {"und"}


def test_languages_of_long_or_short_texts_only(spark):
    rows = [(i, "der Hund liegt auf dem Sofa " * 1_000, "de") for i in range(3)] + [(i, "el gato", "es") for i in range(3, 6)] + [(i, "the cat sat on the mat again", "en") for i in range(6, 9)]
    df = spark.createDataFrame(rows + [(9, "1 2 3 " * 9, "xx")], "doc_id long, text string, lang string")
    model = L.fit(df)
    assert model.langs == ["de", "en", "es"]  # there is no letter to learn xx from
    assert L.predicted(model, [t for _, t, _ in rows])[0] == [g for *_, g in rows]
