"""Every stage on its own input, by brute force, and the whole run."""

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import bpe, language
from tests.llm.test_bagminhash import brute as near
from tests.llm.test_exact import brute as copies

D = "/root/testdata/sf0.001"


def oracle():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after every stage."""
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), [("documents", spark.read.parquet(f"{D}/documents.parquet").collect())]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, D).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs.collect()))
    return dict(out)


def test_columns(stages):
    assert all(rows[0].__fields__ == stages["documents"][0].__fields__ for name, rows in stages.items() if name != "byte_bpe")


def test_language_keeps_what_has_letters(stages):
    kept = {r.doc_id for r in stages["language_id"]}
    gone = [r for r in stages["documents"] if r.doc_id not in kept]
    assert all(not language.has_letter(r.text) for r in gone)


def test_exact(stages):
    rows = stages["language_id"]
    keep = copies([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in stages["exact_dedup"]) == sorted({k for k, _ in keep.values()})


def test_near(stages):
    rows = sorted(stages["exact_dedup"])
    first = {}
    for r, root in zip(rows, near([(r.doc_id, r.text) for r in rows])):
        first.setdefault(root, r.doc_id)
    assert sorted(r.doc_id for r in stages["near_dedup"]) == sorted(first.values())


def test_mix_takes_whole_rows(stages):
    before = {r.doc_id: r for r in stages["near_dedup"]}
    assert all(before[r.doc_id] == r for r in stages["source_mix"])
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert words(stages["source_mix"]) == pytest.approx(1.5 * words(before.values()), rel=0.1)


def test_tokens_decode(stages):
    own = oracle()
    texts = {r.doc_id: r.text for r in stages["source_mix"]}
    assert all(r.ids == own.encode_ordinary(texts[r.doc_id]) for r in stages["byte_bpe"])
    assert len(stages["byte_bpe"]) == len(stages["source_mix"]) and all(r.decodes and r.n_tokens == len(r.ids) for r in stages["byte_bpe"])


def test_run(spark, stages):
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, D).collect()) == sorted((r.doc_id, r.n_tokens) for r in stages["byte_bpe"])


def test_empty_and_odd(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "the end of it all", "en", "a", 9)] * 2, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("found", "often", "copy", "id", "path", "node", "kept", "digest", "_path", "_row", "_metadata", "copies", "trusted", "a.b")})
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, D)
            if name != "byte_bpe":
                assert {v for r in out.collect() for c, v in r.asDict().items() if c not in docs.columns[:5]} <= {1}
            assert out.count() <= 2 * max(1, df.count()) and (name == "byte_bpe" or out.columns == df.columns)


def test_without_a_language_to_learn_texts_with_letters_stay(spark):
    texts = ["the end of it all", None, "123 ###", "", "ñ"]
    docs = spark.createDataFrame([(i, t, None, "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.identify(spark, docs, D)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 4]


def test_unlikely_languages_go(spark, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 0.0)
    every = corpus_pipeline.identify(spark, docs, D).count()
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 0.9)
    fewer = corpus_pipeline.identify(spark, docs, D).count()
    assert 0 < fewer < every
