"""Encoding against the tiktoken library on the same ranks, and exact round trips."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

from cohortlens.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def entries():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def oracle(entries):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(entries)}, special_tokens={})


def test_perfect_hash_is_minimal_and_finds_every_entry(entries):
    perfect = bpe.PerfectHash(entries)
    assert sorted(perfect.key_at.tolist()) == list(range(len(entries)))
    assert perfect.find(entries).tolist() == list(range(len(entries)))


@pytest.mark.parametrize("keys", [[b"a"], [b"a", b"b"], [bytes([i, j]) for i in range(40) for j in range(40)]])
def test_perfect_hash_of_few_keys(keys):
    assert bpe.PerfectHash(keys).find(keys).tolist() == list(range(len(keys)))


ODD = ["", " ", "a" * 70_000, "ab" * 3000, "日本語 \x1c\x85  x\n\n \n", "😀👩‍👩‍👧 it's  I'LL <|endoftext|>", " \t x", "ß" * 999, "  ٣٤ ¾"]


def test_odd_texts(spark, entries, oracle, monkeypatch):
    codec = bpe.Codec(entries, bpe.PerfectHash(entries), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "PIECES", 2)
    ids, counts = codec.encode([*ODD, None])
    expected = [oracle.encode_ordinary(t) for t in ODD] + [[]]
    assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])
    assert codec.decode(ids) == "".join(ODD).encode()


def test_columns(spark):
    rows = [(1, "The end.", "x"), (1, "The end.", "x"), (None, None, None), (2, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decoded(bpe.encoded(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in out.collect()) == [b"", b"", b"The end.", b"The end."]
    assert bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decoded(spark.sql("select array(1, 99999999) ids"), PATH, public_tokenizers.PATTERN).collect()


def test_query_equals_the_library(spark, oracle):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op1_byte_bpe(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = oracle.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
