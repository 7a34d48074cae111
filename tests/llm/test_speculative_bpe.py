"""Speculative BPE against the tokenizers library, and its pair test against merging on small vocabularies."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from cohortlens.llm import queries
from cohortlens.llm.speculative_bpe import PATTERN, SCANNED, Codec, Tokenizer, Vocabulary, has_later, packed

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "  two  spaces \n\n", "aaaaaaaaaaaaaaa", "-" * 301, "=" * 64, "l'été n'est pas fini", "中文没有空格", "😀😀 ok", "x" * 70_000,
    "a<|endoftext|>b<|endoftext|>", "<|endof", "\U00016EA0՘ 1՘", "'s's 're", "\x00\x7f\xa0　", "the cat sat on the mat " * 5000, "1234567890 12,345",
]


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return Codec(Vocabulary.read(PATH))


def ids_of(codec, texts):
    ids, counts = codec.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_ids_are_the_librarys(own, library):
    rng = random.Random(5)
    signs = ["a", "b", "e", "t", " ", "  ", "\n", "-", "é", "中", "😀", "'s", "<|endoftext|>", "ing", "th", "1", "_", " ", "\U00016EA0", "՘", "."]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1000), rng.randint(0x4E00, 0x9FFF)])) for _ in range(60)) for _ in range(500)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(own, texts) == want
    assert [own.decode(np.array(i, np.int64)) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]
    assert 0 < own.merged_words < own.words  # both ways were taken


def test_bytes_that_are_no_text(own, library):
    ids = library.encode("é😀", add_special_tokens=False).ids
    for cut in (ids[:-1], ids[::-1], ids[1:]):
        assert own.decode(np.array(cut, np.int64)) == library.decode(cut, skip_special_tokens=False)
    with pytest.raises(ValueError):
        own.decode(np.array([len(own.entries)]))


def test_cuts_like_the_library(own, library):
    """Any code point beside letters, numbers, spaces and itself."""
    rng = random.Random(1)
    for cp in [*range(0x3000), *rng.sample(range(0x3000, 0xD800), 3000), *range(0x10900, 0x10F00), *range(0x16E00, 0x17000), *range(0x1E600, 0x1E800)]:
        c = chr(cp)
        text = f"a{c}1{c} {c}{c}  {c}"
        cut = own.cut if not own.later.search(text) else own.careful
        assert [m.span() for m in cut.finditer(text)] == [at for _, at in library.pre_tokenizer.pre_tokenize_str(text)], hex(cp)


def small(rng, letters, merges):
    """A random vocabulary over all bytes whose merges join what is there."""
    tokens = {bytes([b]): b for b in range(256)}
    have, pairs = [c.encode() for c in letters], []
    while len(pairs) < merges:
        a, b = rng.choice(have), rng.choice(have)
        if a + b not in tokens:
            tokens[a + b] = len(tokens)
            have.append(a + b)
            pairs.append((a, b))
    return Vocabulary.of(tokens, pairs, {})


def by_scanning(vocabulary, word):
    """Merges one pair at a time: the lowest rank, then the leftmost."""
    rank = {tuple(p): (r, i) for i, (p, r) in enumerate(zip(vocabulary.parts.tolist(), vocabulary.born.tolist())) if r >= 0}
    part = list(word)
    while found := [(*rank[p], i) for i, p in enumerate(zip(part, part[1:])) if p in rank]:
        _, made, i = min(found, key=lambda f: (f[0], f[2]))
        part[i : i + 2] = [made]
    return part


@pytest.mark.parametrize("seed", range(12))
def test_pairs_decide_on_small_vocabularies(seed):
    """Runs of few letters, where equal merges overlap, and tokens that merging never gives."""
    rng = random.Random(seed)
    codec = Codec(small(rng, "ab" if seed % 2 else "abc", 12))
    v = codec.vocabulary
    sound = [i for i in range(len(v.entries)) if codec.pairs.sound[i] and set(v.entries[i]) <= set(b"abc")]
    assert all((by_scanning(v, e) == [i]) == codec.pairs.sound[i] for i, e in enumerate(v.entries))
    a, b = map(np.array, zip(*[(x, y) for x in sound for y in sound]))
    assert codec.pairs.compatible(a, b).tolist() == [by_scanning(v, v.entries[x] + v.entries[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        got = np.frombuffer(codec.learned([word])[word], np.uint32).tolist()
        assert got == by_scanning(v, word.encode()) == codec.merged(word.encode()) == codec._merged_long([codec.byte[x] for x in word.encode()])


@pytest.mark.parametrize("seed", range(4))
def test_failing_words_are_merged_together(seed, monkeypatch):
    """All at once gives what one at a time does, and no short word is merged alone."""
    rng = random.Random(seed)
    codec = Codec(small(rng, "ab" if seed % 2 else "abc", 12))
    words = ["".join(rng.choices("abc", k=rng.choice([1, 2, 5, 20, SCANNED, SCANNED + 1, 90]))).encode() for _ in range(500)]
    want = [codec.merged(w) for w in words]
    assert [np.frombuffer(x, np.uint32).tolist() for x in codec.merged_all(words)] == want
    assert codec.merged_all([]) == []
    monkeypatch.setattr("cohortlens.llm.speculative_bpe.TOGETHER", 7)
    alone = []
    monkeypatch.setattr(codec, "merged", lambda w, merged=codec.merged: alone.append(len(w)) or merged(w))
    got = codec.learned([w.decode() for w in words])
    assert [np.frombuffer(got[w.decode()], np.uint32).tolist() for w in words] == want
    assert codec.merged_words >= len(alone) and min(alone, default=SCANNED + 1) > SCANNED


def test_later_code_points(own, monkeypatch):
    monkeypatch.setattr("cohortlens.llm.speculative_bpe.LOOKED_UP", 2)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert [c for c in points if has_later(c)] == own.later.findall("".join(points))
    assert has_later("ab\u0558") and has_later("abc\u0558d") and not has_later("abéd") and not has_later("")


def test_vocabularies_that_pairs_cannot_decide():
    tokens = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}
    with pytest.raises(ValueError):
        Vocabulary.of(tokens, [(b"ab", b"c"), (b"a", b"b"), (b"b", b"c")], {})  # before its part
    with pytest.raises(ValueError):
        Vocabulary.of(tokens, [(b"a", b"b"), (b"b", b"c"), (b"ab", b"c"), (b"a", b"bc")], {})  # made twice


def test_columns(spark, library):
    """Whole texts of any length, null as empty, repeated rows, columns of clashing names, no rows."""
    rows = [(i, t, "d", "b") for i, t in enumerate([*TEXTS, TEXTS[4]])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, data string, back string").repartition(3)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    for r in packed(df, PATH).collect():
        assert np.frombuffer(r.data, "<u4").tolist() == want[r.doc_id] and r.back == (rows[r.doc_id][1] or "")
    tokenizer = Tokenizer(spark, PATH)
    ids = df.select("doc_id", tokenizer.encode("text").alias("ids")).withColumn("text", tokenizer.decode("ids"))
    assert {r.doc_id: (r.ids, r.text) for r in ids.collect()} == {i: (want[i], rows[i][1] or "") for i in want}
    assert packed(df.limit(0), PATH).collect() == []


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    sha = lambda data: hashlib.sha256(data).hexdigest()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_speculative_bpe(spark, d).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back.encode()))


def test_pattern_is_the_files(library):
    assert PATTERN == public_tokenizers.PATTERN
