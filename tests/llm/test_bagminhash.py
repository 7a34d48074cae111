"""Classes against all pairs compared in plain Python; signatures against the similarities they estimate."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import bagminhash as B
from cohortlens.llm import exact, queries


def bag(text, size=5):
    words = [w for w in (text or "").translate({c: " " for c in b"\t\n\x0b\x0c\r"}).split(" ") if w]
    n = min(size, len(words))
    return words, Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def brute(rows, similarity=0.8):
    """Root position of each row: copies and all pairs at the similarity, connected."""
    parsed, root = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = defaultdict(list)
    for i, (words, grams) in enumerate(parsed):
        at[tuple(words)].append(i)
        for g in grams:
            at[g, "gram"].append(i)
    near = Counter()
    for key, own in at.items():
        if key[-1:] == ("gram",):
            for x in range(len(own)):
                for y in range(x):
                    near[own[y], own[x]] += min(parsed[own[x]][1][key[0]], parsed[own[y]][1][key[0]])
        else:
            for i in own:
                root[find(i)] = find(own[0])
    for (i, j), common in near.items():
        if common >= similarity * (parsed[i][1].total() + parsed[j][1].total() - common):
            root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def check(rows, got, places):
    expected = brute(rows)
    groups = defaultdict(list)
    for i, r in enumerate(expected):
        groups[r].append((rows[i][0] is None, rows[i][0] or 0))
    ids = {r: (None if min(own)[0] else min(own)[1], len(own)) for r, own in groups.items()}
    assert {places[r.path, r.row]: (r.class_id, r.class_size) for r in got} == {i: ids[r] for i, r in enumerate(expected)}
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups) and all(r.id == r.class_id for r in got if r.kept)


def made():
    """Groups of edits of one text, of texts that share a long passage, and odd rows."""
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(1 << 40))
    rows = [(None, None), (None, ""), (3, " \n"), (1, "one"), (2, "one"), (9, "a b c d"), (8, "a\tb c  d"), (7, "la " * 3000), (6, "la " * 2900), (5, "la " * 1000)]
    base = [word() for _ in range(150)]
    for i in range(70):  # chains: each pair differs in up to 6 places
        text = list(base)
        for k in rng.integers(0, 150, 3):
            text[k] = word()
        rows.append((100 + i, " ".join(text)))
    passage = " ".join(word() for _ in range(120))
    rows += [(1000 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(120)]
    return rows + [(2000 + i, " ".join(word() for _ in range(int(n)))) for i, n in enumerate(rng.integers(1, 80, 60))]


@pytest.mark.parametrize("paired", [24, 2])
def test_equals_all_pairs(spark, paired):
    rows = made()
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, k int").withColumns({"node": F.lit("x"), "copy": F.lit(1), "path": F.lit(2)})
    docs = exact.located(df)
    places = {(r._path, r._row): r.k for r in docs.select("_path", "_row", "k").collect()}
    check(rows, B.near_duplicates(docs, paired=paired).collect(), places)
    assert B.near_duplicates(exact.located(df.limit(0))).count() == 0


def test_query_equals_all_pairs(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    roots, got = brute(rows), {r.doc_id: r for r in queries.op8_near_dedup(spark, d).collect()}
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(i, least.get(r, i))
    assert {i: got[i].class_id for i, _ in rows} == {i: least[r] for (i, _), r in zip(rows, roots)}


def test_signatures_estimate_weighted_overlap():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**62, 300).astype(np.uint64)
    for differ, left, right in ((60, 1, 1), (60, 7, 4), (150, 1, 16), (10, 100, 99)):
        b = a.copy()
        b[:differ] = rng.integers(0, 2**62, differ).astype(np.uint64)
        x, y = (np.concatenate([v, np.repeat(v[-50:], k)]) for v, k in ((a, left), (b, right)))
        s = B.signatures([x, y, x[:0]], 4096)
        true = B.overlap(np.sort(x), np.sort(y))
        assert abs((s[0] == s[1]).mean() - true) < 5 * (true * (1 - true) / 4096) ** 0.5 and (s[2] == 0).all()


def test_a_signature_does_not_depend_on_its_batch():
    rng = np.random.default_rng(2)
    bags = [rng.integers(0, 2**62, n).astype(np.uint64) for n in (1, 2, 5, 1000, 20_000)]
    together = B.signatures(bags, 128)
    assert all((B.signatures([b], 128)[0] == together[i]).all() for i, b in enumerate(bags))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200)]
    got = {r.node: r.root for r in B.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


def test_prefixes_of_similar_bags_meet():
    """Whatever the order, bags at the similarity share an item of their prefixes."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        base = rng.integers(0, 40, int(rng.integers(1, 60)))
        other = base.copy()
        change = int(rng.integers(0, max(1, len(base) // 8) + 1))
        other[:change] = rng.integers(0, 40, change)
        a, b = np.sort(base) * 7919, np.sort(other) * 7919
        if B.overlap(a, b) >= 0.8:
            often = rng.integers(0, 5, 64)
            assert np.intersect1d(B.rarest(a, often, 0.8), B.rarest(b, often, 0.8)).size


def test_shingles_of_one_text_are_not_taken_apart(spark):
    """Of the rarest shingles only those remain that another bag may have; places stay those of the whole prefix."""
    common = list(range(1000, 1080))
    bags = [(k, 100, sorted(common + [10_000 * (k + 1) + i for i in range(20)])) for k in range(30)] + [(30, 5, [1, 1, 1, 2, 3])]
    linker = B._Linker(spark.createDataFrame(bags, "node long, n int, bag array<long>"), 0.8)
    got = {r.node: r for r in linker.rare(spark.createDataFrame([(b[0],) for b in bags], "node long")).collect()}
    buckets = [{i.bucket for i in got[k]["items"]} for k in range(30)]
    assert all(b == buckets[0] for b in buckets) and len(buckets[0]) == 1
    assert {i.place for k in range(30) for i in got[k]["items"]} == {21}
    assert [i.place for i in got[30]["items"]] == []  # 2 and 3 are alone and come before the repeated 1


def test_sketches_differ_in_no_more_bits_than_bags_in_items():
    rng = np.random.default_rng(6)
    for n in (1, 7, 100, 3000):
        a = np.sort(rng.integers(0, max(2, n // 2), n))
        b = np.sort(np.concatenate([a[rng.random(n) < 0.8], rng.integers(0, n + 1, n // 5)]))
        counts = [np.bincount(x, minlength=n + 1) for x in (a, b)]
        bits = int(np.bitwise_count((B.parity(a) ^ B.parity(b)).view(np.uint64)).sum())
        assert bits <= np.abs(counts[0] - counts[1]).sum() and (n > 7 or bits > 0 or (counts[0] == counts[1]).all())


def test_a_chained_group_verifies_few_pairs(spark, monkeypatch):
    """Edits of one text, some 0.7 alike and linked in chains: verified pairs grow with the texts, not with their square."""
    tested = []
    verify = B._Linker.verify

    def counted(self, pairs):
        verify(self, pairs)
        tested.append(self.tested.count())

    monkeypatch.setattr(B._Linker, "verify", counted)
    per_text = []
    for n in (200, 400):
        rng = np.random.default_rng(9)
        word = lambda: "w" + str(rng.integers(1 << 40))
        base, rows = [word() for _ in range(120)], []
        for i in range(n):
            text = list(base)
            for k in rng.integers(0, 120, 2):
                text[k] = word()
            rows.append((i, " ".join(text)))
        docs = exact.located(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, k int"))
        places = {(r._path, r._row): r.k for r in docs.select("_path", "_row", "k").collect()}
        check(rows, B.near_duplicates(docs).collect(), places)
        per_text.append(tested[-1] / n)
    assert per_text[1] < 60 and per_text[1] < 1.7 * per_text[0]


def test_a_task_counts_slots_in_a_few_rows(spark):
    """However many shingles there are: a row per part of the slots, and the sums are those of all bags."""
    bags = [np.random.default_rng(i).integers(-(2**63), 2**63 - 1, 5000, np.int64) for i in range(12)] * 2
    kind = "part int, slots binary, counts binary"
    frame = spark.createDataFrame([(b.tolist(),) for b in bags], "bag array<bigint>").repartition(6)
    each = frame.mapInArrow(B._slots, kind)
    assert each.count() <= 6 * B.SLOT_PARTS  # before: a row per slot
    got = Counter()
    for row in each.repartition(3, "part").mapInArrow(B._slot_sums, kind).collect():
        got.update(dict(zip(np.frombuffer(row["slots"], np.int32).tolist(), np.frombuffer(row["counts"], np.int64).tolist(), strict=True)))
    want = Counter(np.concatenate([b & (B.SLOTS - 1) for b in bags]).tolist())
    assert got == {s: n for s, n in want.items() if n > 1}
