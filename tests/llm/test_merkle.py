"""Merkle manifest against plain Python, with nulls, ties, lone leaves, hot groups and joins by shuffle."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import merkle

COLUMNS = ["doc_id", "lang", "n_chars", "text"]
SCHEMA = "doc_id bigint, lang string, n_chars int, text string, tree string, _key string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(of, place):
    out = []
    for level in of[:-1]:
        out.append((place % 2, level[place ^ 1] if place ^ 1 < len(level) else ""))
        place //= 2
    return out


def brute(rows, altered):
    """Per row (doc_id, leaf, subroot, root, siblings, folded root), in any order."""
    groups = defaultdict(list)
    for r in rows:
        own = h(*map(value, r))
        other = h(*map(value, (r[0], r[1], None if r[2] is None else r[2] + 1, r[3]))) if altered(r) else own
        groups[r[1]].append((r[0] is not None, r[0] or 0, own, other, r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, (_, _, own, folded, id) in enumerate(sorted(groups[g])):
            siblings = path(trees[g], i) + path(top, k)
            for right, s in siblings:
                folded = h(s, folded) if right else h(folded, s)
            yield id, own, trees[g][-1][0], top[-1][0], tuple(s for _, s in siblings), folded


def rows_of(kind):
    if kind == "mixed":  # null and equal identifiers, null groups, lone leaves, a hot group, long and empty texts
        rows = [(i, "hot", i % 5 or None, f"text {i}") for i in range(75)] + [(3, "hot", 1, "again"), (3, "hot", 1, "again"), (None, "hot", None, None)]
        return rows + [(i, None, 2, "") for i in range(80, 89)] + [(100, "ü", 3, "é" * 200_000), (101, "a", None, None), (None, None, None, None)]
    return {"one group": [(i, "en", i, "x") for i in range(17)], "one row": [(7, None, 1, "x")], "two": [(1, "b", 1, "x"), (2, "a", 1, "x")]}[kind]


@pytest.mark.parametrize("kind, hop, few", [("mixed", 2, 3), ("mixed", 8, 1 << 16), ("one group", 1, 0), ("one row", 8, 1 << 16), ("two", 3, 1 << 16)])
def test_equals_brute_force(spark, kind, hop, few):
    rows = rows_of(kind)
    df = spark.createDataFrame([(*r, "mine", "other") for r in rows], SCHEMA).repartition(3)
    hit = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    out = merkle.proved(df, COLUMNS, altered={"n_chars": F.col("n_chars") + 1}, where=hit, hop=hop, broadcast_nodes=few).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, tuple(r.siblings), r.folded_root) for r in out]
    want = list(brute(rows, lambda r: r[0] is not None and r[0] % 3 == 0))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    changed = {i for i, _, n, _ in rows if i is not None and i % 3 == 0 and n is not None}
    assert {r.doc_id for r in out if not r.verified} == changed
    assert all(r.verified == (r.folded_root == r.root) for r in out)


def test_empty_table(spark):
    assert merkle.proved(spark.createDataFrame([], SCHEMA), COLUMNS).collect() == []


def test_levels_are_linked(spark):
    """Every node row but the root's names a stored node above it, and a level has a row per node."""
    df = spark.createDataFrame([(i, "en" if i % 3 else "de", 1, str(i), "", "") for i in range(60)], SCHEMA)
    made = merkle.build(df.withColumn("h", merkle.leaf([F.col(c) for c in COLUMNS])), "lang", ["doc_id"], "h", [], hop=2)
    nodes = {r.node: r.parent for r in made.nodes.collect()}
    assert sum(p is None for p in nodes.values()) == 2  # the two subroots are leaves of the last tree, one step below the root
    assert all(p in nodes for p in [*nodes.values(), *(r.parent for r in made.leaves.collect())] if p is not None)
    assert sum(n.startswith("g2:0:") for n in nodes) == 5 and sum(n.startswith("g2:1:") for n in nodes) == 10
