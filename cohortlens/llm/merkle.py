"""Merkle manifest of a dataset, and proofs for its rows by a recursive query.

Every row is a leaf: the hash of its values. The leaves of a group form a tree, in order, and the
roots of the groups form one more. Levels are built bottom up, ``HOP`` of them in one shuffle, and
stored as node rows, each linked to a node ``HOP`` levels above it and holding the siblings on the
way there. A recursive query then ascends from every leaf, node row by node row, appends the
siblings it meets and folds them into the leaf's hash (the altered one, where a row was altered).

All hashes are SHA-256 as lowercase hex text, and hashing several joins their text first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortlens.llm.rows import small_enough
from cohortlens.session import materialized

#: Levels between a stored node and the one it is linked to: a task folds 2 ** HOP nodes of a tree at once.
HOP = 10
#: Bytes of a sibling on a path: its side, ``L``, ``R`` or ``N`` for none, and its hash.
STEP = 33
#: A level with more node rows than this is joined by a shuffle, not broadcast. A row has ``HOP`` siblings at most.
BROADCAST_NODES = 1 << 16
#: The tree of the groups' roots; the groups' own trees are numbered from 0.
ROOTS = -1


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(columns: Sequence[Column]) -> Column:
    """Hash of a row's values: each as its UTF-8 length, a colon and the value as text; ``-`` for null."""
    text = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def numbered(df: DataFrame, within: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``: a row's place, from 0, among the rows of equal ``within``, in ``order``, nulls first.

    Rows are range-partitioned and written, so no task holds more than its range, whatever the
    groups; ``within`` must not be null. Rows equal in ``order`` are placed anyhow.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*within, *order]]
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = materialized(spread.repartitionByRange(*keys, F.col("_tie")).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per range and group that begins in it
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = materialized(counts.select(*within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin")))
    place = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(*keys[len(within) :], "_tie")) - 1
    both = ranged.join(small_enough(begins), [*within, "_range"])
    return both.withColumn(out, F.col("_begin") + place).select(*df.columns, out)


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _folded_up(members: Column, rounds: Column, hop: int) -> Column:
    """All levels of a block, from its members' hashes up; every two consecutive nodes become one, a last one by itself."""
    above = lambda level: F.transform(
        F.sequence(F.lit(0), F.size(level) - 1, F.lit(2)), lambda i: digest(F.get(level, i), F.coalesce(F.get(level, i + 1), F.lit("")))
    )
    steps = F.filter(F.array(*[F.lit(i) for i in range(hop)]), lambda i: i < rounds)
    return F.aggregate(steps, F.array(F.transform(members, lambda m: m["hash"])), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def _siblings(levels: Column, place: Column, rounds: Column, hop: int) -> Column:
    """A member's siblings from its own level up, ``STEP`` bytes each."""

    def sibling(k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(2.0), k)).cast("int")
        beside = F.concat(F.when(at % 2 == 1, F.lit(b"L")).otherwise(F.lit(b"R")), F.unhex(F.get(F.get(levels, k), at + 1 - 2 * (at % 2))))
        return F.coalesce(beside, F.lit(b"N" + bytes(STEP - 1)))

    steps = F.filter(F.array(*[F.lit(i) for i in range(hop)]), lambda i: i < rounds)
    return F.aggregate(steps, F.lit(b""), lambda path, k: F.concat(path, sibling(k)))


def _node(tree: Column, level: Column, place: Column) -> Column:
    """Name of a node; what stands before the first colon tells the kind of tree and the level."""
    kind = F.concat(F.when(tree == ROOTS, "r").otherwise("g"), level.cast("string"))
    return F.concat_ws(":", kind, tree.cast("string"), place.cast("string"))


def _blocks(nodes: DataFrame, level: int, hop: int, payload: Sequence[str]) -> DataFrame:
    """(tree, height, block, hash, payload, node, parent, siblings, top) of the nodes of one level of some trees; written.

    ``nodes`` are (tree, place, height, hash, and the payload); 2 ** hop consecutive ones are a
    block, folded in one row. A node has the name of the node above the block, and its siblings
    on the way there; the first node of a block also has the hash of the block's top.
    """
    rounds = F.least(F.lit(hop), F.col("height") - level)
    members = F.sort_array(F.collect_list(F.struct("place", "hash", *payload)))
    d = nodes.groupBy("tree", "height", F.shiftright("place", hop).alias("block")).agg(members.alias("members"))
    d = d.withColumn("levels", _folded_up(F.col("members"), rounds, hop))
    over = F.when(F.col("height") > level + hop, _node(F.col("tree"), F.lit(level + hop), F.col("block")))
    over = F.when(over.isNotNull(), over).when(F.col("tree") != ROOTS, _node(F.lit(ROOTS), F.lit(0), F.col("tree")))

    def member(m: Column, i: Column) -> Column:
        node = _node(F.col("tree"), F.lit(level), m["place"])
        own = [m[c].alias(c) for c in ("hash", *payload)]
        top = F.when(i == 0, F.get(F.element_at("levels", -1), 0))
        return F.struct(*own, node.alias("node"), over.alias("parent"), _siblings(F.col("levels"), i, rounds, hop).alias("siblings"), top.alias("top"))

    return materialized(d.select("tree", "height", "block", F.inline(F.transform("members", member))))


@dataclass
class Manifest:
    """A built forest: every leaf with its payload, the node rows above them, the groups' trees and the root of all."""

    leaves: DataFrame  # (tree, payload, hash, node, parent, siblings)
    nodes: DataFrame  # (node, parent, siblings) of the stored levels above the leaves
    trees: DataFrame  # (tree, group, n, subroot)
    root: str | None


def build(leaves: DataFrame, group: str, order: Sequence[str], hash: str, payload: Sequence[str], hop: int = HOP) -> Manifest:
    """Build the trees of ``leaves``: one per ``group`` over its rows in ``order``, and one over their roots.

    Groups are ordered as text, null first; rows of equal ``order`` by their hash, so that equal
    rows change nothing. Every ``hop`` levels take one shuffle of that level's nodes.
    """
    spark = leaves.sparkSession
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # never null, in the same order
    narrow = leaves.select(key.alias("_key"), F.col(group).alias("_group"), *[F.col(c) for c in dict.fromkeys([*order, hash, *payload])])
    placed = materialized(numbered(narrow, ["_key"], [*order, hash], "place"))
    sizes = materialized(placed.groupBy("_key").agg(F.first("_group").alias("_group"), F.count(F.lit(1)).alias("n")))
    trees = materialized(numbered(sizes, [], ["_key"], "tree").withColumn("height", _height(F.col("n"))))
    found = trees.agg(F.count(F.lit(1)).alias("n"), F.max("height").alias("most")).first()
    level_nodes = placed.join(small_enough(trees.select("_key", "tree", "height")), "_key").withColumnRenamed(hash, "hash")
    upper, tops, level, low = [], [], 0, None
    while level == 0 or level < (found["most"] or 0):
        blocks = _blocks(level_nodes.select("tree", "place", "height", "hash", *(payload if level == 0 else [])), level, hop, payload if level == 0 else [])
        if level == 0:
            low = blocks.select("tree", "hash", *payload, "node", "parent", "siblings")
        else:
            upper.append(blocks)
        level += hop
        blocks = blocks.where("top is not null")
        tops.append(blocks.where(F.col("height") <= level).select("tree", F.col("top").alias("subroot")))
        level_nodes = blocks.where(F.col("height") > level).select("tree", F.col("block").alias("place"), "height", F.col("top").alias("hash"))
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    trees = materialized(trees.join(small_enough(materialized(subroots)), "tree").select("tree", F.col("_group").alias("group"), "n", "subroot"))
    root, level = None, 0
    level_nodes = trees.select(F.lit(ROOTS).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("hash")).withColumn("height", _height(F.lit(found["n"])))
    while found["n"] and root is None:
        blocks = _blocks(level_nodes.select("tree", "place", "height", "hash"), level, hop, [])
        upper.append(blocks)
        level += hop
        blocks = blocks.where("top is not null")
        if 1 << level >= found["n"]:
            root = blocks.first()["top"]
        level_nodes = blocks.select("tree", F.col("block").alias("place"), "height", F.col("top").alias("hash"))
    nodes = spark.createDataFrame([], "node string, parent string, siblings binary")
    for one in upper:
        nodes = nodes.unionByName(one.select("node", "parent", "siblings"))
    return Manifest(low, materialized(nodes), trees, root)


_PLACES = f"IF(length({{0}}) = 0, array(), sequence(0, length({{0}}) div {STEP} - 1))"
_FOLD = f"""unhex(aggregate({_PLACES.format("{siblings}")}, lower(hex({{start}})), (h, i) -> sha2(CASE CAST(substr({{siblings}}, {STEP} * i + 1, 1) AS STRING)
  WHEN 'L' THEN concat(lower(hex(substr({{siblings}}, {STEP} * i + 2, {STEP - 1}))), h)
  WHEN 'R' THEN concat(h, lower(hex(substr({{siblings}}, {STEP} * i + 2, {STEP - 1})))) ELSE h END, 256)))"""
_HASHES = f"transform({_PLACES.format("siblings")}, i -> IF(substr(siblings, {STEP} * i + 1, 1) = X'4E', '', lower(hex(substr(siblings, {STEP} * i + 2, {STEP - 1})))))"
_CLIMB = """
WITH RECURSIVE climb({names}, at, folded, siblings) AS (
  SELECT {names}, parent, {first}, siblings FROM {{leaves}}
  UNION ALL
  SELECT {mine}, {parent}, {fold}, concat(c.siblings, {step}) FROM climb c {joins}
)
SELECT {names}, folded, siblings FROM climb WHERE at IS NULL"""


def climb(manifest: Manifest, keep: Sequence[str], start: str, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(keep, folded, siblings) per leaf: its siblings from the leaf to the root, and the root that they and ``start`` give, as bytes.

    A recursive query, one step for every stored level. Levels with few node rows are broadcast;
    the keys of a level with many are spread evenly, since each stands for as many leaves as its
    level allows, so it is joined by a shuffle. A leaf whose node is not there takes a key of its own.
    """
    spark = manifest.leaves.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # else an error above a million rows
    kind = F.substring_index("node", ":", 1)
    many = sorted(r["kind"] for r in manifest.nodes.groupBy(kind.alias("kind")).count().where(F.col("count") > broadcast_nodes).collect())
    few = manifest.nodes.where(~kind.isin(many)) if many else manifest.nodes
    tables = {"leaves": manifest.leaves, "few": few}
    if many:
        tables["many"] = manifest.nodes.where(kind.isin(many))
        kinds = ", ".join(f"'{k}'" for k in many)
        apart = "CASE WHEN substring_index(c.at, ':', 1) IN (" + kinds + ") THEN c.at ELSE concat('-', hex(c.folded)) END"
        joins = f"LEFT JOIN {{many}} m ON m.node = {apart} LEFT JOIN {{few}} f ON f.node = c.at WHERE c.at IS NOT NULL"
        step, parent = "coalesce(m.siblings, f.siblings)", "CASE WHEN m.node IS NOT NULL THEN m.parent ELSE f.parent END"
    else:
        joins, step, parent = "JOIN {few} f ON f.node = c.at", "f.siblings", "f.parent"
    hint = "/*+ BROADCAST(f) */ "
    text = _CLIMB.format(
        names=", ".join(keep), mine=hint + ", ".join(f"c.{c}" for c in keep), first=_FOLD.format(siblings="siblings", start=start),
        parent=parent, fold=_FOLD.format(siblings=step, start="c.folded"), step=step, joins=joins,
    )
    return spark.sql(text, **tables)


def proved(
    df: DataFrame, columns: Sequence[str], id: str = "doc_id", group: str = "lang", altered: Mapping[str, Column] | None = None,
    where: Column | None = None, hop: int = HOP, broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """(id, leaf, subroot, root, siblings, folded_root, verified) per row of ``df``, with a proof against the root.

    ``siblings`` go from the leaf's level to that below the root; where a node has none, there is an empty one.

    The manifest is of the rows as they are. The proof starts from the row in which, ``where``
    that holds, ``altered`` columns have another value, so an altered row does not verify, and a
    row that alteration leaves as it is (a null stays null) does. Null groups are a group of their
    own, before all others; null identifiers come first in their group; rows of one identifier are
    ordered by their hash, and equal rows have equal proofs up to their places. Texts are hashed whole, on the
    JVM. Columns other than ``columns``, ``id`` and ``group`` are not read, whatever their names.
    An empty table gives no rows.
    """
    changed = dict(altered or {})
    own = leaf([F.col(f"`{c}`") for c in columns])
    other = F.when(F.lit(False) if where is None else where, leaf([changed.get(c, F.col(f"`{c}`")) for c in columns]))
    leaves = materialized(df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{group}`").alias("_lang"), own.alias("_leaf"), other.alias("_other")))
    made = build(leaves, "_lang", ["_id"], "_leaf", ["_id", "_other"], hop)
    made.leaves = made.leaves.withColumns({"hash": F.unhex("hash"), "_other": F.unhex("_other")})  # half the bytes, while they climb
    paths = climb(made, ["tree", "_id", "hash"], "coalesce(_other, hash)", broadcast_nodes)
    root = F.lit(made.root).cast("string")
    text = lambda c: F.lower(F.hex(c))
    out = paths.join(small_enough(made.trees.select("tree", "subroot")), "tree")
    return out.select(
        F.col("_id").alias(id), text("hash").alias("leaf"), "subroot", root.alias("root"), F.expr(_HASHES).alias("siblings"),
        text("folded").alias("folded_root"), (text("folded") == root).alias("verified"),
    )
