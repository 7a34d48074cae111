"""Near-duplicates by weighted MinHash over multisets of word shingles (BagMinHash).

A text is the multiset of its five-word shingles. Every shingle with weight w owns Poisson
processes on the discretised weight axis, one per dyadic interval [0, 1), [1, 2), [2, 4), ...
that begins below w; a point carries a time, a component of the signature and, found by
descending the interval's halves, a unit of weight, and counts if that unit is below w. The
earliest point of each component is the signature, so two texts agree in a component with a
probability equal to their weighted Jaccard similarity. Points are made in order of time up
to a horizon that fills all components, so the work per text is about that of its shingles.

Signatures are cut into bands; texts that share a band are candidates, and every link is
verified by the overlap of the two multisets. Groups are never paired with themselves: a
bucket's members are compared with a leader, and only what that leaves in different
components is compared further, large buckets by their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.exact import located
from cohortlens.llm.rows import RowMarks, small_batches, small_enough
from cohortlens.session import materialized

WORDS, SIMILARITY = 5, 0.8
#: 32 bands of 4: a pair at 0.8 shares no band with a probability of 5e-8.
BANDS, ROWS = 32, 4
#: A bucket with more members than this that leaders leave in several components goes on by rare shingles.
PAIRED = 24
#: 64-bit words of a parity sketch: texts of a few thousand shingles differ in about as many bits as in shingles.
WORDS64 = 16
#: Slots in which the frequencies of shingles are counted where rare ones are sought: 4 MB of counts.
SLOTS = 1 << 20
#: Parts of the slots that are added up in one place each; a task gives a row for each.
SLOT_PARTS = 16
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of a text, with repeats; of fewer words than a shingle takes, one of all of them."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, np.uint64(size))
        for j in range(size):
            out = mixed(out * GOLDEN + h[j : len(h) - size + 1 + j])
    return out


def signatures(bags: list[np.ndarray], m: int) -> np.ndarray:
    """Bag x component fingerprints; 0 in every component for an empty bag."""
    counted = [np.unique(b, return_counts=True) for b in bags]
    bag = np.repeat(np.arange(len(bags)), [len(c[0]) for c in counted])
    key = np.concatenate([np.empty(0, np.uint64), *(c[0] for c in counted)])
    weight = np.concatenate([np.empty(0, np.int64), *(c[1] for c in counted)])
    total = np.array([len(b) for b in bags], np.float64)
    out = np.zeros(len(bags) * m, np.uint64)
    best = np.full(len(bags) * m, np.inf)
    # one process per dyadic interval that starts below the weight
    steps = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    p = np.repeat(np.arange(len(key)), steps)
    level = np.arange(len(p)) - np.repeat(np.cumsum(steps) - steps, steps)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)  # also the rate
    with np.errstate(over="ignore"):
        seed = mixed(key[p] + level.astype(np.uint64) * GOLDEN)
    bag, weight = bag[p], weight[p]
    horizon = (log(m) + 4) / np.maximum(total, 1)
    time, count = np.zeros(len(p)), np.zeros(len(p), np.uint64)
    todo = np.arange(len(p))
    while len(todo):
        live = todo
        waiting = []
        while len(live):
            with np.errstate(over="ignore"):
                a = mixed(seed[live] + (2 * count[live] + np.uint64(1)) * GOLDEN)
                b = mixed(seed[live] + (2 * count[live] + np.uint64(2)) * GOLDEN)
            then = time[live] - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width[live])
            due = then <= horizon[bag[live]]
            waiting.append(live[~due])
            live, then, b, a = live[due], then[due], b[due], a[due]
            time[live] = then
            count[live] += np.uint64(1)
            unit = low[live] + ((b >> np.uint64(40)).astype(np.int64) * width[live] >> 24)
            counts = unit < weight[live]
            cell = bag[live][counts] * m + (b[counts] & np.uint64(0xFFFFFF)).astype(np.int64) % m
            order = np.argsort(-then[counts], kind="stable")  # of several the earliest is assigned last
            cell, then, print_ = cell[order], then[counts][order], a[counts][order]
            sooner = then < best[cell]
            best[cell[sooner]], out[cell[sooner]] = then[sooner], print_[sooner]
        open_ = ~np.isfinite(best.reshape(len(bags), m)).all(axis=1) if len(bags) else np.zeros(0, bool)
        horizon = np.where(open_, horizon * 1.6, horizon)
        rest = np.concatenate(waiting)
        todo = rest[open_[bag[rest]]]
    return out.reshape(len(bags), m)


def bands_of(signature: np.ndarray, bands: int) -> np.ndarray:
    """Bag x band keys: the rows of a band and its number, hashed."""
    parts = signature.reshape(len(signature), bands, -1)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), parts.shape[:2])
        for j in range(parts.shape[2]):
            out = mixed(out * GOLDEN + parts[:, :, j])
    return out.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays with repeats: least over greatest counts."""
    (ka, na), (kb, nb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    common = int(np.minimum(na[ia], nb[ib]).sum())
    return common / max(1, len(a) + len(b) - common)


def portions(texts: pa.Array, limit: int = 1 << 19) -> Iterator[list[bytes]]:
    """The texts of a batch, some ``limit`` bytes at a time, so that what is made of them stays small."""
    part, held = [], 0
    for t in texts:
        part.append(t.as_py())
        held += len(part[-1])
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def prefix(bag: np.ndarray, often: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """``rarest``, and how often the slot of each item occurs."""
    n = len(bag)
    repeat = (np.arange(n) - np.searchsorted(bag, bag)).astype(np.uint64)
    with np.errstate(over="ignore"):
        items = mixed(bag.view(np.uint64) + repeat * GOLDEN).view(np.int64)
    counts = often[bag & (len(often) - 1)]
    order = np.lexsort((items, counts))[: n - ceil(similarity * n - 1e-9) + 1]
    return items[order], counts[order]


def rarest(bag: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The first n - ceil(t n) + 1 items of a sorted bag of n, by how often their slot occurs; repeats are items of their own."""
    return prefix(bag, often, similarity)[0]


def parity(bag: np.ndarray) -> np.ndarray:
    """Bits of whether the number of items that fall on each bit is odd.

    An item that only one of two bags has turns one bit over, so the bags differ in at least as
    many items, repeats counted, as their sketches differ in bits.
    """
    bits = np.bincount((mixed(bag.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % (64 * WORDS64), minlength=64 * WORDS64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _signed(text: Column, size: int, bands: int, rows: int) -> Column:
    """struct(copy, n, bands) of a text's bytes: a digest of its words, the number of shingles, the band keys."""
    kind = pa.struct([("copy", pa.binary()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("copy binary, n int, bands array<long>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = []
            for part in portions(texts):
                split = [t.split() for t in part]
                bags = [shingles(w, size) for w in split]
                keys = bands_of(signatures(bags, bands * rows), bands)
                copies = [blake2b(b" ".join(w), digest_size=16).digest() for w in split]
                found += [{"copy": c, "n": len(b), "bands": k.tolist() if len(b) else []} for c, b, k in zip(copies, bags, keys, strict=True)]
            yield pa.array(found, kind)

    return sign(F.coalesce(text, F.lit("")).cast("binary"))


def _bag(text: Column, size: int) -> Column:
    """The sorted shingle hashes of a text's bytes, with repeats."""

    @F.arrow_udf("array<long>")
    def sort(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([np.sort(shingles(t.split(), size).view(np.int64)) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return sort(F.coalesce(text, F.lit("")).cast("binary"))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, slots, counts) of the shingles of a task's bags: a row per part of the slots, with those that occur packed."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        np.add.at(counts, batch.column(0).flatten().to_numpy() & (SLOTS - 1), 1)
    yield from _packed(counts, 0)


def _slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with the counts of all tasks added, of slots that occur more than once."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for slots, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            counts[np.frombuffer(slots, np.int32)] += np.frombuffer(n, np.int64)  # each slot is once in a row
    yield from _packed(counts, 1)


def _packed(counts: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    width = SLOTS // SLOT_PARTS
    for part in range(SLOT_PARTS):
        own = counts[part * width : (part + 1) * width]
        slot = np.flatnonzero(own > least)
        if len(slot):
            row = [part], [(slot + part * width).astype(np.int32).tobytes()], [own[slot].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.binary())], ["part", "slots", "counts"])


def _similar(a: str, b: str) -> Column:
    @F.arrow_udf("double")
    def measure(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([overlap(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(left, right, strict=True)], pa.float64())

    return measure(a, b)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that it is connected to.

    Alternates large-star and small-star: edges are turned to the smallest neighbour until
    all of a component point at its root, after about log(nodes) rounds, each written.
    """
    e = materialized(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialized(small.where("u <> v").distinct())
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _stars(e: DataFrame) -> bool:
    """Whether every node that points somewhere points at one node, which points nowhere."""
    return e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


class _Linker:
    """Finds the verified links among candidate nodes; bags are (node, n, bag), written."""

    def __init__(self, bags: DataFrame, similarity: float):
        self.bags, self.similarity = bags, similarity
        self.tested = self.roots = None

    def verify(self, pairs: DataFrame) -> None:
        """Compare pairs (a, b, with na and nb shingles), once each, and merge the components that links connect."""
        near = F.least("na", "nb") >= F.lit(self.similarity) * F.greatest("na", "nb")
        pairs = pairs.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = materialized(pairs)
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        left, right = self.bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), self.bags.select(F.col("node").alias("b"), F.col("bag").alias("y"))
        links = materialized(pairs.join(left, "a").join(right, "b").withColumn("s", _similar("x", "y")).where(F.col("s") >= self.similarity).select("a", "b"))
        if links.isEmpty():
            return
        if self.roots is None:
            self.roots = materialized(components(links))
            return
        known = small_enough(self.roots)
        for end in ("a", "b"):  # links between components
            links = links.join(known.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left")
        merged = components(links.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
        merged = materialized(merged)
        moved = self.roots.join(small_enough(merged.select(F.col("node").alias("root"), F.col("root").alias("_to"))), "root", "left")
        fresh = merged.join(known.select("node"), "node", "left_anti")
        self.roots = materialized(moved.select("node", F.coalesce("_to", "root").alias("root")).unionByName(fresh))

    def open(self, nodes: DataFrame) -> DataFrame:
        """(bucket, ..., node, n, root, size) of the buckets that still lie in more than one component.

        ``nodes`` has a row per node with its ``items``, structs with ``bucket``; components are
        joined to nodes, and buckets taken apart after that.
        """
        own = self._rooted(nodes)
        return self._parted(own.select(*[c for c in own.columns if c != "items"], F.inline("items")))

    def reopen(self, members: DataFrame) -> DataFrame:
        """What ``open`` would give now of the nodes that gave ``members``: buckets only close, so the closed ones are not taken apart again."""
        return self._parted(self._rooted(members.drop("root", "size")))

    def _rooted(self, nodes: DataFrame) -> DataFrame:
        if self.roots is None:
            return nodes.withColumn("root", F.col("node"))
        return nodes.join(small_enough(self.roots), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def _parted(self, rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi")
        return materialized(rows.join(small_enough(materialized(sizes.drop("_lo", "_hi"))), "bucket"))

    def led(self, members: DataFrame) -> DataFrame:
        """Pairs of every member of a bucket with one of its members, unless their component is the same."""
        order = F.struct(F.xxhash64("node"), "node", "n", "root")
        leaders = members.groupBy("bucket").agg(F.min(order).alias("l")).select("bucket", F.col("l.node").alias("a"), F.col("l.n").alias("na"), F.col("l.root").alias("ra"))
        pairs = members.join(leaders, "bucket").where("root <> ra")
        return pairs.select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb"))

    def across(self, members: DataFrame) -> DataFrame:
        """Pairs of the members of a bucket that are in different components."""
        other = members.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
        pairs = members.join(other, "bucket").where("node < b and root <> rb")
        return pairs.select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb")

    def rare(self, nodes: DataFrame) -> DataFrame:
        """(node, n, sketch, items): nodes with the rarest of their shingles among them, repeats numbered, as (bucket, place).

        Shingles that are alone in their slot are in no other bag: they keep their place but are not
        among the items, since nothing can meet there.

        Of two bags with similarity t, each shares one of its n - ceil(t n) + 1 first items, in any
        order common to all, with the other's, so no link is lost. Rare shingles come first; how
        rare they are is counted in ``SLOTS`` slots, which need not tell every shingle apart.
        """
        own = materialized(self.bags.join(small_enough(nodes), "node", "left_semi"))
        kind = "part int, slots binary, counts binary"
        sums = own.select("bag").mapInArrow(_slots, kind).repartition(SLOT_PARTS, "part").mapInArrow(_slot_sums, kind)
        often = np.ones(SLOTS, np.int32)
        for row in sums.collect():
            often[np.frombuffer(row["slots"], np.int32)] = np.minimum(np.frombuffer(row["counts"], np.int64), np.iinfo(np.int32).max)
        shared, t = own.sparkSession.sparkContext.broadcast(often), self.similarity
        kind = pa.struct([("items", pa.list_(pa.struct([("bucket", pa.int64()), ("place", pa.int32())]))), ("sketch", pa.list_(pa.int64()))])

        @F.arrow_udf("items array<struct<bucket: bigint, place: int>>, sketch array<bigint>")
        def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for bags in batches:
                bags = [x.values.to_numpy() for x in bags]
                lists = [[{"bucket": b, "place": i} for i, (b, c) in enumerate(zip(*prefix(x, shared.value, t), strict=True), 1) if c > 1] for x in bags]
                yield pa.array([{"items": i, "sketch": parity(x).tolist()} for i, x in zip(lists, bags, strict=True)], kind)

        return materialized(own.select("node", "n", first("bag").alias("_f")).select("node", "n", "_f.*"))

    def placed(self, members: DataFrame) -> DataFrame:
        """``across`` for the buckets of ``rare``, without pairs that cannot be links for where they meet.

        What two bags share is at most one item here and the rest of the shorter side after it.
        For the smaller of two bags that leaves about half of its prefix. Nor without pairs whose
        sketches show that they differ in too many items; so texts that share most of their
        shingles and still are no duplicates are not verified one against all, and no link is lost.
        """
        t = self.similarity
        mine = members.where(F.col("place") <= F.col("n") - F.ceil(F.lit(2 * t / (1 + t)) * F.col("n") - 1e-9) + 1)
        bits = [F.col("sketch")[i].alias(f"s{i}") for i in range(WORDS64)]
        mine = mine.select("bucket", "node", "n", "root", "place", *bits)
        other = members.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("place").alias("pb"), *[c.alias(f"t{i}") for i, c in enumerate(bits)])
        order = "(n < nb or (n = nb and node < b)) and root <> rb"
        enough = 1 + F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb")) >= F.lit(t / (1 + t)) * (F.col("n") + F.col("nb")) - 1e-9
        differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(WORDS64)), F.lit(0))
        alike = differ <= F.lit((1 - t) / (1 + t)) * (F.col("n") + F.col("nb")) + 1e-9
        pairs = mine.join(other, "bucket").where(F.expr(order) & (F.col("n") >= F.lit(t) * F.col("nb") - 1e-9) & enough & alike)
        return pairs.select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WORDS, similarity: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS, paired: int = PAIRED,
) -> DataFrame:
    """(id, path, row, class_id, class_size, kept) per row of located ``docs``.

    A class holds the texts connected by links of at least ``similarity``, and their copies:
    texts of the same words, also those without any (null counts as empty). Texts with fewer
    words than a shingle takes have one shingle. ``class_id`` is the smallest identifier of the
    class, null only if all are; its row stays, the first by place of equal ones. An empty
    table gives no rows. A link is missed only if its texts share none of the bands. Texts are
    compared whole; one text is signed in one piece, which takes some hundred bytes a word. Other
    columns of ``docs`` are not read, whatever their names.
    """
    spark = small_batches(docs.sparkSession)
    signed = docs.select(F.col(f"`{id}`").alias("id"), F.col("_path").alias("path"), F.col("_row").alias("row"), _signed(F.col(f"`{text}`"), size, bands, rows).alias("s"))
    signed = materialized(signed.select("id", "path", "row", F.monotonically_increasing_id().alias("node"), "s.*"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "path", "row")).alias("first")
    copies = materialized(signed.groupBy("copy").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("copies"), first))
    reps = signed.join(copies.select(F.col("rep").alias("node")), "node", "left_semi")
    spread = materialized(reps.select("node", "n", F.explode("bands").alias("bucket")))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").drop("_size")
    members = materialized(spread.join(shared, "bucket").groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("bucket")).alias("items")))
    if members.isEmpty():
        classes = copies.withColumn("root", F.col("rep"))
    else:
        wanted = materialized(signed.join(members.select("node"), "node", "left_semi").select(F.col("path").alias("_path"), F.col("row").alias("_row"), "node", "n"))
        texts = docs.select("_path", "_row", F.col(f"`{text}`").alias("_text"))
        marks = RowMarks(wanted, {"wanted": F.lit(True)})
        if marks.bits is not None:  # only texts that are compared meet the join
            marked, is_set = marks.on(texts)
            texts = marked.where(is_set["wanted"]).select("_path", "_row", "_text")
        bags = materialized(texts.join(small_enough(wanted), ["_path", "_row"]).select("node", "n", _bag(F.col("_text"), size).alias("bag")))
        linker = _Linker(bags, similarity)
        linker.verify(linker.led(linker.open(members)))
        left = linker.open(members)
        large = materialized(left.where(F.col("size") > paired).select("node").distinct())
        pairs = linker.across(left.where(F.col("size") <= paired))
        if large.isEmpty():
            linker.verify(pairs)
        else:
            rare = linker.rare(large)
            met = linker.open(rare)
            linker.verify(pairs.unionByName(linker.led(met)))
            linker.verify(linker.placed(linker.reopen(met)))
        classes = copies.withColumn("root", F.col("rep"))
        if linker.roots is not None:
            classes = copies.join(small_enough(linker.roots.withColumnRenamed("node", "rep")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    whole = classes.groupBy("root").agg(F.min("first").alias("_first"), F.sum("copies").alias("class_size"))
    known = classes.select("copy", "root").join(whole, "root")
    kept = (F.col("path") == F.col("_first.path")) & (F.col("row") == F.col("_first.row"))
    return signed.select("id", "path", "row", "copy").join(known, "copy").select("id", "path", "row", F.col("_first.id").alias("class_id"), "class_size", kept.alias("kept"))
