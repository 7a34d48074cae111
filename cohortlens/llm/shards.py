"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on the ring at many places; a key belongs to the first place clockwise.
A shard takes keys, in ring order, until it is full; those that overflow go on clockwise to
the next shard with room. Rooms add up to the number of rows, so counts differ by one at
most, and a key leaves its ring shard only by overflow, so that a changed number of shards
moves few keys. Only the ring (shards x places entries) is ever in one task: rows are
ranked along it by range partitions, and the placement is a fold over the counts per arc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.rows import running_totals
from cohortlens.session import materialized

#: Places of each shard on the ring: loads before the bound then differ by about 6 percent.
PLACES = 256
#: Bits that name a cell of the ring; a row looks up its cell, then the arc within it.
CELL_SHIFT = 52
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def ring(spark: SparkSession, shards: int, places: int = PLACES) -> DataFrame:
    """(arc, lo, hi, shard, tour) in ring order: an arc, its owner, and the shards met clockwise from it.

    Arc 0 and the last one, which share an owner, meet where the ring closes.
    """
    spots = spark.range(shards * places, numPartitions=1).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.xxhash64((F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards).cast("int")).alias("at")
    )
    spots = spots.agg(F.array_sort(F.collect_list(F.struct("at", "shard"))).alias("spots"))  # shards x places entries
    n = shards * places
    owners = F.transform("spots", lambda s: s.shard)
    arcs = F.transform(
        F.sequence(F.lit(0), F.lit(n)),
        lambda i: F.struct(
            i.alias("arc"),
            F.when(i == 0, F.lit(LOWEST)).otherwise(F.element_at("spots", F.greatest(i, F.lit(1))).at + 1).alias("lo"),
            F.when(i == n, F.lit(HIGHEST)).otherwise(F.element_at("spots", F.least(i + 1, F.lit(n))).at).alias("hi"),
            F.element_at("spots", i % n + 1).shard.alias("shard"),
            F.array_distinct(F.concat(F.slice(owners, i % n + 1, n), F.slice(owners, F.lit(1), i % n))).alias("tour"),
        ),
    )
    return spots.select(F.explode(arcs).alias("a")).select("a.*")


def _placed(counts: DataFrame, shards: int, slack: float) -> DataFrame:
    """(arc, shard, lo, hi, slot): which ranks of an arc go to which shard, from (arc, n, tour).

    A fold over the arcs in ring order; its state is the room left in each shard.
    """
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("arc", "n", "tour"))).alias("arcs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    room = "transform(sequence(0, {k} - 1), s -> {rule})".format(
        k=shards,
        rule=f"total div {shards} + if(s < total % {shards}, 1L, 0L)" if slack == 0 else f"cast(ceil((1 + {slack}D) * total / {shards}) as bigint)",
    )
    fold = """
    aggregate(arcs,
      named_struct('g', 0L, 'room', cap, 'out', cast(array() as array<struct<arc:int,shard:int,lo:bigint,hi:bigint,slot:bigint>>)),
      (s, a) -> aggregate(a.tour,
        named_struct('g', s.g, 'left', a.n, 'room', s.room, 'out', s.out),
        (t, shard) -> if(t.left = 0 or t.room[shard] = 0, t, named_struct(
          'g', t.g + least(t.left, t.room[shard]),
          'left', t.left - least(t.left, t.room[shard]),
          'room', transform(t.room, (r, i) -> if(i = shard, r - least(t.left, r), r)),
          'out', concat(t.out, array(named_struct('arc', a.arc, 'shard', shard, 'lo', t.g, 'hi', t.g + least(t.left, t.room[shard]),
                                                  'slot', cap[shard] - t.room[shard]))))),
        t -> named_struct('g', t.g, 'room', t.room, 'out', t.out)),
      s -> s.out)"""
    return listed.withColumn("cap", F.expr(room)).select(F.inline(F.expr(fold)))


def ring_shards(df: DataFrame, key: str, columns: dict[str, Column], shards: int, places: int = PLACES, slack: float = 0.0) -> DataFrame:
    """(key, the given columns, shard, slot) per row; slots of a shard count from 0 without gaps.

    With ``slack`` 0 the counts of shards differ by one at most; with a larger one a shard holds
    up to (1 + slack) times its share and fewer keys overflow. Rows with equal or null keys have
    one place on the ring, follow one another along it, and overflow alike; which of them comes
    first depends on the input's order when they are otherwise equal. Empty tables give no rows.
    Names of ``columns`` may be those of ``df``; they come from the expressions given, which also say
    what a null text is; no other column is read. Texts play no part in the placing, however long.
    """
    spark = df.sparkSession
    narrow = df.select(
        F.col(f"`{key}`"), *[c.alias(n) for n, c in columns.items()],
        F.xxhash64(f"`{key}`").alias("_at"), F.monotonically_increasing_id().alias("_tie"), F.lit(1).cast("long").alias("_one"),
    )
    ranked = running_totals(materialized(narrow), ["_at", key, "_tie"], {"_g": "_one"})
    arcs = materialized(ring(spark, shards, places))
    cells = arcs.select("arc", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CELL_SHIFT), F.shiftright("hi", CELL_SHIFT))).alias("_cell"))
    located = ranked.withColumn("_cell", F.shiftright("_at", CELL_SHIFT)).join(F.broadcast(cells), "_cell").where("_at between lo and hi").drop("lo", "hi", "_cell")
    located = materialized(located)
    counts = arcs.join(located.groupBy("arc").agg(F.count(F.lit(1)).alias("n")), "arc").select("arc", "n", "tour")
    spans = materialized(_placed(counts, shards, slack))
    out = located.join(F.broadcast(spans), "arc").where("_g >= lo and _g < hi")
    return out.select(F.col(f"`{key}`"), *[F.col(f"`{n}`") for n in columns], "shard", (F.col("slot") + F.col("_g") - F.col("lo")).alias("slot"))
