"""Mixing sources to target weights by Pareto order sampling.

Each source has a target of words. Within a source every document expects some copies, more
for longer ones; the whole part is allocated for certain, the rest is an inclusion
probability p. Documents are ranked by the Pareto value (u / (1 - u)) / (p / (1 - p)), u a
hash of the identifier, and taken from the lowest up to a fixed number of words: a
fixed-size sample with unequal probabilities that is the same on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.rows import running_totals, small_enough, word_count
from cohortlens.session import materialized

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: How much the expected copies grow with each doubling of a document's words.
TILT = 0.125


def filled(df: DataFrame, by: list[str], cap: str, weight: str, total: Column, size: str | None = None) -> DataFrame:
    """``df`` with ``level``: the x at which the least of weight * x and cap adds up to ``total`` in each group.

    Sorted by cap / weight, those at their cap come first; x follows from the first that is
    not. With ``size``, a row counts that many times. Groups are small tables of groups.
    """
    w = Window.partitionBy(*by)
    order = w.orderBy(F.col(cap) / F.col(weight), "_row")
    times = F.col(size) if size else F.lit(1.0)
    d = df.withColumn("_row", F.monotonically_increasing_id())
    d = d.withColumn("_capped", F.coalesce(F.sum(F.col(cap) * times).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("_rest", F.sum(F.col(weight) * times).over(order.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("_x", (total - F.col("_capped")) / F.nullif(F.col("_rest"), F.lit(0.0)))
    free = F.when(F.col(cap) / F.col(weight) > F.col("_x"), F.struct((F.col(cap) / F.col(weight)).alias("r"), F.col("_x").alias("x")))
    return d.withColumn("level", F.min(free).over(w)["x"]).drop("_row", "_capped", "_rest", "_x")


def source_targets(sizes: DataFrame, source: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above ``most`` times its size.

    One row per source, and all of them pass through one task, which numbers and fills them: for as
    many sources as one task sorts, not for a source per site. Sources are in code point order,
    null last; weights repeat.
    """
    turn = (F.row_number().over(Window.orderBy(F.col(f"`{source}`").asc_nulls_last())) - 1) % len(weights)
    d = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    d = filled(d.withColumn("_all", F.lit(1)), ["_all"], "_cap", "_w", F.sum("source_size").over(Window.partitionBy("_all")) * F.lit(float(share)))
    return d.select(F.col(f"`{source}`"), "source_size", F.coalesce(F.least("_cap", F.col("_w") * F.col("level")), F.col("_cap")).alias("target"))


def mixed(
    df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, tilt: float = TILT, seed: int = 0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, and the columns in ``keep``) per row.

    ``size`` counts words (null text: 0), ``copies`` is 0 to ``most``, ``taken`` is their product.
    A source takes words up to the document that brings it nearest its target, so it misses by
    half a document at most. Null sources are a source of their own; equal identifiers share u
    and are ranked one after another; an empty table gives no rows. Words of whole texts are counted, of
    any length; other columns are not read but for those in ``keep``. Rows of a source are never
    in one task: sums are per source and doubling of size, and ranks come from range partitions.
    """
    narrow = materialized(
        df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{source}`").alias("_source"), word_count(F.col(f"`{text}`")).alias("size"), *keep, F.monotonically_increasing_id().alias("_tie"))
        .withColumn("_class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    )
    classes = materialized(narrow.groupBy("_source", "_class").agg(F.sum("size").alias("_words")))
    targets = source_targets(classes.groupBy("_source").agg(F.sum("_words").alias("source_size")), "_source", weights, share, most)
    c = classes.join(targets.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    c = c.withColumns({"_g": 1 + F.lit(float(tilt)) * F.col("_class"), "_cap": F.lit(float(most)), "_n": F.col("_words").cast("double")})
    c = filled(c, ["_source"], "_cap", "_g", F.col("target"), "_n")
    c = c.withColumn("_e", F.coalesce(F.least("_cap", F.col("_g") * F.col("level")), F.col("_cap")))
    c = c.withColumns({"_whole": F.floor(F.col("_e") + F.lit(1e-9)), "_p": F.greatest(F.lit(0.0), F.col("_e") - F.floor(F.col("_e") + F.lit(1e-9)))})
    c = c.withColumn("_drawn", F.sum(F.col("_p") * F.col("_words")).over(Window.partitionBy("_source")))
    c = materialized(c.select(F.col("_source").alias("_s"), F.col("_class").alias("_k"), "source_size", "target", "_whole", "_p", "_drawn"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    d = narrow.join(small_enough(c), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_k"))).drop("_s", "_k", "_class")
    d = d.withColumn("_q", F.when(F.col("_p") > 0, (u / (1 - u)) * (1 - F.col("_p")) / F.col("_p")))
    d = running_totals(d, ["_source", "_q", "_id", "_tie"], {"_before": "size"})
    starts = materialized(d.groupBy("_source").agg(F.min("_before").alias("_start")).withColumnRenamed("_source", "_s"))
    d = d.join(small_enough(starts), F.col("_source").eqNullSafe(F.col("_s")))
    near = F.col("_before") - F.col("_start") + F.col("size") / 2 <= F.col("_drawn")
    copies = F.col("_whole") + F.when(F.col("_q").isNotNull() & near, 1).otherwise(0)
    return d.select(
        F.col("_id").alias(id), F.col("_source").alias(source), "size", "source_size", "target",
        copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *keep,
    )
