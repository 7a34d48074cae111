"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.session import materialized

#: The white space of the word definition: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
#: Rows per Arrow batch: a few hundred texts of any length, so that a Python worker stays small.
BATCH_ROWS = "256"
#: Bytes per Arrow batch, since a few hundred long texts would be large.
BATCH_BYTES = str(4 << 20)
#: Rows of a table that may be broadcast, once its rows have been counted. The rows here are keys and numbers.
BROADCAST_ROWS = 200_000


#: The most bytes that the marks of all files' rows may take together to be broadcast: a bit a row.
MARK_BYTES = 32 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand texts to Python workers a few hundred at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it.

    Spark repeats an inlined expression for every element when a lambda refers to it.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The runs of characters other than ``SPACES``, in order; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " ", -1), "")


def word_count(text: Column) -> Column:
    """Number of words, without making them: places where a word follows a space."""
    spaced = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it was written and has at most ``limit`` rows.

    Only for written tables of a few fixed-width columns: counting one reads footers. A
    larger one is left to a shuffled join, which adaptive execution splits.
    """
    return F.broadcast(df) if df.count() <= limit else df


class RowMarks:
    """Marks on rows of files, a bit for every row: so a table is told which of its rows, while it is scanned and stays where it is.

    ``rows`` is a written table with ``_path`` and ``_row``; ``marks`` names conditions on it. ``bits``
    is None if the marks would take more than ``MARK_BYTES``; then rows are to be joined.
    """

    def __init__(self, rows: DataFrame, marks: Mapping[str, Column]):
        self.marks = list(marks)
        ends = materialized(rows.groupBy("_path").agg(F.max("_row").alias("_end")))
        size = ends.agg(F.sum(F.octet_length("_path") + (F.shiftright("_end", 6) + 1) * 8 * len(self.marks))).first()[0] or 0
        self.bits = None
        if size <= MARK_BYTES:
            own = F.expr("shiftleft(1L, CAST(_row % 64 AS INT))")
            words = rows.groupBy("_path", F.shiftright("_row", 6).alias("_word")).agg(*[F.bit_or(F.when(c, own).otherwise(F.lit(0).cast("bigint"))).alias(f"_bits_{m}") for m, c in marks.items()])
            every = ends.select("_path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright("_end", 6))).alias("_word"))
            inner = every.join(words, ["_path", "_word"], "left").groupBy("_path").agg(F.sort_array(F.collect_list(F.struct("_word", *[f"_bits_{m}" for m in marks]))).alias("_all"))
            self.bits = materialized(inner.select("_path", *[F.col(f"_all._bits_{m}").alias(f"_bits_{m}") for m in marks]))

    def on(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """``df``, which has ``_path`` and ``_row``, joined to its files' bits by a broadcast; and each mark as a condition on that."""
        names = {m: free_name(df, f"_bits_{m}") for m in self.marks}
        named = self.bits.withColumnsRenamed({f"_bits_{m}": n for m, n in names.items()})
        word = lambda n: F.get(F.col(n), F.shiftright("_row", 6).cast("int"))
        is_set = lambda n: F.coalesce(F.getbit(word(n), (F.col("_row") % 64).cast("int")) == 1, F.lit(False))
        return df.join(F.broadcast(named), "_path", "left"), {m: is_set(n) for m, n in names.items()}


def about(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, if those are more: the ones whose key's hash is low.

    A filter, so nothing is gathered to choose them, however many tasks there are. Rows with one
    key are all in or all out.
    """
    span = 1 << 40
    return df if total <= rows else df.where(F.pmod(F.xxhash64(F.lit("about"), F.col(key)), F.lit(span)) < int(span * rows / total))


def running_totals(df: DataFrame, order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """For each row, the totals of ``values`` over all rows before it in ``order``.

    ``values`` maps a new column to the column it sums. The rows are range-partitioned and
    written once; one row per partition gives the offsets, so that no task holds more than
    its range, whatever the keys. ``order`` must end in a column that tells equal rows apart,
    or one range may hold them all.
    """
    part = free_name(df, "_part")
    ranged = materialized(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn(part, F.spark_partition_id()))
    sums = ranged.groupBy(part).agg(*[F.sum(v).alias(f"_all_{n}") for n, v in values.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sums.select(part, *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in values])
    within = Window.partitionBy(part).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), part)
    totals = {n: F.col(f"_off_{n}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for n, v in values.items()}
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in totals.items()])
