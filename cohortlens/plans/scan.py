"""Ordered scans over each entity's rows, safe for entities of any size.

``ordered_scan`` adds previous-row values, last-non-null values and running sums along
an order. Ordinarily it is one window, so one shuffle. Rows of entities too big for one task
are numbered along the order by range partitions and cut into segments of ``group_rows``
rows; each segment is scanned on its own and then receives what the segments before it carry
forward. That is a two-level prefix scan: segment totals are a row per segment. All other
rows keep the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cohortlens.plans.ranks import positions
from cohortlens.plans.skew import GROUP_ROWS, KEY_ROWS, as_list, attach, hot_keys

SEG, PLACE = "_seg", "_place"


def segment(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: tuple[DataFrame, bool], group_rows: int | None
) -> DataFrame:
    """The rows of hot keys, with their place along the order within the key and their segment.

    A segment holds ``group_rows`` rows, the last of a key fewer, whatever the types and the
    spread of the order's values.
    """
    limit = group_rows or GROUP_ROWS
    table, small = hot
    rows = attach(df, table.select(*keys), keys, small, "left_semi")
    held = int(table.agg(F.sum(KEY_ROWS)).first()[0])
    return positions(rows, keys, order, PLACE, -(-2 * held // limit)).withColumn(SEG, F.floor(F.col(PLACE) / F.lit(limit)))


def ordered_scan(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[str],
    *,
    prev: Mapping[str, str] | None = None,
    carry: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    hot: tuple[DataFrame, bool] | None = None,
    probe: bool = True,
    group_rows: int | None = None,
) -> DataFrame:
    """Add columns computed along ``order`` within ``keys``.

    prev     {new: column}: the previous row's value (null on the first row)
    carry    {new: column}: the last non-null value up to and including this row
    running  {new: column}: the sum up to and including this row

    ``order`` must be a total order within the key. A caller that has already looked for hot keys passes them as
    ``hot`` with ``probe=False``.
    """
    keys, order = as_list(keys), as_list(order)
    prev, carry, running = dict(prev or {}), dict(carry or {}), dict(running or {})
    if probe:
        hot = hot_keys(df, keys, group_rows)
    if prev:
        df = df.withColumn("_row", F.struct(*[F.col(c).alias(n) for n, c in prev.items()]))
    if hot is None:
        out = _scanned(df, Window.partitionBy(*keys).orderBy(*order), prev, carry, running)
    else:
        table, small = hot
        cold = attach(df, table.select(*keys), keys, small, "left_anti")
        out = _scanned(cold, Window.partitionBy(*keys).orderBy(*order), prev, carry, running)
        cut = segment(df, keys, order, hot, group_rows)
        own = _scanned(cut, Window.partitionBy(*keys, SEG).orderBy(PLACE), prev, carry, running)
        out = out.unionByName(_carry_over(cut, own, keys, prev, carry, running).select(*out.columns))
    cols = [F.col(c) for c in df.columns if not (prev and c == "_row")]
    cols += [F.col("_prev")[n].alias(n) for n in prev]
    cols += [F.col(f"_c_{n}").alias(n) for n in carry]
    cols += [F.col(f"_r_{n}").alias(n) for n in running]
    return out.select(*cols)


def _scanned(df: DataFrame, w: WindowSpec, prev, carry, running) -> DataFrame:
    """``df`` with the columns that one window gives."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_prev", F.lag("_row").over(w)) if prev else df
    for name, col in carry.items():
        out = out.withColumn(f"_c_{name}", F.last(col, ignorenulls=True).over(upto))
    for name, col in running.items():
        out = out.withColumn(f"_r_{name}", F.sum(col).over(upto))
    return out


def _carry_over(frame, scanned, keys, prev, carry, running):
    """Give each segment what the earlier segments of its key hand on."""
    position = F.col(PLACE)
    totals = []
    if prev:
        totals.append(F.max_by("_row", position).alias("_t_row"))
    for name, col in carry.items():
        totals.append(F.max_by(col, F.when(F.col(col).isNotNull(), position)).alias(f"_tc_{name}"))
    for name, col in running.items():
        totals.append(F.sum(col).alias(f"_tr_{name}"))
    seg = frame.groupBy(*keys, SEG).agg(*totals)
    w = Window.partitionBy(*keys).orderBy(SEG)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    handed = [F.col(c) for c in [*keys, SEG]]
    if prev:
        handed.append(F.lag("_t_row").over(w).alias("_h_row"))
    for name in carry:
        handed.append(F.last(f"_tc_{name}", ignorenulls=True).over(earlier).alias(f"_hc_{name}"))
    for name in running:
        handed.append(F.sum(f"_tr_{name}").over(earlier).alias(f"_hr_{name}"))
    out = attach(scanned, seg.select(*handed), [*keys, SEG], small=False)
    if prev:
        out = out.withColumn("_prev", F.coalesce("_prev", "_h_row"))
    for name in carry:
        out = out.withColumn(f"_c_{name}", F.coalesce(f"_c_{name}", f"_hc_{name}"))
    for name in running:
        total = F.coalesce(F.col(f"_r_{name}"), F.lit(0)) + F.coalesce(F.col(f"_hr_{name}"), F.lit(0))
        unset = F.col(f"_r_{name}").isNull() & F.col(f"_hr_{name}").isNull()
        out = out.withColumn(f"_r_{name}", F.when(~unset, total))
    return out
