"""Keys that hold too many rows for one task.

A join or an ordered window puts all rows of a key in one task. When a single key
may hold a large share of the data that task never finishes. ``hot_keys`` finds such
keys with one map-side-combined count. Joins leave the splitting to adaptive execution
where the session allows it and otherwise salt those keys; ordered windows, which Spark
cannot split, cut those keys along time (``plans.scan``). Ordinary keys keep the plain
one-shuffle plan, and no row is ever dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.plans.sizes import BROADCAST_BYTES, few_rows, pin, plan_bytes, small_broadcast
from cohortlens.session import splits_skewed_joins

# Rows of one key that one task may hold.
GROUP_ROWS = 2_000_000
# Inputs below this size have their rows counted from footers; with few of them no key can be too big.
PROBE_BYTES = 64 * 1024 * 1024

KEY_ROWS = "_key_rows"
SALT = "_salt"
SALTS = "_salts"


def as_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def hot_keys(df: DataFrame, keys: str | Sequence[str], group_rows: int | None = None) -> tuple[DataFrame, bool] | None:
    """Keys with more than ``group_rows`` rows, with their counts, or None if there are none.

    At most ``rows / group_rows`` keys can qualify, so the table stays small next to
    the data; the second value says whether it is small enough to broadcast. Passing
    ``group_rows`` forces the count even on small inputs.
    """
    if group_rows is None:
        if few_rows(df, GROUP_ROWS, PROBE_BYTES):
            return None
        group_rows = GROUP_ROWS
    keys = as_list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(KEY_ROWS)).where(F.col(KEY_ROWS) > group_rows)
    table, small = pin(counts)
    return None if table.isEmpty() else (table, small)


def attach(df: DataFrame, table: DataFrame, on: Sequence[str], small: bool, how: str = "left") -> DataFrame:
    """Join a table of per-key facts, broadcasting it only when it was found small.

    A missing key matches a missing key here: rows without an id can be a hot group too.
    """
    renamed = table.withColumnsRenamed({c: f"_on{i}" for i, c in enumerate(on)})
    same = [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]
    out = df.join(F.broadcast(renamed) if small else renamed, reduce(and_, same), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_on{i}" for i in range(len(on))])


def skew_join(
    many: DataFrame,
    one: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    group_rows: int | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``many`` rows per key with ``one`` row per key, splitting hot keys.

    A side of proven size is broadcast. Otherwise the join is left to adaptive execution if
    the session lets it split skewed joins; if not, or if ``group_rows`` is given, hot keys
    are looked for and salted here. Rows of a hot key are spread over ``ceil(rows / group_rows)`` salts by a hash of
    their own values, and only that key's row of ``one`` is repeated per salt. The salt
    is a pure function of the row, so a recomputed task yields the same rows. With
    ``null_safe`` a missing key matches a missing key.
    """
    on = as_list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join does not split a {how} join")
    size = plan_bytes(one)
    if group_rows is None and size is not None and size <= BROADCAST_BYTES:
        return _joined(many, one, on, True, how, null_safe)
    if group_rows is None and splits_skewed_joins(many.sparkSession):
        return _joined(many, one, on, False, how, null_safe)
    found = hot_keys(many, on, group_rows)
    if found is None:
        return _joined(many, one, on, False, how, null_safe)
    table, small = found
    salts = F.ceil(F.col(KEY_ROWS) / F.lit(group_rows or GROUP_ROWS)).cast("int")
    table = table.select(*on, salts.alias(SALTS))
    spread = [c for c in many.columns if c not in on] or on
    left = attach(many, table, on, small).withColumn(
        SALT,
        F.when(F.col(SALTS).isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.col(SALTS).cast("bigint")).cast("int")
        ),
    )
    right = attach(one, table, on, small).withColumn(
        SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(SALTS), F.lit(1)) - 1))
    )
    return _joined(left.drop(SALTS), right.drop(SALTS), [*on, SALT], False, how, null_safe).drop(SALT)


def _joined(many: DataFrame, one: DataFrame, on: list[str], small: bool, how: str, null_safe: bool) -> DataFrame:
    if null_safe:
        return attach(many, one, on, small, how)
    return many.join(F.broadcast(one) if small else one, on, how)


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    group_rows: int | None = None,
) -> DataFrame:
    """Join a small table of one row per key without shuffling ``df``.

    The table's size is checked first: proven small, it is broadcast; otherwise the
    join shuffles both sides and splits hot keys. Rows whose key is missing look up the
    row whose key is missing, as when both come from grouping by that key.
    """
    hinted = small_broadcast(table)
    if hinted is not None:
        return attach(df, hinted, as_list(on), True, how)
    return skew_join(df, table, on, how, group_rows, null_safe=True)
