"""Size checks made before a plan is chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import materialized

# A table Catalyst itself expects to be this small is broadcast without counting it.
BROADCAST_BYTES = 10 * 1024 * 1024
# The most rows a table may have, once counted, to be held by the driver and broadcast.
LOOKUP_ROWS = 100_000
# The most bytes those rows may take.
LOOKUP_BYTES = 64 * 1024 * 1024


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for a plan, or None on a session without a JVM handle.

    Costs no job. Joins multiply their inputs' sizes, so the estimate errs upwards.
    """
    plan = _optimized(df)
    return None if plan is None else int(plan.stats().sizeInBytes())


def input_bytes(df: DataFrame) -> int | None:
    """Size of everything a plan reads, or its own estimate if smaller; None when unknown.

    Catalyst multiplies the sizes of joined inputs, which says nothing about a join to one
    row per key. Such joins, filters and aggregates never hold more rows than their inputs,
    so the sum of the inputs tells whether any group could be big.
    """
    plan = _optimized(df)
    if plan is None:
        return None
    leaves = plan.collectLeaves()
    total = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return min(int(plan.stats().sizeInBytes()), total)


def input_rows(df: DataFrame) -> int | None:
    """Rows in the Parquet files that a plan reads, from their footers; None if it reads anything else."""
    files = df.inputFiles()
    if not files or not all(f.endswith(".parquet") for f in files):
        return None
    return df.sparkSession.read.parquet(*files).count()


def few_rows(df: DataFrame, limit: int, probe_bytes: int) -> bool:
    """Whether a plan's inputs hold at most ``limit`` rows: small inputs only are counted.

    Bytes alone do not tell, because sorted or repeated values compress to almost nothing.
    """
    size = input_bytes(df)
    if size is None or size >= probe_bytes:
        return False
    rows = input_rows(df)
    return rows is None or rows <= limit


def _optimized(df: DataFrame):
    jdf = getattr(df, "_jdf", None)
    return None if jdf is None else jdf.queryExecution().optimizedPlan()


def bounded_rows(df: DataFrame, max_rows: int | None = None) -> DataFrame | None:
    """``df`` as driver-held rows if it has at most ``max_rows`` of at most ``LOOKUP_BYTES``, else None.

    Over a scan or a filter the limit stops the job early; over an aggregate or a window the
    shuffle before it runs in full.
    """
    max_rows = LOOKUP_ROWS if max_rows is None else max_rows
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > LOOKUP_BYTES:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def pin(df: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Compute ``df`` once: driver-held if small, otherwise a table in the shared folder.

    Returns the table and whether it is small enough to broadcast.
    """
    local = bounded_rows(df, max_rows)
    return (materialized(df), False) if local is None else (local, True)


def small_broadcast(df: DataFrame) -> DataFrame | None:
    """A broadcast-hinted ``df`` when its size is proven, else None."""
    size = plan_bytes(df)
    if size is not None and size <= BROADCAST_BYTES:
        return F.broadcast(df)
    local = bounded_rows(df)
    return None if local is None else F.broadcast(local)
