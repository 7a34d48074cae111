"""Order-preserving keys of fixed width.

Spark's hash aggregate holds numbers, dates and timestamps, not structs. Two order columns
packed into one decimal let first values be hashed instead of sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of fixed width, which a hash aggregate can hold.
FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_fixed(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, FIXED)


def order_key(df: DataFrame, order: Sequence[str]) -> Column | None:
    """A column of fixed width that sorts as ``order``, nulls first, where its first column is not null; None if there is none.

    One column of fixed width is its own key. Of two, the first must be a date, a timestamp or a
    whole number of 32 bits, and the second a whole number: together they fit a decimal.
    """
    if len(order) == 1:
        return F.col(order[0]) if is_fixed(df, order[0]) else None
    if len(order) != 2 or not isinstance(df.schema[order[1]].dataType, _WHOLE):
        return None
    kind, t = df.schema[order[0]].dataType, F.col(order[0])
    if isinstance(kind, T.DateType):
        high = F.unix_date(t)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        high = F.unix_micros(t.cast("timestamp"))
    elif isinstance(kind, _WHOLE[:3]):
        high = t
    else:
        return None
    low = F.coalesce(F.col(order[1]).cast("decimal(20,0)") + F.lit(Decimal(2**63 + 1)), F.lit(0))
    return (high.cast("decimal(17,0)") * F.lit(Decimal(2**65)) + low).cast("decimal(38,0)")
