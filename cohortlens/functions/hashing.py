"""Stable hashes: the same row gets the same value on every run and every cluster.

MD5 is used rather than Spark's own ``hash`` so that other engines can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.time import col

SPAN = 1 << 32


def hash32(value: str | Column, salt: str = "") -> Column:
    """First 32 bits of md5(salt || value) as BIGINT in [0, 2^32)."""
    digest = F.md5(F.concat(F.lit(salt), col(value).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def bucket(value: str | Column, n: int, salt: str = "") -> Column:
    """Hash bucket in [0, n)."""
    return F.pmod(hash32(value, salt), F.lit(n)).cast("int")
