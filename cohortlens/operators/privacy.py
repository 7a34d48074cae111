"""De-identification and its check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.hashing import bucket
from cohortlens.plans.skew import as_list, lookup_join

class TextPattern(NamedTuple):
    """An identifier's pattern, the text put in its place, and something any match contains."""

    pattern: str
    mask: str
    needs: str


# Identifier patterns, applied in this order.
TEXT_PATTERNS: dict[str, TextPattern] = {
    "email": TextPattern(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]", "@"),
    "ip": TextPattern(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]", "[0-9]"),
    "phone": TextPattern(r"(?:\+?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "[PHONE]", "[0-9]"),
}


def pseudonymize(df: DataFrame, ids: str | Sequence[str], salt: str) -> DataFrame:
    """Replace ids with SHA-256 of the secret salt and the id (L1).

    The same id gets the same pseudonym in every table, so joins still work.
    """
    return df.withColumns(
        {c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in as_list(ids)}
    )


def mask_text(df: DataFrame, text: str, patterns: Mapping[str, TextPattern] = TEXT_PATTERNS) -> DataFrame:
    """Mask identifiers in the whole text and count each kind (L2).

    A kind is counted in the text left by the kinds before it, so no characters count twice.
    Texts without the character every match needs skip the pattern, and only texts that it
    changed are counted; each step is its own projection, so no pattern runs twice.
    """
    out, current = df, F.col(text)
    steps = [f"_masked_{kind}" for kind in patterns]
    for step, rule in zip(steps, patterns.values()):
        needed = current.contains(rule.needs) if len(rule.needs) == 1 else current.rlike(rule.needs)
        masked = F.regexp_replace(current, rule.pattern, rule.mask.replace("$", r"\$"))
        out = out.withColumn(step, F.when(needed, masked).otherwise(current))
        current = F.col(step)
    before = [text, *steps]
    counts = {
        f"n_{kind}": F.when(F.col(was) == F.col(now), F.lit(0)).otherwise(F.regexp_count(F.col(was), F.lit(rule.pattern)))
        for (kind, rule), was, now in zip(patterns.items(), before, steps)
    }
    return out.withColumns(counts).withColumn(text, current).drop(*steps)


def shift_dates(df: DataFrame, id: str, cols: Sequence[str], max_days: int, salt: str) -> DataFrame:
    """Move all of an entity's dates by one hashed offset in [-max_days, max_days] (L3).

    Intervals within the entity are kept, and the time of day with them.
    """
    offset = bucket(id, 2 * max_days + 1, salt) - F.lit(max_days)
    shifted = {}
    for c in cols:
        kind = df.schema[c].dataType.typeName()
        moved = F.date_add(F.col(c), offset) if kind == "date" else F.col(c) + F.make_dt_interval(offset)
        shifted[c] = moved
    return df.withColumns(shifted)


def k_anonymity(df: DataFrame, quasi: Sequence[str], k: int) -> DataFrame:
    """Combinations of quasi-identifiers shared by fewer than ``k`` rows (L4)."""
    return df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") < k)


def suppress_small_cells(df: DataFrame, quasi: Sequence[str], k: int) -> DataFrame:
    """Rows in cells of at least ``k``; rows in smaller cells have their quasi-identifiers nulled.

    The small cells are joined null-safely, since a missing value is itself identifying.
    """
    small = k_anonymity(df, quasi, k).select(*[F.col(q).alias(f"_q{i}") for i, q in enumerate(quasi)])
    small = small.withColumn("_cell", F.sha2(F.to_json(F.struct(*[f"_q{i}" for i in range(len(quasi))])), 256))
    keyed = df.withColumn("_cell", F.sha2(F.to_json(F.struct(*[F.col(q).alias(f"_q{i}") for i, q in enumerate(quasi)])), 256))
    both = lookup_join(keyed, small.select("_cell", F.lit(1).alias("_small")), "_cell")
    keep = F.col("_small").isNull()
    changed = {q: F.when(keep, F.col(q)) for q in quasi}
    return both.withColumns({**changed, "is_suppressed": (~keep).cast("int")}).drop("_cell", "_small")
