"""Weighted score cards."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.plans.skew import lookup_join

# Criteria and weights of the score card.
CRITERION_WEIGHTS = {
    "Clinical Validity": Decimal("0.25"),
    "ML Approach": Decimal("0.25"),
    "Study Design Quality": Decimal("0.20"),
    "GitHub & Documentation": Decimal("0.15"),
    "Presentation": Decimal("0.15"),
}
MIN_SCORE, MAX_SCORE = 1, 5


def scorecard(
    scores: DataFrame,
    weights: Mapping[str, Decimal] = CRITERION_WEIGHTS,
    entity: str = "entity",
    criterion: str = "criterion",
    score: str = "score",
) -> DataFrame:
    """Weighted score per entity and whether the card is valid (M1).

    The total is the sum of score x weight in DECIMAL. A card is invalid, and its total
    null, if a criterion is missing, repeated or unknown or a score is outside 1 to 5.
    Weights that do not sum to 1 are an error.
    """
    exact = {c: Decimal(str(w)) for c, w in weights.items()}
    if sum(exact.values()) != Decimal(1):
        raise ValueError(f"weights sum to {sum(exact.values())}, not 1")
    weight = F.lit(None).cast("decimal(4,2)")
    for name, value in exact.items():
        if value != value.quantize(Decimal("0.01")):
            raise ValueError(f"weight of {name} has more than two decimals")
        weight = F.when(F.col(criterion) == F.lit(name), F.lit(value).cast("decimal(4,2)")).otherwise(weight)
    in_range = F.coalesce(F.col(score).between(MIN_SCORE, MAX_SCORE), F.lit(False))
    rows = scores.select(
        F.col(entity),
        weight.alias("_w"),
        F.when(in_range, F.col(score).cast("decimal(4,0)") * weight).alias("_p"),
        (~in_range | weight.isNull()).cast("int").alias("_bad"),
        *[(F.col(criterion) == F.lit(name)).cast("int").alias(f"_has{i}") for i, name in enumerate(exact)],
    )
    cards = rows.groupBy(entity).agg(
        F.sum("_p").cast("decimal(6,2)").alias("_total"),
        F.count(F.lit(1)).alias("n_scores"),
        F.sum("_bad").alias("n_rejected"),
        *[F.sum(f"_has{i}").alias(f"_c{i}") for i in range(len(exact))],
    )
    whole = F.lit(True)
    for i in range(len(exact)):
        whole = whole & (F.col(f"_c{i}") == 1)
    valid = whole & (F.col("n_rejected") == 0)
    return cards.select(
        entity,
        "n_scores",
        "n_rejected",
        valid.cast("int").alias("is_valid"),
        F.when(valid, F.col("_total")).alias("weighted_score"),
    )


def rank_cards(cards: DataFrame, score: str = "weighted_score") -> DataFrame:
    """Rank and dense rank of each scored card, equal scores tied (M2).

    Scores of 1 to 5 in hundredths have at most 401 distinct values, so the ranking window
    runs over the distinct totals and every card looks its rank up.
    """
    totals = cards.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(score))
    above = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = totals.select(
        score, (above + 1).alias("rank"), F.row_number().over(w).cast("bigint").alias("dense_rank")
    )
    return lookup_join(cards.where(F.col(score).isNotNull()), ranks, score, "inner")
