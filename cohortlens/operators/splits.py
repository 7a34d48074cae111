"""Splits that do not leak, and the audit that shows it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import SPAN, bucket, hash32
from cohortlens.plans.skew import lookup_join


def split_entity(
    df: DataFrame, id: str, weights: Mapping[str, float], salt: str = "", out: str = "split"
) -> DataFrame:
    """Assign every row of an entity to one split by a hash of its id (G1).

    A pure expression: no shuffle, and the same answer on every run and every subset.
    """
    total = float(sum(weights.values()))
    names = list(weights)
    h = hash32(id, salt)
    edge, picked = 0.0, None
    for name in names[:-1]:
        edge += weights[name] / total
        test = h < F.lit(int(edge * SPAN))
        picked = F.when(test, F.lit(name)) if picked is None else picked.when(test, F.lit(name))
    last = F.lit(names[-1])
    return df.withColumn(out, last if picked is None else picked.otherwise(last))


def split_time(df: DataFrame, t: str, cut1: str, cut2: str, out: str = "split") -> DataFrame:
    """train before ``cut1``, validation before ``cut2``, test from then on."""
    day = F.col(t).cast("date")
    return df.withColumn(
        out,
        F.when(day < F.lit(cut1).cast("date"), "train")
        .when(day < F.lit(cut2).cast("date"), "validation")
        .when(day.isNotNull(), "test"),
    )


def split_group(df: DataFrame, group: str, held_out: Sequence[str], out: str = "split") -> DataFrame:
    """Hold out whole sites, registries or manufacturers for external validation."""
    held = F.coalesce(F.col(group).isin(list(held_out)), F.lit(False))
    return df.withColumn(out, F.when(held, "external").otherwise("development"))


def folds(df: DataFrame, id: str, k: int, salt: str = "fold", out: str = "fold") -> DataFrame:
    """Fold number in [0, k) per entity, usable as ``CrossValidator(foldCol=)``."""
    return df.withColumn(out, bucket(id, k, salt))


def leakage(
    df: DataFrame, id: str, split: str, feat_t: str | None = None, pred_t: str | None = None
) -> DataFrame:
    """Entities in more than one split, or with features dated after prediction time.

    Comparing the least and greatest split name needs no distinct count, so each map task
    sends one row per entity.
    """
    late = F.lit(0).cast("bigint")
    if feat_t is not None:
        late = F.count_if(F.col(feat_t) > F.col(pred_t))
    per = df.groupBy(id).agg(
        F.min(split).alias("_lo"), F.max(split).alias("_hi"), F.count(F.lit(1)).alias("n_rows"), late.alias("n_late")
    )
    return per.select(
        id, "n_rows", (F.col("_lo") != F.col("_hi")).cast("int").alias("in_many_splits"), "n_late"
    ).where((F.col("in_many_splits") == 1) | (F.col("n_late") > 0))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight each row by n / (classes * n_class), so every class weighs the same."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # One row per class, so the window over all of them is as small as the label's vocabulary.
    every = Window.partitionBy(F.lit(0))
    weight = F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n").cast("double"))
    return lookup_join(df, counts.select(label, weight.alias(out)), label)


def group_label_weights(df: DataFrame, group: str, label: str, out: str = "weight") -> DataFrame:
    """Weight each row by n_group * n_label / (n * n_both), so that label and group are independent in training.

    Rows without a label get no weight; those without a group are a group. The counts have a row
    per group and label, which the windows over them hold.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    own, same, every = (Window.partitionBy(*cols) for cols in ([group], [label], [F.lit(0)]))
    expected = F.sum("_n").over(own).cast("double") * F.sum("_n").over(same) / F.sum("_n").over(every)
    return lookup_join(df, counts.select(group, label, (expected / F.col("_n")).alias(out)), [group, label])
