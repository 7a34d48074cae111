"""Evaluation of predictions under censoring.

Nothing here pairs rows; ranks come from counts per distinct score. Scores are compared
exactly unless a number of decimals is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import SPAN, hash32
from cohortlens.functions.time import days_between
from cohortlens.operators.survival import ipcw, km, surv_at
from cohortlens.plans.ranks import dense_ranks
from cohortlens.plans.skew import as_list, attach, lookup_join, skew_join
from cohortlens.session import materialized

# Distinct scores one window may hold; wider spans are ranked in two levels.
WINDOW_SPAN = 1_000_000


def score_key(score: str, digits: int) -> Column:
    """The score at ``digits`` decimals, as a whole number."""
    return F.round(F.col(score).cast("double") * F.lit(10.0**digits)).cast("bigint")


def keyed(df: DataFrame, score: str, digits: int | None, columns: int = 1) -> tuple[DataFrame, int]:
    """``df`` with ``_s``, by which scores compare, and a bound on its distinct values.

    With ``digits`` the score as a whole number. Otherwise the score itself, or, past
    ``WINDOW_SPAN`` distinct ones (shared among the ``columns`` that are summed over them), its
    rank among them, so that chunks of ranks hold equal numbers of scores however those are
    spread. Rows without a score are left out.
    """
    rows = df.where(F.col(score).isNotNull())
    if digits is not None:
        rows = rows.withColumn("_s", score_key(score, digits))
        limits = rows.agg(F.min("_s").alias("lo"), F.max("_s").alias("hi")).first()
        return rows, int((limits["hi"] or 0) - (limits["lo"] or 0)) + 1
    distinct = int(rows.select(score).distinct().count())
    if distinct <= WINDOW_SPAN // columns:
        return rows.withColumn("_s", F.col(score)), distinct
    ranks = dense_ranks(rows, score, "_s")
    return skew_join(rows, ranks, score), distinct


def sum_below(table: DataFrame, parts: Sequence[str], key: str, value: str, span: int, out: str) -> DataFrame:
    """Sum of ``value`` over rows of the same part with a strictly smaller ``key``, as ``sums_below``."""
    return sums_below(table, parts, key, {out: value}, span)


def sums_below(table: DataFrame, parts: Sequence[str], key: str, values: Mapping[str, str], span: int, columns: int = 1) -> DataFrame:
    """Per new column of ``values``, the sum of its column over rows of the same part with a strictly smaller ``key``.

    Keys are distinct within a part and lie in a range of ``span`` whole numbers. Past
    ``WINDOW_SPAN`` (shared among ``columns``, as in ``keyed``) the range is cut into about
    sqrt(span) chunks; sums within a chunk and over the chunks before it are then both small windows.
    """
    parts = list(parts)
    w = lambda cols, order: Window.partitionBy(*cols).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, cols, order: F.coalesce(F.sum(c).over(w(cols, order)), F.lit(0))
    if span <= WINDOW_SPAN // columns:
        return table.select("*", *[before(v, parts, key).alias(out) for out, v in values.items()])
    width = math.isqrt(span) + 1
    chunked = table.withColumn("_chunk", F.floor(F.col(key) / F.lit(float(width))).cast("bigint"))
    totals = chunked.groupBy(*parts, "_chunk").agg(*[F.sum(v).alias(f"_sum_{out}") for out, v in values.items()])
    totals = totals.select(*parts, "_chunk", *[before(f"_sum_{out}", parts, "_chunk").alias(f"_base_{out}") for out in values])
    inside = chunked.select("*", *[before(v, [*parts, "_chunk"], key).alias(f"_in_{out}") for out, v in values.items()])
    both = attach(inside, totals, [*parts, "_chunk"], small=False, how="inner")
    return both.select(*table.columns, *[(F.col(f"_in_{out}") + F.col(f"_base_{out}")).alias(out) for out in values])


def cindex(
    df: DataFrame,
    time: str = "time",
    event: str = "event",
    score: str = "score",
    by: str | Sequence[str] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Concordance index under right censoring; a higher score means earlier failure (K1).

    Entity i is comparable with j if i had the event and j's time is later, or equal with j
    censored. Coding each as ``2 * time + (1 - event)`` turns that into "i had the event and
    i's code is smaller". Two codes first differ at one binary digit, so counting per
    (digit, shared prefix) finds every comparable pair exactly once, without forming pairs:
    rows x digits instead of rows squared.
    """
    by = as_list(by)
    known, span = keyed(df.where(F.col(time).isNotNull() & F.col(event).isNotNull()), score, digits)
    code = F.col(time).cast("bigint") * 2 + (1 - F.col(event).cast("bigint"))
    coded = known.select(*by, code.alias("_code"), "_s")
    limits = coded.agg(F.min("_code").alias("lo"), F.max("_code").alias("hi")).first()
    # From an even number on, so that the last bit still tells events from censorings.
    least = int(limits["lo"] or 0) // 2 * 2
    levels = max((int(limits["hi"] or 0) - least).bit_length(), 1)
    coded = coded.withColumn("_code", F.col("_code") - F.lit(least))
    counted = coded.groupBy(*by, "_code", "_s").agg(F.count(F.lit(1)).alias("_n"))
    spread = counted.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    bit = F.expr("shiftright(_code, _level) & 1")
    spread = spread.select(
        *by, "_level", F.expr("shiftright(_code, _level + 1)").alias("_prefix"), "_s",
        F.when((bit == 0) & (F.col("_code") % 2 == 0), F.col("_n")).otherwise(F.lit(0)).alias("_l"),
        F.when(bit == 1, F.col("_n")).otherwise(F.lit(0)).alias("_r"),
    ).where((F.col("_l") > 0) | (F.col("_r") > 0))
    parts = [*by, "_level", "_prefix"]
    sides = spread.groupBy(*parts, "_s").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    ranked = sum_below(sides, parts, "_s", "_r", span, "_below")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    per_part = ranked.groupBy(*parts).agg(
        F.sum(wide("_l") * wide("_below")).alias("_con"),
        F.sum(wide("_l") * wide("_r")).alias("_tie"),
        F.sum("_l").alias("_ls"),
        F.sum("_r").alias("_rs"),
    )
    totals = per_part.groupBy(*by).agg(
        F.sum("_con").cast("decimal(38,0)").alias("concordant"),
        F.sum("_tie").cast("decimal(38,0)").alias("tied"),
        F.sum(wide("_ls") * wide("_rs")).cast("decimal(38,0)").alias("comparable"),
    )
    c = F.col("concordant").cast("double") + F.col("tied").cast("double") / 2.0
    return totals.withColumn("c_index", F.try_divide(c, F.col("comparable").cast("double")))


def td_auc(
    df: DataFrame,
    horizon: int | Sequence[int],
    time: str = "time",
    event: str = "event",
    score: str = "score",
    by: str | Sequence[str] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Cumulative/dynamic AUROC at a horizon, weighted for censoring (K2).

    Cases had the event by the horizon and weigh 1/G just before their time; controls were
    followed past it and share one weight, which cancels. Rows censored earlier enter only
    through G. Several horizons take one pass and give a row each, with a column ``horizon``.
    """
    by, many = as_list(by), not isinstance(horizon, int)
    g = ipcw(df, time, event, by)
    framed = df.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizon]))) if many else df
    until, parts = (F.col("horizon"), [*by, "horizon"]) if many else (F.lit(horizon), by)
    case = (F.col(event) == 1) & (F.col(time) <= until)
    rows, span = keyed(framed.where(F.col(event).isNotNull() & (case | (F.col(time) > until))), score, digits)
    rows = rows.select(*parts, time, case.alias("_case"), "_s")
    weighted = lookup_join(rows, g.select(*by, F.col("time").alias(time), "g_before"), [*by, time])
    out = parts
    if not parts:
        weighted, parts = weighted.withColumn("_all", F.lit(0)), ["_all"]
    per_score = weighted.groupBy(*parts, "_s").agg(
        F.sum(F.when(F.col("_case"), F.try_divide(F.lit(1.0), F.col("g_before"))).otherwise(F.lit(0.0))).alias("_w"),
        F.count_if("_case").alias("_nc"),
        F.count_if(~F.col("_case")).alias("_n0"),
    )
    ranked = sum_below(per_score, parts, "_s", "_n0", span, "_below")
    won = F.sum(F.col("_w") * (F.col("_below") + F.col("_n0") / F.lit(2.0)))
    auc = ranked.groupBy(*parts).agg(
        F.sum("_nc").alias("n_cases"), F.sum("_n0").alias("n_controls"),
        F.try_divide(won, F.sum("_w") * F.sum("_n0").cast("double")).alias("auc"),
    )
    return auc.select(*out, "n_cases", "n_controls", "auc")


def risk_bins(df: DataFrame, p: str, bins: int, by: str | Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """Bin per distinct prediction (``_s``), near-equal in rows; equal predictions share a bin."""
    return _bins(*keyed(df, p, digits), bins, as_list(by))


def _bins(rows: DataFrame, span: int, bins: int, by: list[str]) -> DataFrame:
    parts = by or ["_all"]
    framed = rows if by else rows.withColumn("_all", F.lit(0))
    counts = framed.groupBy(*parts, "_s").agg(F.count(F.lit(1)).alias("_n"))
    ranked = sum_below(counts, parts, "_s", "_n", span, "_before")
    if by:
        totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
        ranked = attach(ranked, totals, by, small=False, how="inner")
    else:  # one number; joining it would be a join without a key
        ranked = ranked.withColumn("_total", F.lit(int(counts.agg(F.sum("_n")).first()[0] or 0)))
    binned = F.floor(F.col("_before") * F.lit(float(bins)) / F.col("_total")).cast("int") + 1
    return ranked.select(*by, "_s", binned.alias("bin"))


def calibration(
    df: DataFrame,
    p: str,
    horizon: int | Sequence[int],
    bins: int = 10,
    time: str = "time",
    event: str = "event",
    by: str | Sequence[str] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Mean predicted risk against Kaplan-Meier risk at the horizon, by risk bin (K3).

    Several horizons share the bins and the curves and give a row each, with a column ``horizon``.
    """
    many = not isinstance(horizon, int)
    by = as_list(by)
    rows, span = keyed(df, p, digits)
    rows = rows.select(*by, time, event, p, "_s")
    binned = lookup_join(rows, _bins(rows, span, bins, by), [*by, "_s"])
    parts = [*by, "bin"]
    predicted = binned.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"))
    observed = surv_at(km(binned, time, event, parts), list(horizon) if many else [horizon], parts)
    out = attach(predicted, observed, parts, small=False, how="inner")
    return out.select(*parts, *(["horizon"] if many else []), "n", "predicted", (F.lit(1.0) - F.col("survival")).alias("observed"))


def _decisions(counts: DataFrame, parts: Sequence[str], cuts: Sequence[float], cost_fn: float, cost_fp: float):
    """Confusion counts per cut from counts per (part, number of cuts reached)."""
    at = lambda i, col: F.sum(F.when(F.col("_reached") > i, F.col(col)).otherwise(F.lit(0)))
    sums = counts.groupBy(*parts).agg(
        F.sum("_pos").alias("_p"),
        F.sum("_neg").alias("_q"),
        *[at(i, "_pos").alias(f"_tp{i}") for i in range(len(cuts))],
        *[at(i, "_neg").alias(f"_fp{i}") for i in range(len(cuts))],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(c)).alias("cut"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp"),
                (F.col("_p") - F.col(f"_tp{i}")).alias("fn"), (F.col("_q") - F.col(f"_fp{i}")).alias("tn"),
            )
            for i, c in enumerate(cuts)
        ]
    )
    long = sums.select(*parts, F.inline(rows))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return long.withColumns(
        {
            "sensitivity": ratio("tp", "fn"),
            "specificity": ratio("tn", "fp"),
            "ppv": ratio("tp", "fp"),
            "cost": F.col("fn") * F.lit(float(cost_fn)) + F.col("fp") * F.lit(float(cost_fp)),
        }
    )


def _reached(df: DataFrame, p: str, label: str, cuts: Sequence[float], by: Sequence[str]) -> DataFrame:
    steps = sum((F.when(F.col(p) >= F.lit(float(c)), 1).otherwise(0) for c in cuts), F.lit(0))
    known = df.where(F.col(label).isNotNull() & F.col(p).isNotNull())
    return known.groupBy(*by, steps.alias("_reached")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )


def decision_table(
    df: DataFrame,
    p: str,
    label: str,
    cuts: Sequence[float],
    costs: tuple[float, float] = (1.0, 1.0),
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Counts, sensitivity, specificity, PPV and cost (per missed, per false alarm) by cutoff (K4).

    Rows are counted by how many cutoffs they reach, so no row is repeated per cutoff.
    """
    by, cuts = as_list(by), sorted(cuts)
    return _decisions(_reached(df, p, label, cuts, by), by, cuts, *costs)


def decision_by_subgroups(
    df: DataFrame,
    p: str,
    label: str,
    cuts: Sequence[float],
    columns: Sequence[str],
    costs: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """``decision_table`` overall, for each column on its own, from one pass (K5).

    The data is counted once by all columns together; the per-subgroup tables add up those
    counts with grouping sets.
    """
    cuts, columns = sorted(cuts), list(columns)
    fine = _reached(df, p, label, cuts, columns)
    sets = [[F.col(c), F.col("_reached")] for c in columns] + [[F.col("_reached")]]
    grouped = fine.groupingSets(sets, *[F.col(c) for c in columns], F.col("_reached")).agg(
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"),
        *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(columns)],
    )
    name, level = F.lit("all"), F.lit("all")
    for i, c in enumerate(columns):
        name = F.when(F.col(f"_g{i}") == 0, F.lit(c)).otherwise(name)
        level = F.when(F.col(f"_g{i}") == 0, F.col(c).cast("string")).otherwise(level)
    parts = ["subgroup", "level"]
    counts = grouped.select(name.alias("subgroup"), level.alias("level"), "_reached", "_pos", "_neg")
    return _decisions(counts, parts, cuts, *costs)


def by_subgroup(
    metric: Callable[[DataFrame, list[str]], DataFrame], df: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Any metric overall and within each column's levels, stacked (K5).

    ``metric(df, by)`` must return the ``by`` columns and its own.
    """
    out = None
    for column in [None, *columns]:
        one = metric(df, [column] if column else [])
        values = [c for c in one.columns if c != column]
        level = F.col(column).cast("string") if column else F.lit("all")
        one = one.select(F.lit(column or "all").alias("subgroup"), level.alias("level"), *values)
        out = one if out is None else out.unionByName(one)
    return out


def fairness_gap(metrics: DataFrame, group: str | Sequence[str], values: Sequence[str]) -> DataFrame:
    """Largest, smallest and their gap for each metric across the levels of each group (K6)."""
    long = metrics.unpivot(as_list(group), list(values), "metric", "value")
    return long.groupBy(*as_list(group), "metric").agg(
        F.count("value").alias("n_levels"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
        (F.max("value") - F.min("value")).alias("gap"),
    )


def group_cutoffs(df: DataFrame, p: str, label: str, group: str | Sequence[str], sensitivity: float) -> DataFrame:
    """Per group the highest cutoff that reaches a sensitivity, and what it gives: alarms equally sensitive for all (K6).

    Rows are counted by distinct prediction; a group without positives has no cutoff. Rows without a label or a prediction are left out.
    """
    by = as_list(group)
    rows, span = keyed(df.where(F.col(label).isNotNull()), p, None)
    counts = rows.groupBy(*by, "_s", p).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    ranked = sums_below(counts, by, "_s", {"_pos_below": "_pos", "_neg_below": "_neg"}, span)
    totals = counts.groupBy(*by).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    both = attach(ranked, totals, by, small=False, how="inner")
    found = F.col("n_pos") - F.col("_pos_below")
    reached = (F.col("n_pos") > 0) & (found >= F.lit(float(sensitivity)) * F.col("n_pos"))
    best = F.max(F.when(reached, F.struct(F.col(p).alias("cut"), found.alias("tp"), F.col("_neg_below").alias("tn")))).alias("_best")
    out = both.groupBy(*by, "n_pos", "n_neg").agg(best)
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return out.select(*by, "n_pos", "n_neg", F.col("_best.cut").alias("cut"), ratio("_best.tp", "n_pos").alias("sensitivity"), ratio("_best.tn", "n_neg").alias("specificity")).withColumn(
        "specificity", F.when(F.col("cut").isNotNull(), F.col("specificity"))
    )


def banded(df: DataFrame, column: str, cuts: Sequence[float], out: str) -> DataFrame:
    """A number as a subgroup (K5): ``out`` is the band between two cuts that it lies in, the lower one included; null stays null."""
    cuts = [float(c) for c in sorted(cuts)]
    names = [f"< {cuts[0]:g}", *[f"{a:g} to {b:g}" for a, b in zip(cuts, cuts[1:])], f">= {cuts[-1]:g}"]
    x, band = F.col(column).cast("double"), F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        band = F.when(x < F.lit(cut), F.lit(name)).otherwise(band)
    return df.withColumn(out, F.when(x.isNotNull(), band))


def compare(a: DataFrame, b: DataFrame, on: str | Sequence[str], values: Sequence[str]) -> DataFrame:
    """Metric differences, model minus comparator, paired on ``on`` (K7)."""
    on = as_list(on)
    left = a.select(*on, *[F.col(v).alias(f"{v}_model") for v in values])
    right = b.select(*on, *[F.col(v).alias(f"{v}_comparator") for v in values])
    both = attach(left, right, on, small=False, how="inner")
    return both.withColumns({f"{v}_diff": F.col(f"{v}_model") - F.col(f"{v}_comparator") for v in values})


def poisson_edges() -> list[float]:
    """Cumulative Poisson(1) probabilities of 0, 1, ... 11."""
    masses = [math.exp(-1.0) / math.factorial(k) for k in range(12)]
    return [math.fsum(masses[: k + 1]) for k in range(12)]


def poisson_weight(id: str, rep: str, salt: str = "boot") -> Column:
    """A Poisson(1) draw fixed by (entity, replicate), from the hash's place in the distribution."""
    u = hash32(F.concat(F.col(rep).cast("string"), F.lit(":"), F.col(id).cast("string")), salt) / F.lit(float(SPAN))
    weight = F.lit(12)
    for k, upper in reversed(list(enumerate(poisson_edges()))):
        weight = F.when(u < F.lit(upper), F.lit(k)).otherwise(weight)
    return weight


def bootstrap_difference(
    df: DataFrame, id: str, label: str, model: str, comparator: str, reps: int = 50, level: float = 0.95
) -> DataFrame:
    """Interval for the difference in mean squared error of two predictions (K7).

    Rows are repeated per replicate only inside the map tasks, which send one partial sum
    per replicate. The draws do not depend on partitioning, so a rerun gives the same interval.
    """
    known = df.where(F.col(label).isNotNull() & F.col(model).isNotNull() & F.col(comparator).isNotNull())
    error = lambda p: F.pow(F.col(p) - F.col(label), F.lit(2.0))
    rows = known.select(F.col(id).alias("_id"), (error(model) - error(comparator)).alias("_d"))
    # Replicate -1 weighs every row once, so that the plain difference comes from the same pass.
    drawn = rows.withColumn("_rep", F.explode(F.sequence(F.lit(-1), F.lit(reps - 1))))
    drawn = drawn.withColumn("_w", F.when(F.col("_rep") < 0, F.lit(1)).otherwise(poisson_weight("_id", "_rep")))
    per_rep = drawn.groupBy("_rep").agg(
        F.try_divide(F.sum(F.col("_d") * F.col("_w")), F.sum("_w").cast("double")).alias("_b")
    )
    draws = F.array_sort(F.collect_list(F.when(F.col("_rep") >= 0, F.col("_b"))))
    out = per_rep.agg(F.max(F.when(F.col("_rep") < 0, F.col("_b"))).alias("difference"), draws.alias("_draws"))
    lo = int((1 - level) / 2 * (reps - 1))
    return out.select("difference", F.col("_draws")[lo].alias("lower"), F.col("_draws")[reps - 1 - lo].alias("upper"))


def replicated(df: DataFrame, id: str, columns: Sequence[str], reps: int) -> tuple[DataFrame, list[str]]:
    """``columns`` with a weight per replicate, written, and the weights' names; the first replicate weighs every row once.

    A row's weights are Poisson draws fixed by its entity, so all metrics and all models see the
    same replicates, on every run.
    """
    hashed = lambda r: hash32(F.concat(r.cast("string"), F.lit(":"), F.col(id).cast("string")), "boot") / F.lit(float(SPAN))
    drawn = df.withColumn("_u", F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), hashed))
    reached = lambda k: sum((F.when(F.col("_u")[k] >= F.lit(e), 1).otherwise(0) for e in poisson_edges()), F.lit(0))
    names = [f"_w{k}" for k in range(reps + 1)]
    weights = [F.lit(1).alias("_w0"), *[reached(k).alias(f"_w{k + 1}") for k in range(reps)]]
    return materialized(drawn.select(*columns, *weights)), names


def _weighted_cindex(rows: DataFrame, score: str, time: str, event: str, names: Sequence[str]) -> DataFrame:
    """One row, ``values``: the concordance index under every weight; a pair weighs the product of its rows' weights.

    ``cindex`` with a column per weight: rows are counted by (code, score) first, and all weights
    go through the digits of the codes, the running sums and the totals together.
    """
    known, span = keyed(rows, score, None)
    coded = known.withColumn("_code", F.col(time).cast("bigint") * 2 + (1 - F.col(event).cast("bigint")))
    limits = coded.agg(F.min("_code").alias("lo"), F.max("_code").alias("hi")).first()
    least = int(limits["lo"] or 0) // 2 * 2
    levels = max((int(limits["hi"] or 0) - least).bit_length(), 1)
    counted = coded.groupBy((F.col("_code") - F.lit(least)).alias("_code"), "_s").agg(*[F.sum(n).alias(n) for n in names])
    spread = counted.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    upper = F.expr("shiftright(_code, _level) & 1") == 1
    lower = ~upper & (F.col("_code") % 2 == 0)
    spread = spread.where(upper | lower).select("_level", F.expr("shiftright(_code, _level + 1)").alias("_prefix"), "_s", upper.alias("_up"), *names)
    parts, zero = ["_level", "_prefix"], F.lit(0)
    sides = spread.groupBy(*parts, "_s").agg(
        *[F.sum(F.when(F.col("_up"), zero).otherwise(F.col(n))).alias(f"_l{n}") for n in names],
        *[F.sum(F.when(F.col("_up"), F.col(n)).otherwise(zero)).alias(f"_r{n}") for n in names],
    )
    ranked = sums_below(sides, parts, "_s", {f"_b{n}": f"_r{n}" for n in names}, span)
    wide = lambda c: F.col(c).cast("double")
    per_part = ranked.groupBy(*parts).agg(
        *[F.sum(wide(f"_l{n}") * (wide(f"_b{n}") + wide(f"_r{n}") / 2.0)).alias(f"_c{n}") for n in names],
        *[(F.sum(wide(f"_l{n}")) * F.sum(wide(f"_r{n}"))).alias(f"_p{n}") for n in names],
    )
    return per_part.agg(F.array(*[F.try_divide(F.sum(f"_c{n}"), F.sum(f"_p{n}")) for n in names]).alias("values"))


def _weighted_auc(rows: DataFrame, score: str, case: Column, weight: str, names: Sequence[str]) -> DataFrame:
    """One row, ``values``: AUROC under every replicate's weights; a case also weighs ``weight``, and controls weigh alike."""
    known, span = keyed(rows, score, None, len(names))
    per_score = known.groupBy("_s").agg(
        *[F.sum(F.when(case, F.col(n) * F.col(weight)).otherwise(F.lit(0.0))).alias(f"_l{n}") for n in names],
        *[F.sum(F.when(case, F.lit(0)).otherwise(F.col(n))).alias(f"_r{n}") for n in names],
    )
    ranked = sums_below(per_score.withColumn("_all", F.lit(0)), ["_all"], "_s", {f"_b{n}": f"_r{n}" for n in names}, span, len(names))
    won = lambda n: F.sum(F.col(f"_l{n}") * (F.col(f"_b{n}") + F.col(f"_r{n}") / F.lit(2.0)))
    value = lambda n: F.try_divide(won(n), F.sum(f"_l{n}") * F.sum(f"_r{n}").cast("double"))
    return ranked.agg(F.array(*[value(n) for n in names]).alias("values"))


def _interval(model: DataFrame, comparator: DataFrame, reps: int, level: float) -> DataFrame:
    """(model, comparator, difference, lower, upper) from the two models' values in every replicate."""
    both = model.withColumn("_model", F.lit(True)).unionByName(comparator.withColumn("_model", F.lit(False)))
    pair = both.agg(F.max(F.when(F.col("_model"), F.col("values"))).alias("m"), F.max(F.when(~F.col("_model"), F.col("values"))).alias("c"))
    pair = pair.withColumn("d", F.zip_with("m", "c", lambda m, c: m - c))
    draws = F.array_sort(F.slice("d", 2, reps))
    lo = int((1 - level) / 2 * (reps - 1))
    return pair.select(
        F.col("m")[0].alias("model"), F.col("c")[0].alias("comparator"), F.col("d")[0].alias("difference"),
        draws[lo].alias("lower"), draws[reps - 1 - lo].alias("upper"),
    )


def bootstrap_cindex(
    df: DataFrame, id: str, model: str, comparator: str, time: str = "time", event: str = "event", reps: int = 50, level: float = 0.95
) -> DataFrame:
    """Interval for the difference in concordance of two scores (K7), in one pass over the rows for all replicates.

    Rows without a time, an event or either score take no part.
    """
    known = df.dropna(subset=[time, event, model, comparator])
    rows, names = replicated(known, id, [time, event, model, comparator], reps)
    return _interval(*(_weighted_cindex(rows, s, time, event, names) for s in (model, comparator)), reps, level)


def _at_horizon(df: DataFrame, id: str, horizon: int, model: str, comparator: str, time: str, event: str, reps: int) -> tuple[DataFrame, list[str]]:
    """Rows whose state at the horizon is known, with ``_case``, ``_g`` (1 over the chance of being followed) and the weights."""
    known = df.dropna(subset=[time, event, model, comparator])
    g = ipcw(known, time, event, [])
    case = (F.col(event) == 1) & (F.col(time) <= horizon)
    rows = known.where(case | (F.col(time) > horizon)).withColumn("_at", F.when(case, F.col(time)).otherwise(F.lit(None)))
    followed = g.where(F.col("time") <= horizon).agg(F.max_by("g_at", "time")).first()[0]  # one number
    rows = lookup_join(rows, g.select(F.col("time").alias("_at"), "g_before"), ["_at"])
    late = F.lit(1.0 if followed is None else float(followed))
    rows = rows.withColumns({"_case": case, "_g": F.try_divide(F.lit(1.0), F.when(case, F.col("g_before")).otherwise(late))})
    return replicated(rows, id, [model, comparator, "_case", "_g"], reps)


def bootstrap_auc(
    df: DataFrame, id: str, horizon: int, model: str, comparator: str, time: str = "time", event: str = "event", reps: int = 50, level: float = 0.95
) -> DataFrame:
    """Interval for the difference in AUROC at a horizon, weighted for censoring (K7).

    The censoring weights are those of all rows, in every replicate.
    """
    rows, names = _at_horizon(df, id, horizon, model, comparator, time, event, reps)
    return _interval(*(_weighted_auc(rows, s, F.col("_case"), "_g", names) for s in (model, comparator)), reps, level)


def bootstrap_brier(
    df: DataFrame, id: str, horizon: int, model: str, comparator: str, time: str = "time", event: str = "event", reps: int = 50, level: float = 0.95
) -> DataFrame:
    """Interval for the difference in the Brier score at a horizon, weighted for censoring (K7).

    Scores are risks by the horizon. A case weighs 1 over the chance of being followed until just
    before its time, a row followed past the horizon 1 over that until the horizon; others, censored before,
    count as rows only. The mean is over a replicate's rows whose state is known, by those weights.
    """
    rows, names = _at_horizon(df, id, horizon, model, comparator, time, event, reps)
    error = lambda s: F.pow(F.col(s) - F.when(F.col("_case"), 1.0).otherwise(0.0), F.lit(2.0)) * F.col("_g")
    value = lambda s, n: F.try_divide(F.sum(error(s) * F.col(n)), F.sum(F.col("_g") * F.col(n)))
    values = lambda s: rows.agg(F.array(*[value(s, n) for n in names]).alias("values"))
    return _interval(values(model), values(comparator), reps, level)


def meets_threshold(metrics: DataFrame, limits: Mapping[str, float], metric: str = "metric", value: str = "value") -> DataFrame:
    """Whether each metric reaches the level stated as useful (K8); null where none is stated."""
    limit = F.lit(None).cast("double")
    for name, least in limits.items():
        limit = F.when(F.col(metric) == F.lit(name), F.lit(float(least))).otherwise(limit)
    return metrics.withColumns({"threshold": limit, "is_met": (F.col(value) >= limit).cast("int")})


def detection_delay(
    crossing: DataFrame, detected: DataFrame, *, id: str, crossed_t: str, detected_t: str, keep: Sequence[str] = (),
    group_rows: int | None = None,
) -> DataFrame:
    """Days from first meeting a criterion to first being acted on (K9); null if never acted on."""
    first = crossing.groupBy(id, *keep).agg(F.min(crossed_t).alias("_c"))
    # Only actions on or after the crossing count, so they are reduced after the join.
    acted = detected.select(id, F.col(detected_t).alias("_d"))
    found = skew_join(acted, first.select(id, "_c"), id, "inner", group_rows).where(F.col("_d") >= F.col("_c"))
    found = found.groupBy(id).agg(F.min("_d").alias("_d"))
    return first.join(found, id, "left").select(id, *keep, days_between("_d", "_c").alias("delay_days"))


def delay_summary(delays: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Counts and quartiles of delay. Delays are whole days, so few distinct values per group."""
    days = F.col("delay_days")
    return delays.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(days).alias("n_detected"),
        F.percentile(days, 0.25).alias("delay_q1"),
        F.percentile(days, 0.5).alias("delay_median"),
        F.percentile(days, 0.75).alias("delay_q3"),
    )


def surveillance_load(
    cohort: DataFrame, tier: str, plan: Mapping[str, int], fixed_days: int, until_days: int
) -> DataFrame:
    """Scheduled visits per tier under a fixed and a tier-based plan.

    A schedule's length is a division, so no grid is built to count it.
    """
    every = F.lit(None).cast("int")
    for name, days in plan.items():
        every = F.when(F.col(tier) == F.lit(name), F.lit(int(days))).otherwise(every)
    counts = cohort.groupBy(tier).agg(F.count(F.lit(1)).alias("n"))
    out = counts.select(
        tier,
        "n",
        (F.col("n") * F.lit(until_days // fixed_days)).alias("visits_fixed"),
        (F.col("n") * F.floor(F.lit(until_days) / every)).alias("visits_planned"),
    )
    return out.withColumn("visits_difference", F.col("visits_planned") - F.col("visits_fixed"))
