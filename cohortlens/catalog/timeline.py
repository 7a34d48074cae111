"""Temporal alignment and features (groups D and E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import base
from cohortlens.catalog.base import PRIORITIES, day, r6, rd, sql
from cohortlens.operators import features, temporal
from cohortlens.operators.cohort import index_event
from cohortlens.operators.splits import split_entity
from cohortlens.plans.skew import skew_join
from cohortlens.session import materialized
from cohortlens.sources import load

ORDER = ["t", "vk"]
HORIZONS = (365, 730, 1826)
EVERY, UNTIL, TOL = 365, 1826, 60
LIMITS = {"STANDARD": (1500.0, 2000.0), "PROMO": (1400.0, 1900.0), "LARGE": (1300.0, 1800.0), "SMALL": (1200.0, 1700.0)}


def _value_at(how, ahead):
    def query(spark, d):
        return r6(temporal.value_at(
            base.gappy_visits(spark, d), base.cohort(spark, d), id="id", t="t", index="index_t", x="x",
            horizons=HORIZONS, back=180, ahead=ahead, how=how, tiebreak="vk",
        ))

    return query


def _asof(tolerance):
    def query(spark, d):
        """Each urgent order with the customer's latest finished one."""
        v = base.visits(spark, d)
        left = v.where(F.col("prio") == "1-URGENT").select("id", "t", "vk", "x")
        right = v.where(F.col("status") == "F").select("id", "t", "vk", "x")
        return r6(temporal.asof(left, right, by="id", t="t", left_order=["vk"], right_order=["vk"], tolerance_days=tolerance))

    return query


def _grid(spark, d):
    return r6(temporal.visit_grid(base.cohort(spark, d), "id", "index_t", EVERY, UNTIL))


def _missed(spark, d):
    c = base.cohort(spark, d).select("id", "index_t")
    grid = temporal.visit_grid(c, "id", "index_t", EVERY, UNTIL)
    return r6(temporal.missed_visits(grid, base.visits(spark, d), c, id="id", t="t", index="index_t",
                                     every_days=EVERY, tol_days=TOL))


def _missingness(spark, d):
    s = materialized(base.survival(spark, d))
    grid = temporal.visit_grid(s, "id", "index_t", EVERY, UNTIL)
    missed = temporal.missed_visits(grid, base.visits(spark, d), s, id="id", t="t", index="index_t", every_days=EVERY, tol_days=TOL)
    return r6(temporal.events_by_missingness(missed, s, id="id", every_days=EVERY, until_days=UNTIL))


def _locf(max_age):
    return lambda s, d: r6(
        temporal.locf(base.gappy_visits(s, d).select("id", "t", "vk", "x"), "id", ORDER, "x", max_age)
    )


def _gaps(spark, d):
    return r6(temporal.visit_gaps(base.visits(spark, d).select("id", "t", "vk"), "id", ORDER, 365))


def _gap_summary(spark, d):
    gaps = temporal.visit_gaps(base.visits(spark, d).select("id", "t", "vk"), "id", ORDER, 365)
    return r6(temporal.gap_summary(gaps, "id"))


def _progression(spark, d):
    # Slopes of prices in the hundred thousands agree between engines to about four decimals.
    return r6(features.progression(base.gappy_visits(spark, d), "id", "t", "x"), 3)


def _rate(spark, d):
    return r6(features.visit_rate(base.visits(spark, d).select("id", "t", "vk", "x"), "id", ORDER, "x"))


def _typed_lines(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    types = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return features.indexed(skew_join(lines, types, "l_partkey"), "l_extendedprice", "l_quantity", "unit_price")


def _indexed(spark, d):
    return r6(_typed_lines(spark, d))


def _mismatch(spark, d):
    graded = features.mismatch(_typed_lines(spark, d), "unit_price", "p_type", LIMITS)
    return graded.groupBy("p_type", "mismatch").agg(F.count(F.lit(1)).alias("n"))


def _baseline(spark, d):
    v = base.visits(spark, d).select("id", "vk", "x")
    index = index_event(base.visits(spark, d), "id", "t", ["x"], "vk")
    return r6(features.from_baseline(v, index, id="id", x="x", baseline="index_x"))


def _flags(spark, d):
    return features.missing_flags(base.gappy_visits(spark, d).select("id", "vk", "x", "prio"), ["x", "prio"])


def _impute(how, by):
    def query(spark, d):
        """Learn on the training entities, fill everyone."""
        v = skew_join(base.gappy_visits(spark, d).select("id", "vk", "x"), base.patients(spark, d).select("id", "site"), "id")
        v = split_entity(v, "id", {"train": 0.6, "test": 0.4}, "imp")
        fit = features.fit_impute(v.where(F.col("split") == "train"), ["x"], by, how)
        return r6(fit.apply(v))

    return query


def _pivot(spark, d):
    return features.pivot_flags(base.visits(spark, d), "id", "prio", PRIORITIES)


def _vector(spark, d):
    from pyspark.ml.functions import vector_to_array

    c = base.cohort(spark, d).select("id", "segment", "site", "balance", "index_x")
    model = features.feature_pipeline(["balance", "index_x"], ["segment", "site"]).fit(c)
    vector = vector_to_array("features")
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    return r6(model.transform(c).select("id", F.size(vector).alias("n_features"), total.alias("total")), 2)


QUERIES = {
    "D1_value_at_nearest": _value_at("nearest", 180),
    "D1_value_at_last": _value_at("last", 0),
    "D2_asof": _asof(None),
    "D2_asof_tolerance": _asof(365),
    "D3_visit_grid": _grid,
    "D4_missed_visits": _missed,
    "D4_events_by_missingness": _missingness,
    "D5_locf": _locf(None),
    "D5_locf_max_age": _locf(365),
    "D6_visit_gaps": _gaps,
    "D6_gap_summary": _gap_summary,
    "E1_progression": _progression,
    "E2_visit_rate": _rate,
    "E3_indexed": _indexed,
    "E4_mismatch": _mismatch,
    "E5_from_baseline": _baseline,
    "E6_missing_flags": _flags,
    "E7_impute_group_median": _impute("median", "site"),
    "E7_impute_mean": _impute("mean", None),
    "E8_pivot_flags": _pivot,
    "E9_feature_pipeline": _vector,
}


def _value_sql(how: str) -> str:
    hs = ", ".join(f"({h})" for h in HORIZONS)
    if how == "nearest":
        window, order = "BETWEEN horizon - 180 AND horizon + 180", "abs(day - horizon), t, vk"
    else:
        window, order = "BETWEEN horizon - 180 AND horizon", "t DESC, vk DESC"
    return sql(
        "gv coh",
        f"SELECT id, CAST(horizon AS INTEGER) AS horizon, CAST(day AS INTEGER) AS day, {rd('x')} AS x FROM grid LEFT JOIN "
        "(SELECT * FROM near WHERE k = 1) USING (id, horizon)",
        h=f"SELECT * FROM (VALUES {hs}) q(horizon)",
        grid="SELECT id, horizon FROM coh, h",
        dated="SELECT gv.id, gv.vk, gv.t, gv.x, date_diff('day', index_t, t) AS day FROM gv JOIN coh USING (id) WHERE x IS NOT NULL",
        near=f"SELECT *, row_number() OVER (PARTITION BY id, horizon ORDER BY {order}) AS k FROM dated JOIN h ON day {window}",
    )


def _asof_sql(tolerance: int | None) -> str:
    ok = "true" if tolerance is None else f"date_diff('day', r.t, l.t) <= {tolerance}"
    pick = lambda c: f"CASE WHEN {ok} THEN {c} END"
    # One right row per (id, t), the last by key, so that the match is unique.
    return sql(
        "v",
        f"SELECT l.id, {day('l.t')} AS t, l.vk, {rd('l.x')} AS x, {day(pick('r.t'))} AS t_asof, {pick('r.vk')} AS vk_asof, "
        f"{rd(pick('r.x'))} AS x_asof FROM v l ASOF LEFT JOIN r ON l.id = r.id AND l.t >= r.t WHERE l.prio = '1-URGENT'",
        r="SELECT id, t, max(vk) AS vk, arg_max(x, vk) AS x FROM v WHERE status = 'F' GROUP BY id, t",
    )


def _locf_sql(max_age: int | None) -> str:
    value = "p.x" if max_age is None else f"CASE WHEN date_diff('day', p.t, gv.t) <= {max_age} THEN p.x END"
    # The last observed visit is found by position, not by a null-skipping window.
    return sql(
        "gv",
        f"SELECT gv.id, {day('gv.t')} AS t, gv.vk, {rd('gv.x')} AS x, {rd(value)} AS x_locf FROM numbered gv LEFT JOIN numbered p "
        "ON p.id = gv.id AND p.pos = gv.src",
        pos_="SELECT id, t, vk, x, row_number() OVER (PARTITION BY id ORDER BY t, vk) AS pos FROM gv",
        numbered="SELECT *, max(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY id ORDER BY pos) AS src FROM pos_",
    )


_GAPS = {
    "g": "SELECT id, t, vk, CAST(date_diff('day', lag(t) OVER (PARTITION BY id ORDER BY t, vk), t) AS INTEGER) AS gap_days FROM v",
    "gaps": "SELECT id, t, vk, gap_days, max(gap_days) OVER (PARTITION BY id ORDER BY t, vk ROWS UNBOUNDED PRECEDING) AS max_gap_days, "
    "(SELECT count(*) FROM v o WHERE o.id = g.id AND o.t <= g.t AND date_diff('day', o.t, g.t) <= 365) AS n_recent FROM g",
}

_TYPED = "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, p_type, l_extendedprice / l_quantity AS unit_price FROM lineitem JOIN part ON l_partkey = p_partkey"


def _impute_sql(fit: str, by_site: bool) -> str:
    bucket = "CAST('0x' || substr(md5('imp' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT)"
    join = "LEFT JOIN fit USING (site)" if by_site else "CROSS JOIN fit"
    group = "GROUP BY site" if by_site else ""
    site = "site, " if by_site else ""
    return sql(
        "gv pat",
        f"SELECT r.id, r.vk, {rd('coalesce(r.x, fit.m)')} AS x, r.site, r.split FROM r {join}",
        r=f"SELECT gv.id, vk, x, site, CASE WHEN {bucket} < {int(0.6 * 2**32)} THEN 'train' ELSE 'test' END AS split FROM gv JOIN pat USING (id)",
        fit=f"SELECT {site}{fit} AS m FROM r WHERE split = 'train' AND x IS NOT NULL {group}",
    )


SQL = {
    "D1_value_at_nearest": _value_sql("nearest"),
    "D1_value_at_last": _value_sql("last"),
    "D2_asof": _asof_sql(None),
    "D2_asof_tolerance": _asof_sql(365),
    "D3_visit_grid": sql(
        "coh",
        f"SELECT id, CAST(slot AS INTEGER) AS slot, {day(f'index_t + to_days(CAST(slot * {EVERY} AS INTEGER))')} AS due "
        f"FROM coh, generate_series(1, {UNTIL // EVERY}) s(slot)",
    ),
    "D4_missed_visits": sql(
        "coh v",
        f"SELECT id, CAST(slot AS INTEGER) AS slot, {day(f'index_t + to_days(CAST(slot * {EVERY} AS INTEGER))')} AS due "
        f"FROM coh, generate_series(1, {UNTIL // EVERY}) s(slot) WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.id = coh.id AND "
        f"abs(date_diff('day', coh.index_t, v.t) - slot * {EVERY}) <= {TOL})",
    ),
    "D4_events_by_missingness": sql(
        "surv v",
        f"SELECT CASE WHEN due <= 0 THEN 'none due' WHEN gone = 0 THEN 'none' WHEN 2 * gone <= due THEN 'some' ELSE 'most' END AS status, count(*) AS n, "
        f"count(*) FILTER (event = 1) AS n_event, CAST(sum(time) AS BIGINT) AS days, {rd('count(*) FILTER (event = 1) * 36525.0::DOUBLE / sum(time)')} AS rate FROM "
        f"(SELECT *, least(time // {EVERY}, {UNTIL // EVERY}) AS due, (SELECT count(*) FROM generate_series(1, {UNTIL // EVERY}) s(slot) WHERE slot * {EVERY} <= surv.time "
        f"AND NOT EXISTS (SELECT 1 FROM v WHERE v.id = surv.id AND abs(date_diff('day', surv.index_t, v.t) - slot * {EVERY}) <= {TOL})) AS gone FROM surv) GROUP BY 1",
    ),
    "D5_locf": _locf_sql(None),
    "D5_locf_max_age": _locf_sql(365),
    "D6_visit_gaps": sql("v", f"SELECT id, {day('t')} AS t, vk, gap_days, max_gap_days, n_recent FROM gaps", **_GAPS),
    "D6_gap_summary": sql(
        "v",
        f"SELECT id, count(*) AS n_visits, max(gap_days) AS max_gap_days, {rd('avg(gap_days)')} AS mean_gap_days, "
        "max(n_recent) AS max_recent FROM gaps GROUP BY id",
        **_GAPS,
    ),
    "E1_progression": sql(
        "gv",
        "SELECT id, count(*) AS n_measures, "
        + rd("CASE WHEN count(DISTINCT t) > 1 THEN regr_slope(x, date_diff('day', DATE '1970-01-01', t) / 365.25::DOUBLE) END", 3)
        + " AS slope_per_year "
        "FROM gv WHERE x IS NOT NULL GROUP BY id",
    ),
    "E2_visit_rate": sql(
        "v",
        f"SELECT id, {day('t')} AS t, vk, x, {rd('dx / (nullif(dd, 0) / 365.25::DOUBLE)')} AS x_rate_per_year FROM "
        "(SELECT *, x - lag(x) OVER w AS dx, date_diff('day', lag(t) OVER w, t) AS dd FROM v "
        "WINDOW w AS (PARTITION BY id ORDER BY t, vk))",
    ),
    "E3_indexed": f"SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, p_type, {rd('unit_price')} AS unit_price FROM ({_TYPED})",
    "E4_mismatch": "SELECT p_type, CASE WHEN a IS NULL THEN NULL WHEN unit_price <= a THEN 'severe' WHEN unit_price <= b THEN 'moderate' "
    f"ELSE 'none' END AS mismatch, count(*) AS n FROM ({_TYPED}) LEFT JOIN (VALUES "
    + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in LIMITS.items())
    + ") m(p_type, a, b) USING (p_type) GROUP BY 1, 2",
    "E5_from_baseline": sql(
        "ranked",
        f"SELECT id, vk, x, index_x, {rd('x - index_x')} AS x_change, {rd('(x - index_x) / index_x')} AS x_change_share FROM "
        "(SELECT *, first(x) OVER (PARTITION BY id ORDER BY t, vk) AS index_x FROM ranked)",
    ),
    "E6_missing_flags": sql(
        "gv", "SELECT id, vk, x, prio, CAST(x IS NULL AS INTEGER) AS x_missing, CAST(prio IS NULL AS INTEGER) AS prio_missing FROM gv"
    ),
    "E7_impute_group_median": _impute_sql("quantile_cont(x, 0.5)", True),
    "E7_impute_mean": _impute_sql("avg(x)", False),
    # Two numbers, and for each category its levels plus one for unseen values; a row sets one of each.
    "E9_feature_pipeline": sql(
        "coh",
        "SELECT id, CAST((SELECT 4 + count(DISTINCT segment) + count(DISTINCT site) FROM coh) AS INTEGER) AS n_features, "
        f"{rd('balance + index_x + 2', 2)} AS total FROM coh",
    ),
    "E8_pivot_flags": sql(
        "v",
        "SELECT id, "
        + ", ".join(
            f"CAST(max(CASE WHEN prio = '{p}' THEN 1 ELSE 0 END) AS INTEGER) AS has_"
            + "".join(ch if ch.isalnum() else "_" for ch in p)
            for p in PRIORITIES
        )
        + " FROM v GROUP BY id",
    ),
}
