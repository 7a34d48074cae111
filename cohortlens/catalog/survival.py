"""Survival estimators (group H)."""

from __future__ import annotations

from cohortlens.catalog import base
from cohortlens.catalog.base import LEVEL, RISE, SEGMENTS, r6, rd, sql
from cohortlens.operators import survival
from cohortlens.plans.flows import crossing_curves

THREE = SEGMENTS[:3]
HORIZONS = (365, 730, 1461, 1826)


def _flagship(spark, d):
    """How does time to the first threshold crossing differ by subgroup?"""
    visits = base.visits(spark, d).select("id", "t", "vk", "x")
    curves = crossing_curves(visits, base.patients(spark, d), "segment", id="id", order=["t", "vk"], x="x", rise=RISE, level=LEVEL)
    return r6(curves)


def _table(spark, d):
    return base.survival(spark, d).select("id", "segment", "site", "time", "event")


def _cif(spark, d):
    return r6(survival.cif(base.competing_table(spark, d), [1, 2], by="site"))


def _logrank2(spark, d):
    return r6(survival.logrank(_table(spark, d), "segment", ["BUILDING", "MACHINERY"]))


def _logrank3(spark, d):
    return r6(survival.logrank(_table(spark, d), "segment", THREE))


def _logrank5(spark, d):
    return r6(survival.logrank(_table(spark, d), "segment", SEGMENTS))


QUERIES = {
    "H1_km_flagship": _flagship,
    "H1_km": lambda s, d: r6(survival.km(_table(s, d))),
    "H2_km_ci": lambda s, d: r6(survival.km_ci(_table(s, d), by="site")),
    "H3_nelson_aalen": lambda s, d: r6(survival.nelson_aalen(_table(s, d), by="segment"), 9),
    "H4_cif": _cif,
    "H5_logrank": _logrank2,
    "H5_logrank_many": _logrank3,
    "H5_logrank_all": _logrank5,
    "H6_surv_at": lambda s, d: r6(survival.surv_at(survival.km(_table(s, d), by="segment"), HORIZONS, "segment")),
    "H6_median_survival": lambda s, d: survival.median_survival(survival.km(_table(s, d), by="segment"), "segment"),
    "H7_ipcw": lambda s, d: r6(survival.ipcw(_table(s, d), by="site")),
}


def life_table(by: str, source: str = "surv") -> dict[str, str]:
    """Counts and numbers at risk, the latter by comparing every time with every later one."""
    return {
        "cnt": f"SELECT {by} AS g, time, count(*) FILTER (event = 1) AS d, count(*) FILTER (event <> 1) AS c FROM {source} GROUP BY 1, 2",
        "lt": "SELECT a.g, a.time, any_value(a.d) AS d, any_value(a.c) AS c, CAST(sum(b.d + b.c) AS BIGINT) AS n FROM cnt a "
        "JOIN cnt b ON b.g = a.g AND b.time >= a.time GROUP BY a.g, a.time",
        # The product up to a time, as a product over an inequality join.
        "kmc": "SELECT a.g, a.time, any_value(a.n) AS n, any_value(a.d) AS d, any_value(a.c) AS c, product(1.0 - b.d / b.n ORDER BY b.time) AS s, "
        "sum(CASE WHEN b.n > b.d THEN b.d / (b.n::DOUBLE * (b.n - b.d)) END ORDER BY b.time) AS gw, sum(b.d / b.n ORDER BY b.time) AS na, "
        "sum(b.d / (b.n::DOUBLE * b.n) ORDER BY b.time) AS nv FROM lt a JOIN lt b ON b.g = a.g AND b.time <= a.time GROUP BY a.g, a.time",
    }


_THETA = f"{survival.Z95!r}::DOUBLE * sqrt(gw) / ln(s)"

SQL = {
    "H1_km_flagship": sql(
        "surv", f"SELECT g AS segment, time, n AS at_risk, d AS n_event, c AS n_censor, {rd('s')} AS survival FROM kmc", **life_table("segment")
    ),
    "H1_km": sql("surv", f"SELECT time, n AS at_risk, d AS n_event, c AS n_censor, {rd('s')} AS survival FROM kmc", **life_table("0")),
    "H2_km_ci": sql(
        "surv",
        f"SELECT g AS site, time, n AS at_risk, d AS n_event, {rd('s')} AS survival, {rd('CASE WHEN s > 0 THEN s * sqrt(gw) END')} AS std_error, "
        f"{rd(f'CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(-({_THETA}))) END')} AS lower, "
        f"{rd(f'CASE WHEN s > 0 AND s < 1 THEN pow(s, exp({_THETA})) END')} AS upper FROM kmc",
        **life_table("site"),
    ),
    "H3_nelson_aalen": sql(
        "surv",
        f"SELECT g AS segment, time, n AS at_risk, d AS n_event, {rd('na', 9)} AS cum_hazard, {rd('nv', 9)} AS variance FROM kmc",
        **life_table("segment"),
    ),
    "H4_cif": sql(
        "comp",
        f"SELECT a.g AS site, a.time, any_value(a.n) AS at_risk, CAST(k AS INTEGER) AS cause, CAST(any_value(CASE WHEN k = 1 THEN a.d1 ELSE a.d2 END) AS BIGINT) AS n_cause, "
        f"{rd('sum(b.before * CASE WHEN k = 1 THEN b.d1 ELSE b.d2 END / b.n ORDER BY b.time)')} AS incidence "
        "FROM st a JOIN st b ON b.g = a.g AND b.time <= a.time, (VALUES (1), (2)) q(k) GROUP BY a.g, a.time, k",
        cnt="SELECT site AS g, time, count(*) FILTER (cause = 1) AS d1, count(*) FILTER (cause = 2) AS d2, count(*) AS m FROM comp GROUP BY 1, 2",
        lt="SELECT a.g, a.time, any_value(a.d1) AS d1, any_value(a.d2) AS d2, CAST(sum(b.m) AS BIGINT) AS n FROM cnt a "
        "JOIN cnt b ON b.g = a.g AND b.time >= a.time GROUP BY a.g, a.time",
        st="SELECT a.*, coalesce((SELECT product(1.0 - (b.d1 + b.d2) / b.n ORDER BY b.time) FROM lt b WHERE b.g = a.g AND b.time < a.time), 1.0) AS before FROM lt a",
    ),
    "H6_surv_at": sql(
        "surv",
        f"SELECT segment, CAST(h AS INTEGER) AS horizon, {rd('coalesce((SELECT k.s FROM kmc k WHERE k.g = segment AND k.time <= h ORDER BY k.time DESC LIMIT 1), 1.0)')} AS survival "
        f"FROM (SELECT DISTINCT segment FROM surv), (VALUES {', '.join(f'({h})' for h in HORIZONS)}) q(h)",
        **life_table("segment"),
    ),
    "H6_median_survival": sql(
        "surv", "SELECT g AS segment, min(time) FILTER (s <= 0.5) AS median_time FROM kmc GROUP BY g", **life_table("segment")
    ),
    "H7_ipcw": sql(
        "surv",
        f"SELECT a.g AS site, a.time, {rd('coalesce(product(b.stay ORDER BY b.time) FILTER (b.time < a.time), 1.0)')} AS g_before, {rd('product(b.stay ORDER BY b.time)')} AS g_at "
        "FROM lt a JOIN (SELECT g, time, CASE WHEN n > d THEN 1.0 - c / (n - d) ELSE 1.0 END AS stay FROM lt) b ON b.g = a.g AND b.time <= a.time GROUP BY a.g, a.time",
        **{k: v for k, v in life_table("site").items() if k != "kmc"},
    ),
}


def _eliminated(groups) -> tuple[str, dict[str, str]]:
    """Chi-square as a sum over pivots, and the tables left of the covariance and the gaps after each."""
    names = ", ".join(f"'{g}'" for g in groups)
    steps = {"m0": f"SELECT c.g, c.h, c.v, t.o - t.e AS u FROM cov c JOIN tot t USING (g) WHERE c.g IN ({names}) AND c.h IN ({names})"}
    for i, g in enumerate(groups[:-1]):
        steps[f"m{i + 1}"] = (
            f"SELECT a.g, a.h, a.v - x.v * y.v / p.v AS v, a.u - x.v / p.v * p.u AS u FROM m{i} a JOIN m{i} x ON x.g = a.g AND x.h = '{g}' "
            f"JOIN m{i} y ON y.g = '{g}' AND y.h = a.h JOIN m{i} p ON p.g = '{g}' AND p.h = '{g}' WHERE a.g <> '{g}' AND a.h <> '{g}'"
        )
    return " + ".join(f"(SELECT u * u / v FROM m{i} WHERE g = '{g}' AND h = '{g}')" for i, g in enumerate(groups)), steps


def _logrank_sql(groups) -> str:
    """Chi-square through the variance of the first group, the closed inverse of the first two's covariance, or elimination."""
    names, steps = ", ".join(f"'{g}'" for g in groups), {}
    gap = lambda g: f"(SELECT o - e FROM tot WHERE g = '{g}')"
    cov = lambda g, h: f"(SELECT v FROM cov WHERE g = '{g}' AND h = '{h}')"
    if len(groups) == 2:
        chi = f"pow({gap(groups[0])}, 2) / {cov(groups[0], groups[0])}"
    elif len(groups) > 3:
        chi, steps = _eliminated(groups[:-1])
    else:
        a, b = groups[:2]
        chi = (
            f"(pow({gap(a)}, 2) * {cov(b, b)} - 2 * {gap(a)} * {gap(b)} * {cov(a, b)} + pow({gap(b)}, 2) * {cov(a, a)})"
            f" / ({cov(a, a)} * {cov(b, b)} - pow({cov(a, b)}, 2))"
        )
    return sql(
        "surv",
        f"SELECT g AS segment, CAST(o AS BIGINT) AS observed, {rd('e')} AS expected, {rd(chi)} AS chi2, CAST({len(groups) - 1} AS INTEGER) AS df FROM tot",
        s="SELECT segment AS g, time, event FROM surv WHERE segment IN (" + names + ")",
        times="SELECT time, count(*) AS d FROM s WHERE event = 1 GROUP BY time",
        risk=f"SELECT q.time, q.d, k.g, count(*) FILTER (s.g = k.g) AS r FROM times q JOIN s ON s.time >= q.time, (VALUES {', '.join(f'({g!r})' for g in groups)}) k(g) GROUP BY 1, 2, 3",
        full_="SELECT time, d, g, r, sum(r) OVER (PARTITION BY time) AS n FROM risk",
        tot="SELECT g, (SELECT count(*) FROM s WHERE s.g = f.g AND event = 1) AS o, sum(d * r / n ORDER BY time) AS e FROM full_ f GROUP BY g",
        cov="SELECT a.g, b.g AS h, sum(CASE WHEN a.n > 1 THEN a.d * (a.r / a.n) * (CASE WHEN a.g = b.g THEN 1.0 ELSE 0.0 END - b.r / b.n) * (a.n - a.d) / (a.n - 1) END ORDER BY a.time) AS v "
        "FROM full_ a JOIN full_ b ON a.time = b.time GROUP BY 1, 2",
        **steps,
    )


SQL["H5_logrank"] = _logrank_sql(("BUILDING", "MACHINERY"))
SQL["H5_logrank_many"] = _logrank_sql(THREE)
SQL["H5_logrank_all"] = _logrank_sql(SEGMENTS)
