"""Evaluation (group K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import base
from cohortlens.catalog.base import r6, rd, sql
from cohortlens.catalog.survival import life_table
from cohortlens.operators import evaluation as ev
from cohortlens.operators.endpoints import horizon_value
from cohortlens.operators.scoring import risk_tier
from cohortlens.session import materialized

HORIZON = 1826
HORIZONS = (730, 1461, 1826)
CUTS = (0.2, 0.4, 0.6, 0.8)
PLAN = {"Low": 730, "Moderate": 365, "High": 180}
TIERS = (0.3, 0.7)
BALANCES, VISITS = (0.0, 5_000.0), (8, 15)
REPS = 40


def _pairs(df, by):
    """Pair counts as BIGINT; they are exact DECIMALs, since pairs outgrow 64 bits."""
    counts = {c: F.col(c).cast("bigint") for c in ("concordant", "tied", "comparable")}
    return r6(df.withColumns(counts).select(*by, *counts, "c_index"))


def _predictions(spark, d):
    """The scored table as a written one, since these metrics read it several times."""
    return materialized(base.scored(spark, d))


def _cindex(spark, d):
    return _pairs(ev.cindex(_predictions(spark, d)), [])


def _cindex_by(spark, d):
    return _pairs(ev.by_subgroup(lambda df, by: ev.cindex(df, by=by), _predictions(spark, d), ["segment", "site"]), ["subgroup", "level"])


def _auc(by):
    return lambda s, d: r6(ev.td_auc(_predictions(s, d), HORIZON, by=by))


def _calibration(spark, d):
    return r6(ev.calibration(_predictions(spark, d), "score", HORIZON, bins=5))


def _labelled(spark, d):
    return base.scored(spark, d).withColumn("label", horizon_value(F.col("time"), F.col("event"), HORIZON))


def _decision(spark, d):
    return r6(ev.decision_table(_labelled(spark, d), "score", "label", CUTS, (5.0, 1.0)))


def _subgroups(spark, d):
    return r6(ev.decision_by_subgroups(_labelled(spark, d), "score", "label", CUTS, ["segment", "site"], (5.0, 1.0)))


def _gap(spark, d):
    m = ev.decision_by_subgroups(_labelled(spark, d), "score", "label", [0.4], ["segment", "site"]).where("subgroup <> 'all'")
    return r6(ev.fairness_gap(m, "subgroup", ["sensitivity", "specificity"]))


def _bands(spark, d):
    rows = ev.banded(ev.banded(_labelled(spark, d), "balance", BALANCES, "balance_band"), "n_visits", VISITS, "visits_band")
    return r6(ev.decision_by_subgroups(rows, "score", "label", [0.4], ["balance_band", "visits_band"], (5.0, 1.0)))


def _cutoffs(spark, d):
    return r6(ev.group_cutoffs(materialized(_labelled(spark, d)), "score", "label", "site", 0.8))


def _metrics(labelled, score):
    return ev.decision_table(labelled, score, "label", CUTS, by="site").select("site", "cut", "sensitivity", "specificity")


def _compare(spark, d):
    rows = materialized(_labelled(spark, d))
    return r6(ev.compare(_metrics(rows, "score"), _metrics(rows, "other"), ["site", "cut"], ["sensitivity", "specificity"]))


def _bootstrap(spark, d):
    return r6(ev.bootstrap_difference(_labelled(spark, d), "id", "label", "score", "other", reps=REPS))


def _bootstrap_of(metric, *horizon):
    return lambda s, d: r6(metric(base.scored(s, d), "id", *horizon, "score", "other", reps=REPS))


def _threshold(spark, d):
    wide = ev.decision_table(_labelled(spark, d), "score", "label", [0.4], by="site")
    long = wide.unpivot(["site"], ["sensitivity", "specificity", "ppv"], "metric", "value")
    return r6(ev.meets_threshold(long, {"sensitivity": 0.7, "specificity": 0.4}))


def _delays(spark, d):
    """From first crossing to the customer's next urgent order."""
    crossed = base.crossings(spark, d).where("flag = 1").select("id", "t")
    acted = base.visits(spark, d).where("prio = '1-URGENT'").select("id", "t")
    return ev.detection_delay(crossed, acted, id="id", crossed_t="t", detected_t="t")


def _delay_summary(spark, d):
    by = _delays(spark, d).join(base.patients(spark, d).select("id", "site"), "id")
    return r6(ev.delay_summary(by, "site"))


def _load(spark, d):
    return ev.surveillance_load(risk_tier(base.scored(spark, d), "score", TIERS), "tier", PLAN, 365, 3650)


QUERIES = {
    "K1_cindex": _cindex,
    "K2_td_auc": _auc(None),
    "K2_td_auc_by_site": _auc("site"),
    "K2_td_auc_horizons": lambda s, d: r6(ev.td_auc(_predictions(s, d), HORIZONS)),
    "K3_calibration": _calibration,
    "K3_calibration_horizons": lambda s, d: r6(ev.calibration(_predictions(s, d), "score", HORIZONS, bins=5)),
    "K4_decision_table": _decision,
    "K5_decision_by_subgroups": _subgroups,
    "K5_decision_by_bands": _bands,
    "K5_cindex_by_subgroup": _cindex_by,
    "K6_fairness_gap": _gap,
    "K6_group_cutoffs": _cutoffs,
    "K7_compare": _compare,
    "K7_bootstrap_difference": _bootstrap,
    "K7_bootstrap_cindex": _bootstrap_of(ev.bootstrap_cindex),
    "K7_bootstrap_auc": _bootstrap_of(ev.bootstrap_auc, HORIZON),
    "K7_bootstrap_brier": _bootstrap_of(ev.bootstrap_brier, HORIZON),
    "K8_meets_threshold": _threshold,
    "K9_detection_delay": _delays,
    "K9_delay_summary": _delay_summary,
    "K10_surveillance_load": _load,
}

_LAB = f"SELECT *, CASE WHEN event = 1 AND time <= {HORIZON} THEN 1 WHEN time >= {HORIZON} THEN 0 END AS label FROM scor"
_CUTS = ", ".join(f"({c!r}::DOUBLE)" for c in CUTS)


def _pair_sql(by: str) -> str:
    """Every pair compared."""
    return (
        f"SELECT {by}, count(*) FILTER (a.score > b.score) AS concordant, count(*) FILTER (a.score = b.score) AS tied, count(*) AS comparable, "
        f"{rd('(count(*) FILTER (a.score > b.score) + count(*) FILTER (a.score = b.score) / 2.0) / count(*)')} AS c_index "
        "FROM scor a JOIN scor b ON a.event = 1 AND (a.time < b.time OR (a.time = b.time AND b.event = 0))"
    )


def _counts_sql(by: str, score: str = "score", cuts: str = _CUTS) -> str:
    return (
        f"SELECT {by} cut, count(*) FILTER ({score} >= cut AND label = 1) AS tp, count(*) FILTER ({score} >= cut AND label = 0) AS fp, "
        f"count(*) FILTER ({score} < cut AND label = 1) AS fn, count(*) FILTER ({score} < cut AND label = 0) AS tn "
        f"FROM lab, (VALUES {cuts}) q(cut) WHERE label IS NOT NULL GROUP BY ALL"
    )


_RATES = (
    f"tp, fp, fn, tn, {rd('tp / nullif(tp + fn, 0)')} AS sensitivity, {rd('tn / nullif(tn + fp, 0)')} AS specificity, "
    f"{rd('tp / nullif(tp + fp, 0)')} AS ppv, CAST(5 * fn + fp AS DOUBLE) AS cost"
)
_SETS = (
    _counts_sql("'all' AS subgroup, 'all' AS level,") + " UNION ALL " + _counts_sql("'segment' AS subgroup, segment AS level,")
    + " UNION ALL " + _counts_sql("'site' AS subgroup, site AS level,")
)


def _band_sql(x: str, cuts: tuple[float, float]) -> str:
    a, b = cuts
    return f"CASE WHEN {x} < {a} THEN '< {a:g}' WHEN {x} < {b} THEN '{a:g} to {b:g}' WHEN {x} >= {b} THEN '>= {b:g}' END"


def _auc_sql(by: str, on: str, horizon: int = HORIZON) -> str:
    life = life_table(by)
    return sql(
        "scor",
        ("" if by == "0" else "")
        + f"SELECT {'g AS site, ' if by != '0' else ''}n_cases, n_controls, {rd('won / total')} AS auc FROM "
        "(SELECT a.g, count(DISTINCT a.id) AS n_cases, count(DISTINCT b.id) AS n_controls, sum(a.w * b.w * (CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) ORDER BY a.id, b.id) AS won, "
        "sum(a.w * b.w ORDER BY a.id, b.id) AS total FROM ca a JOIN co b ON a.g = b.g GROUP BY a.g)",
        cnt=life["cnt"].replace("FROM surv", "FROM scor"),
        lt=life["lt"],
        stay="SELECT g, time, CASE WHEN n > d THEN 1.0 - c / (n - d) ELSE 1.0 END AS stay FROM lt",
        gb="SELECT a.g, a.time, coalesce(product(b.stay ORDER BY b.time) FILTER (b.time < a.time), 1.0) AS before FROM stay a JOIN stay b ON b.g = a.g AND b.time <= a.time GROUP BY a.g, a.time",
        gh=f"SELECT g, product(stay ORDER BY time) FILTER (time <= {horizon}) AS g_h FROM stay GROUP BY g",
        ca=f"SELECT id, s.g, score, 1.0 / before AS w FROM (SELECT *, {by} AS g FROM scor) s JOIN gb ON gb.g = s.g AND gb.time = s.time WHERE event = 1 AND s.time <= {horizon}",
        co=f"SELECT id, s.g, score, 1.0 / g_h AS w FROM (SELECT *, {by} AS g FROM scor) s JOIN gh ON gh.g = s.g WHERE time > {horizon}",
    )


def _calibration_sql(horizon: int) -> str:
    observed = f"1.0 - coalesce((SELECT k.s FROM kmc k WHERE k.g = b.g AND k.time <= {horizon} ORDER BY k.time DESC LIMIT 1), 1.0)"
    return sql(
        "scor",
        f"SELECT CAST(b.g AS INTEGER) AS bin, n, {rd('predicted')} AS predicted, {rd(observed)} AS observed "
        "FROM (SELECT bin AS g, count(*) AS n, avg(score ORDER BY id) AS predicted FROM binned GROUP BY bin) b",
        binned="SELECT *, floor(5 * (rank() OVER (ORDER BY score) - 1) / count(*) OVER ()) + 1 AS bin FROM scor",
        **life_table("bin", "binned"),
    )


_POISSON = "CASE " + " ".join(f"WHEN u < {e!r}::DOUBLE THEN {k}" for k, e in enumerate(ev.poisson_edges())) + " ELSE 12 END"
_LOW = int((1 - 0.95) / 2 * (REPS - 1))
#: The weight of every row in every replicate; replicate -1 weighs each once.
_DRAWS = f"""SELECT id, r, CASE WHEN r < 0 THEN 1 ELSE {_POISSON} END AS w FROM (
  SELECT id, r, CAST('0x' || substr(md5('boot' || r || ':' || id), 1, 8) AS BIGINT) / {2**32}.0::DOUBLE AS u FROM scor, range(-1, {REPS}) g(r))"""
_DIFFERENCE = (
    f"SELECT {rd('max(m) FILTER (r < 0)')} AS model, {rd('max(c) FILTER (r < 0)')} AS comparator, {rd('max(m - c) FILTER (r < 0)')} AS difference, "
    f"{rd(f'list_sort(list(m - c) FILTER (r >= 0))[{_LOW + 1}]')} AS lower, {rd(f'list_sort(list(m - c) FILTER (r >= 0))[{REPS - _LOW}]')} AS upper FROM reps"
)


def _won(s: str) -> str:
    return f"sum(a.w * b.w * k * (CASE WHEN a.{s} > b.{s} THEN 1.0 WHEN a.{s} = b.{s} THEN 0.5 ELSE 0.0 END)) / sum(a.w * b.w * k)"


def _weighted_sql(body: str, **more: str) -> str:
    """``_DIFFERENCE`` over ``body``, with the chance of being followed until before each time and until the horizon."""
    life = life_table("0")
    return sql(
        "scor", _DIFFERENCE, draws=_DRAWS, cnt=life["cnt"].replace("FROM surv", "FROM scor"), lt=life["lt"],
        stay="SELECT time, CASE WHEN n > d THEN 1.0 - c / (n - d) ELSE 1.0 END AS stay FROM lt",
        gb="SELECT a.time, coalesce(product(b.stay ORDER BY b.time) FILTER (b.time < a.time), 1.0) AS before FROM stay a JOIN stay b ON b.time <= a.time GROUP BY a.time",
        state=f"SELECT s.id, score, other, CAST(event = 1 AND s.time <= {HORIZON} AS INTEGER) AS hit, CASE WHEN event = 1 AND s.time <= {HORIZON} THEN 1.0 / before "
        f"ELSE 1.0 / (SELECT product(stay ORDER BY time) FROM stay WHERE time <= {HORIZON}) END AS k FROM scor s JOIN gb USING (time) WHERE event = 1 AND s.time <= {HORIZON} OR s.time > {HORIZON}",
        **more, reps=body,
    )


_DELAY = (
    "SELECT f.id, CAST(date_diff('day', event_t, (SELECT min(t) FROM v WHERE v.id = f.id AND prio = '1-URGENT' AND t >= event_t)) AS INTEGER) AS delay_days FROM firsts f"
)
_TIER = f"CASE WHEN score < {TIERS[0]} THEN 'Low' WHEN score < {TIERS[1]} THEN 'Moderate' ELSE 'High' END"

SQL = {
    "K1_cindex": sql("scor", _pair_sql("1 AS one").replace("SELECT 1 AS one, ", "SELECT ")),
    "K2_td_auc": _auc_sql("0", ""),
    "K2_td_auc_by_site": _auc_sql("site", "site"),
    "K2_td_auc_horizons": " UNION ALL ".join(f"(SELECT CAST({h} AS INTEGER) AS horizon, * FROM ({_auc_sql('0', '', h)}))" for h in HORIZONS),
    "K3_calibration": _calibration_sql(HORIZON),
    "K3_calibration_horizons": " UNION ALL ".join(f"(SELECT CAST({h} AS INTEGER) AS horizon, * FROM ({_calibration_sql(h)}))" for h in HORIZONS),
    "K4_decision_table": sql("scor", f"SELECT cut, {_RATES} FROM c", lab=_LAB, c=_counts_sql("")),
    "K5_decision_by_subgroups": sql("scor", f"SELECT subgroup, level, cut, {_RATES} FROM c", lab=_LAB, c=_SETS),
    "K5_cindex_by_subgroup": sql(
        "scor",
        _pair_sql("'all' AS subgroup, 'all' AS level")
        + " UNION ALL " + _pair_sql("'segment' AS subgroup, a.segment AS level") + " AND a.segment = b.segment GROUP BY a.segment"
        + " UNION ALL " + _pair_sql("'site' AS subgroup, a.site AS level") + " AND a.site = b.site GROUP BY a.site",
    ),
    "K5_decision_by_bands": sql(
        "scor",
        f"SELECT subgroup, level, cut, {_RATES} FROM c",
        lab=_LAB,
        c=" UNION ALL ".join(
            _counts_sql(f"'{name}' AS subgroup, {level} AS level,", cuts="(0.4::DOUBLE)")
            for name, level in (("all", "'all'"), ("balance_band", _band_sql("balance", BALANCES)), ("visits_band", _band_sql("n_visits", VISITS)))
        ),
    ),
    "K6_group_cutoffs": sql(
        "scor",
        f"SELECT site, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, {rd('cut')} AS cut, {rd('count(*) FILTER (label = 1 AND score >= cut) / n_pos')} AS sensitivity, "
        f"{rd('count(*) FILTER (label = 0 AND score < cut) / n_neg')} AS specificity FROM lab JOIN best USING (site) WHERE label IS NOT NULL GROUP BY site, n_pos, n_neg, cut",
        lab=_LAB,
        tot="SELECT site, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM lab GROUP BY site",
        best="SELECT site, n_pos, n_neg, max(score) AS cut FROM (SELECT a.site, a.score, n_pos, n_neg FROM lab a JOIN tot USING (site) JOIN lab b ON a.site = b.site AND b.score >= a.score "
        "AND b.label = 1 WHERE a.label IS NOT NULL GROUP BY a.site, a.score, a.id, n_pos, n_neg HAVING count(*) >= 0.8 * n_pos) GROUP BY site, n_pos, n_neg",
    ),
    "K6_fairness_gap": sql(
        "scor",
        " UNION ALL ".join(
            f"SELECT subgroup, '{m}' AS metric, count({e}) AS n_levels, {rd(f'min({e})')} AS lowest, {rd(f'max({e})')} AS highest, {rd(f'max({e}) - min({e})')} AS gap "
            "FROM c WHERE cut = 0.4 AND subgroup <> 'all' GROUP BY subgroup"
            for m, e in {"sensitivity": "tp / nullif(tp + fn, 0)", "specificity": "tn / nullif(tn + fp, 0)"}.items()
        ),
        lab=_LAB,
        c=_SETS,
    ),
    "K7_compare": sql(
        "scor",
        "SELECT site, cut, "
        + ", ".join(
            f"{rd(e.format('a'))} AS {m}_model, {rd(e.format('b'))} AS {m}_comparator, {rd(e.format('a') + ' - ' + e.format('b'))} AS {m}_diff"
            for m, e in {"sensitivity": "{0}.tp / nullif({0}.tp + {0}.fn, 0)", "specificity": "{0}.tn / nullif({0}.tn + {0}.fp, 0)"}.items()
        )
        + " FROM a JOIN b USING (site, cut)",
        lab=_LAB,
        a=_counts_sql("site,"),
        b=_counts_sql("site,", "other"),
    ),
    "K7_bootstrap_difference": sql(
        "scor",
        f"SELECT {rd('(SELECT avg(dd ORDER BY id) FROM dif)')} AS difference, {rd(f'list_sort(list(b))[{_LOW + 1}]')} AS lower, "
        f"{rd(f'list_sort(list(b))[{REPS - _LOW}]')} AS upper FROM reps",
        lab=_LAB,
        dif="SELECT id, pow(score - label, 2) - pow(other - label, 2) AS dd FROM lab WHERE label IS NOT NULL",
        drawn=f"SELECT r, id, dd, CAST('0x' || substr(md5('boot' || r || ':' || id), 1, 8) AS BIGINT) / {2**32}.0::DOUBLE AS u "
        f"FROM dif, range({REPS}) g(r)",
        reps=f"SELECT r, sum(dd * w ORDER BY id) / sum(w) AS b FROM (SELECT *, {_POISSON} AS w FROM drawn) GROUP BY r",
    ),
    "K7_bootstrap_cindex": sql(
        "scor", _DIFFERENCE, draws=_DRAWS,
        reps=f"SELECT a.r, {_won('score')} AS m, {_won('other')} AS c FROM (SELECT *, 1.0 AS k FROM scor JOIN draws USING (id) WHERE event = 1) a "
        "JOIN (SELECT * FROM scor JOIN draws USING (id)) b ON a.r = b.r AND (a.time < b.time OR (a.time = b.time AND b.event = 0)) GROUP BY a.r",
    ),
    "K7_bootstrap_auc": _weighted_sql(
        f"SELECT a.r, {_won('score')} AS m, {_won('other')} AS c FROM (SELECT * FROM state JOIN draws USING (id) WHERE hit = 1) a "
        "JOIN (SELECT id, r, w, score, other FROM state JOIN draws USING (id) WHERE hit = 0) b ON a.r = b.r GROUP BY a.r"
    ),
    "K7_bootstrap_brier": _weighted_sql(
        "SELECT r, sum(pow(score - hit, 2) * k * w ORDER BY id) / sum(k * w ORDER BY id) AS m, sum(pow(other - hit, 2) * k * w ORDER BY id) / sum(k * w ORDER BY id) AS c "
        "FROM state JOIN draws USING (id) GROUP BY r"
    ),
    "K8_meets_threshold": sql(
        "scor",
        " UNION ALL ".join(
            f"SELECT site, '{m}' AS metric, {rd(e)} AS value, CAST({lim} AS DOUBLE) AS threshold, CAST({e} >= {lim} AS INTEGER) AS is_met FROM c WHERE cut = 0.4"
            for m, (e, lim) in {
                "sensitivity": ("tp / nullif(tp + fn, 0)", "0.7"),
                "specificity": ("tn / nullif(tn + fp, 0)", "0.4"),
                "ppv": ("tp / nullif(tp + fp, 0)", "NULL"),
            }.items()
        ),
        lab=_LAB,
        c=_counts_sql("site,"),
    ),
    "K9_detection_delay": sql("firsts v", _DELAY),
    "K9_delay_summary": sql(
        "firsts v pat",
        "SELECT site, count(*) AS n, count(delay_days) AS n_detected, "
        + ", ".join(f"quantile_cont(delay_days, {q}) AS {n}" for q, n in ((0.25, "delay_q1"), (0.5, "delay_median"), (0.75, "delay_q3")))
        + f" FROM ({_DELAY}) JOIN pat USING (id) GROUP BY site",
    ),
    "K10_surveillance_load": sql(
        "scor",
        "SELECT tier, count(*) AS n, CAST(sum(f) AS BIGINT) AS visits_fixed, CAST(sum(p) AS BIGINT) AS visits_planned, CAST(sum(p) - sum(f) AS BIGINT) AS visits_difference FROM ("
        f"SELECT {_TIER} AS tier, len(range(365, 3651, 365)) AS f, CASE {_TIER} "
        + " ".join(f"WHEN '{k}' THEN len(range({v}, 3651, {v}))" for k, v in PLAN.items())
        + " END AS p FROM scor) GROUP BY tier",
    ),
}
