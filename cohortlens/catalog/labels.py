"""Endpoints, labels, splits and leakage (groups F and G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import base
from cohortlens.catalog.base import day, r6, rd, sql
from cohortlens.functions.hashing import SPAN
from cohortlens.operators import endpoints, splits
from cohortlens.operators.cohort import index_event
from cohortlens.operators.features import from_baseline
from cohortlens.plans.skew import skew_join
from cohortlens.sources import load

HORIZONS = (730, 1461, 1826)
RULES = (
    {"stage": 2, "rise": 50_000.0, "level": 150_000.0, "drop": 5.0, "drop_share": 0.25},
    {"stage": 3, "rise": 150_000.0, "level": 300_000.0, "drop": 15.0, "drop_share": 0.50},
)


def _stage(spark, d):
    """Order total as the measure; the order's mean line quantity as the corroborating one."""
    q = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("vk")).agg(F.avg("l_quantity").alias("q"))
    v = base.visits(spark, d).select("id", "vk", "t", "x").join(q, "vk", "left")
    index = index_event(v, "id", "t", ["x", "q"], "vk").select("id", "index_x", "index_q")
    changed = from_baseline(v, index, id="id", x="x", baseline="index_x", keep=["index_q"])
    staged = endpoints.stage(changed, x="x", change="x_change", corroborating="q", baseline_corroborating="index_q", rules=RULES)
    return staged.select("id", "vk", "stage")


def _first(confirm):
    def query(spark, d):
        v = base.visits(spark, d).withColumn("flag", (F.col("x") >= 250_000.0).cast("int"))
        return r6(endpoints.first_event(v, "id", ["t", "vk"], "flag", confirm))

    return query


def _truth(spark, d):
    """Measure crossings outrank R shipments, which outrank A shipments."""
    ship = base.shipped(spark, d)
    crossed = base.crossings(spark, d).where("flag = 1").select("id", "t", F.lit("crossing").alias("kind"))
    sources = {"measure": crossed, "returns": ship.where("kind = 'R'"), "accepted": ship.where("kind = 'A'")}
    return r6(endpoints.resolve_truth(sources, ["measure", "returns", "accepted"], "id", "t", "kind"))


def _survival(spark, d):
    return base.survival_by_steps(spark, d)


def _competing(spark, d):
    return base.competing_table(spark, d).select("id", "time", "cause")


def _horizons(spark, d):
    return endpoints.horizon_label(base.survival(spark, d), HORIZONS, keep=["id"])


def _endpoints(spark, d):
    c = base.cohort(spark, d).select("id", "index_t")
    later = skew_join(base.shipped(spark, d), c, "id").where(F.col("t") >= F.col("index_t")).select("id", "t", "kind")
    return endpoints.endpoints(c, later, ["R", "A", "N"], id="id", index="index_t", t="t", kind="kind")


def _agreement(spark, d):
    labels = load(spark, d, "labels").withColumn("clean", F.lit(1) - F.col("toxic"))
    counts = endpoints.label_counts(labels, labels, "doc_id", "quality", "clean")
    return r6(endpoints.label_agreement(counts))


def _counts(spark, d):
    labels = load(spark, d, "labels")
    return endpoints.label_counts(labels, labels, "doc_id", "quality", "toxic")


def _periods(spark, d):
    s = base.survival(spark, d).select("id", "time", "event")
    return endpoints.person_period(s, "time", "event", 365, 1826).select(
        "id", "period", "period_start", "exposure", "period_event"
    )


WEIGHTS = {"train": 0.6, "validation": 0.2, "test": 0.2}


def _split(spark, d):
    return splits.split_entity(base.patients(spark, d).select("id", "segment"), "id", WEIGHTS, "s1")


def _split_time(spark, d):
    c = base.cohort(spark, d).select("id", "index_t")
    return r6(splits.split_time(c, "index_t", "1995-07-01", "1996-01-01"))


def _split_group(spark, d):
    return splits.split_group(base.patients(spark, d).select("id", "site"), "site", ["ASIA", "EUROPE"])


def _folds(spark, d):
    return splits.folds(base.patients(spark, d).select("id"), "id", 5)


def _leaky(spark, d):
    """Visits split by their own key rather than by patient, as a leak to be found."""
    v = splits.split_entity(base.visits(spark, d), "vk", WEIGHTS, "bad")
    v = v.withColumn("cut", F.lit("1999-01-01").cast("timestamp_ntz"))
    return splits.leakage(v, "id", "split", "t", "cut")


def _sound(spark, d):
    """The same audit on a split by patient: only late features may be reported."""
    v = splits.split_entity(base.visits(spark, d), "id", WEIGHTS, "good")
    v = v.withColumn("cut", F.lit("2001-01-01").cast("timestamp_ntz"))
    return splits.leakage(v, "id", "split", "t", "cut")


def _weights(spark, d):
    return r6(splits.class_weights(base.survival(spark, d).select("id", "event"), "event"))


QUERIES = {
    "F1_stage": _stage,
    "F2_first_event": _first(0),
    "F2_first_event_confirmed": _first(2),
    "F3_resolve_truth": _truth,
    "F4_survival_table": _survival,
    "F5_competing": _competing,
    "F5_competing_by_steps": lambda s, d: base.competing_by_steps(s, d).select("id", "time", "cause"),
    "F6_horizon_label": _horizons,
    "F7_endpoints": _endpoints,
    "F8_label_agreement": _agreement,
    "F8_label_counts": _counts,
    "F9_person_period": _periods,
    "G1_split_entity": _split,
    "G2_split_time": _split_time,
    "G3_split_group": _split_group,
    "G4_folds": _folds,
    "G5_leakage_found": _leaky,
    "G5_leakage_sound": _sound,
    "G6_class_weights": _weights,
    "G6_group_label_weights": lambda s, d: r6(splits.group_label_weights(base.survival(s, d).select("id", "site", "event"), "site", "event")),
}


def hashed(expr: str, salt: str) -> str:
    return f"CAST('0x' || substr(md5('{salt}' || CAST({expr} AS VARCHAR)), 1, 8) AS BIGINT)"


def _split_case(expr: str, salt: str) -> str:
    a, b = int(0.6 * SPAN), int((0.6 + 0.2) * SPAN)
    h = hashed(expr, salt)
    return f"CASE WHEN {h} < {a} THEN 'train' WHEN {h} < {b} THEN 'validation' ELSE 'test' END"


def _leak_sql(expr: str, salt: str, cut: str) -> str:
    return sql(
        "v",
        "SELECT id, count(*) AS n_rows, CAST(count(DISTINCT split) > 1 AS INTEGER) AS in_many_splits, "
        f"count(*) FILTER (t > TIMESTAMP '{cut}') AS n_late FROM (SELECT *, {_split_case(expr, salt)} AS split FROM v) GROUP BY id "
        f"HAVING count(DISTINCT split) > 1 OR count(*) FILTER (t > TIMESTAMP '{cut}') > 0",
    )


def _stage_rule(rule: dict) -> str:
    fall = "(index_q - q)"
    return (
        f"x - index_x >= {rule['rise']} AND x >= {rule['level']} AND "
        f"coalesce({fall} >= {rule['drop']} OR {fall} / index_q >= {rule['drop_share']}, false)"
    )


SQL = {
    "F1_stage": sql(
        "v",
        f"SELECT id, vk, CAST(CASE WHEN {_stage_rule(RULES[1])} THEN 3 WHEN {_stage_rule(RULES[0])} THEN 2 ELSE 0 END AS INTEGER) AS stage "
        "FROM vq JOIN (SELECT id, x AS index_x, q AS index_q FROM vq WHERE rn = 1) USING (id)",
        vq="SELECT v.*, q, row_number() OVER (PARTITION BY id ORDER BY t, vk) AS rn FROM v LEFT JOIN "
        "(SELECT l_orderkey AS vk, avg(l_quantity) AS q FROM lineitem GROUP BY 1) USING (vk)",
    ),
    "F2_first_event": sql("v", f"SELECT id, {day('min(t)')} AS event_t FROM v WHERE x >= 250000 GROUP BY id"),
    "F2_first_event_confirmed": sql(
        "v",
        f"SELECT id, {day('min(t)')} AS event_t FROM (SELECT id, t, x, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM v "
        "WINDOW w AS (PARTITION BY id ORDER BY t, vk)) WHERE x >= 250000 AND x1 >= 250000 AND x2 >= 250000 GROUP BY id",
    ),
    "F3_resolve_truth": sql(
        "cross_ ship",
        f"SELECT id, {day('t')} AS t, kind, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pri, t, kind) AS k FROM s) WHERE k = 1",
        s="SELECT id, t, 'crossing' AS kind, 'measure' AS source, 0 AS pri FROM cross_ WHERE flag = 1 UNION ALL "
        "SELECT id, t, kind, 'returns', 1 FROM ship WHERE kind = 'R' UNION ALL SELECT id, t, kind, 'accepted', 2 FROM ship WHERE kind = 'A'",
    ),
    "F4_survival_table": sql("surv", "SELECT id, time, event FROM surv"),
    "F5_competing": sql("comp", "SELECT id, time, cause FROM comp"),
    "F5_competing_by_steps": sql("comp", "SELECT id, time, cause FROM comp"),
    "F6_horizon_label": sql(
        "surv",
        "SELECT id, CAST(h AS INTEGER) AS horizon, CAST(CASE WHEN time <= h AND event = 1 THEN 1 WHEN time < h THEN NULL ELSE 0 END AS INTEGER) AS label "
        f"FROM surv, (VALUES {', '.join(f'({h})' for h in HORIZONS)}) q(h)",
    ),
    "F7_endpoints": sql(
        "coh ship",
        "SELECT id, "
        + ", ".join(
            f"CAST(date_diff('day', index_t, (SELECT min(t) FROM ship s WHERE s.id = coh.id AND s.kind = '{k}' AND s.t >= index_t)) AS INTEGER) AS days_to_{k}"
            for k in "RAN"
        )
        + " FROM coh",
    ),
    "F8_label_agreement": f"SELECT n, n_agree, {rd('po')} AS observed, {rd('pe')} AS expected, {rd('(po - pe) / (1 - pe)')} AS kappa FROM "
    "(SELECT n, n_agree, n_agree / n AS po, (a1 * b1 + (n - a1) * (n - b1)) / (n * n) AS pe FROM (SELECT count(*) AS n, "
    "count(*) FILTER (quality = 1 - toxic) AS n_agree, count(*) FILTER (quality = 1) AS a1, count(*) FILTER (toxic = 0) AS b1 FROM labels))",
    "F8_label_counts": "SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2",
    "F9_person_period": sql(
        "surv",
        "SELECT id, CAST(p AS INTEGER) AS period, CAST(p * 365 AS INTEGER) AS period_start, CAST(least(e, (p + 1) * 365) - p * 365 AS INTEGER) AS exposure, "
        "CAST(CASE WHEN e <= (p + 1) * 365 AND time <= 1826 THEN event ELSE 0 END AS INTEGER) AS period_event "
        "FROM (SELECT id, time, event, least(time, 1826) AS e FROM surv), generate_series(0, 5) g(p) WHERE p * 365 < e OR p = 0",
    ),
    "G1_split_entity": sql("pat", f"SELECT id, segment, {_split_case('id', 's1')} AS split FROM pat"),
    "G2_split_time": sql(
        "coh",
        f"SELECT id, {day('index_t')} AS index_t, CASE WHEN index_t < DATE '1995-07-01' THEN 'train' WHEN index_t < DATE '1996-01-01' "
        "THEN 'validation' ELSE 'test' END AS split FROM coh",
    ),
    "G3_split_group": sql(
        "pat", "SELECT id, site, CASE WHEN site IN ('ASIA', 'EUROPE') THEN 'external' ELSE 'development' END AS split FROM pat"
    ),
    "G4_folds": sql("pat", f"SELECT id, CAST({hashed('id', 'fold')} % 5 AS INTEGER) AS fold FROM pat"),
    "G5_leakage_found": _leak_sql("vk", "bad", "1999-01-01"),
    "G5_leakage_sound": _leak_sql("id", "good", "2001-01-01"),
    "G6_group_label_weights": sql(
        "surv",
        "SELECT id, site, event, "
        + rd("(count(*) OVER (PARTITION BY site)) * (count(*) OVER (PARTITION BY event)) / ((count(*) OVER ()) * 1.0::DOUBLE * (count(*) OVER (PARTITION BY site, event)))")
        + " AS weight FROM surv",
    ),
    "G6_class_weights": sql(
        "surv",
        f"SELECT id, event, {rd('(count(*) OVER ()) / (2.0 * count(*) OVER (PARTITION BY event))')} AS weight FROM surv",
    ),
}
