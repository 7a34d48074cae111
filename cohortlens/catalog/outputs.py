"""Scoring outputs, privacy, score cards and streams (groups J, L, M and N)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from cohortlens.catalog import base
from cohortlens.catalog.base import day, r6, rd, sql
from cohortlens.catalog.labels import hashed
from cohortlens.operators import privacy, records, scorecard, scoring
from cohortlens.plans.skew import skew_join
from cohortlens.session import shared_dir
from cohortlens.sources import TABLE_SCHEMAS, load
from cohortlens.streaming import arrivals

PLAN = {"Low": 730, "Moderate": 365, "High": 180}
TIERS = (0.3, 0.7)
HORIZONS = (1826, 2922, 3652)
RECORD_TIERS = (0.4, 0.55)
RECORD_COEF = {"index_x": 0.000002, "balance": -0.0001, "n_visits": 0.05}
RECORD_MEANS = {"index_x": 250_000.0, "balance": 4_500.0, "n_visits": 10.0}
CRITERIA = dict(zip(("view", "click", "signup", "purchase", "error"), scorecard.CRITERION_WEIGHTS))
COEF = {"value": 0.01, "balance": -0.0001}
INTERCEPT = -0.5
DELAY = "2 hours"
DUE_DAYS = 2


def _risk(spark, d):
    """Risk at 5, 8 and 10 years from a per-customer scale, one row per horizon for comparison."""
    pred = base.cohort(spark, d).select("id", (F.lit(1000.0) + F.col("index_x") / 100.0).alias("scale"))
    nested = scoring.risk_table(pred, [1826, 2922, 3652], "id", "scale", 1.5)
    return r6(nested.select("id", F.inline("risk")))


def _tiered(spark, d):
    return scoring.risk_tier(base.scored(spark, d).select("id", "site", "segment", "index_t", "n_visits", "score"), "score", TIERS)


def _tier(spark, d):
    return _tiered(spark, d).select("id", "score", "tier")


def _next(spark, d):
    last = base.visits(spark, d).groupBy("id").agg(F.max("t").alias("last_t"))
    return r6(scoring.next_visit(_tiered(spark, d).select("id", "tier").join(last, "id"), "tier", PLAN, "last_t"))


def _record(spark, d):
    """The whole prediction record of every customer, flattened for comparison."""
    pred = base.cohort(spark, d).withColumn("scale", F.lit(1000.0) + F.col("index_x") / 100.0)
    rows = records.prediction_record(pred, "id", "scale", 1.5, HORIZONS, RECORD_TIERS, PLAN, RECORD_COEF, RECORD_MEANS)
    top = lambda i: [F.get("top", F.lit(i))[c].alias(f"{c}{i + 1}") for c in ("feature", "contribution")]
    return r6(rows.select("id", *[F.col("risk")[i]["prob"].alias(f"p{h}") for i, h in enumerate(HORIZONS)], "tier", *top(0), *top(1), *top(2), "next_days"))


def _record_sql():
    p = lambda h: f"1.0 - exp(-pow({h}.0::DOUBLE / (1000.0::DOUBLE + index_x / 100.0::DOUBLE), 1.5::DOUBLE))"
    tier = f"CASE WHEN {p(HORIZONS[0])} < {RECORD_TIERS[0]} THEN 'Low' WHEN {p(HORIZONS[0])} < {RECORD_TIERS[1]} THEN 'Moderate' ELSE 'High' END"
    terms = " UNION ALL ".join(f"SELECT id, '{c}' AS feature, ({b!r}::DOUBLE) * (CAST({c} AS DOUBLE) - {RECORD_MEANS[c]!r}::DOUBLE) AS v FROM coh" for c, b in RECORD_COEF.items())
    tops = ", ".join(f"max(feature) FILTER (k = {i}) AS feature{i}, {rd(f'max(v) FILTER (k = {i})')} AS contribution{i}" for i in (1, 2, 3))
    return sql(
        "coh",
        f"SELECT id, {', '.join(f'{rd(p(h))} AS p{h}' for h in HORIZONS)}, {tier} AS tier, t.* EXCLUDE (id), "
        f"CAST(CASE {tier} {' '.join(f'WHEN {k!r} THEN {v}' for k, v in PLAN.items())} END AS INTEGER) AS next_days FROM coh JOIN t USING (id)",
        t=f"SELECT id, {tops} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, feature) AS k FROM ({terms})) GROUP BY id",
    )


def _list(spark, d):
    rows = _tiered(spark, d).select("id", "site", "score", "tier")
    return scoring.flag_list(rows, F.col("tier") == "High", [F.desc("score"), F.col("id")], 5, "site")


def _list_all(spark, d):
    rows = _tiered(spark, d).select("id", "score", "tier")
    return scoring.flag_list(rows, F.col("tier") == "High", [F.desc("score"), F.col("id")], 20)


def _devices(spark, d):
    """Each customer with the part on the first line of the first order."""
    first = base.visits(spark, d).groupBy("id").agg(F.min_by("vk", F.struct("t", "vk")).alias("l_orderkey"), F.count(F.lit(1)).alias("n_visits"))
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("p_partkey")
    )
    parts = load(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return skew_join(first.join(lines, "l_orderkey"), parts, "p_partkey").select("id", "n_visits", "p_brand", "p_size")


def _reliability(spark, d):
    return scoring.reliability(_devices(spark, d).select("id", "n_visits", "p_brand"), "n_visits", "p_brand", 6, 50)


def _pseudonyms(spark, d):
    return privacy.pseudonymize(base.visits(spark, d).select("id", "vk", "prio"), ["id", "vk"], "pepper")


def _masked(spark, d):
    return privacy.mask_text(load(spark, d, "documents").select("doc_id", "text"), "text")


def _shifted(spark, d):
    return r6(privacy.shift_dates(base.visits(spark, d).select("id", "vk", "t"), "id", ["t"], 180, "shift"))


def _cells(spark, d):
    rows = _devices(spark, d).join(base.patients(spark, d).select("id", "site"), "id")
    return privacy.k_anonymity(rows, ["site", "p_brand", "p_size"], 3)


def _suppressed(spark, d):
    rows = _devices(spark, d).join(base.patients(spark, d).select("id", "site"), "id").select("id", "site", "p_brand")
    return privacy.suppress_small_cells(rows, ["site", "p_brand"], 8)


def _scores(spark, d):
    """Each user's mean value per event type, cut to a score of 1 to 6; a 6 is out of range.

    Values are read to six decimals and added as whole numbers, so that means at an edge do not depend on the order of rows.
    """
    micro = F.floor(F.col("value") * F.lit(1e6) + F.lit(0.5)).cast("bigint")
    sums = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum(micro).alias("s"), (F.count("value") * F.lit(15_000_000)).alias("width"))
    whole = F.when(F.col("width") > 0, F.expr("(s - pmod(s, width)) div width + 1"))
    criterion = F.lit(None).cast("string")
    for kind, name in CRITERIA.items():
        criterion = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(criterion)
    score = F.greatest(F.lit(0), F.least(F.lit(6), whole)).cast("int")
    return sums.select(F.col("user_id").alias("entity"), criterion.alias("criterion"), score.alias("score"))


def _cards(spark, d):
    return scorecard.scorecard(_scores(spark, d)).withColumn("weighted_score", F.col("weighted_score").cast("double"))


def _ranked(spark, d):
    ranked = scorecard.rank_cards(scorecard.scorecard(_scores(spark, d)))
    return ranked.select("entity", F.col("weighted_score").cast("double").alias("weighted_score"), "rank", "dense_rank")


def _stream(spark, d):
    stream = arrivals.read_file_stream(spark, os.path.join(d, "events.parquet"), TABLE_SCHEMAS["events"])
    return arrivals.event_time(stream, "ts")


def _landed(spark, stream, schema):
    """Run a stream over all that has arrived and read back what it wrote."""
    folder = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    arrivals.write_once(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(schema).parquet(f"{folder}/out")


def _stream_dedup(spark, d):
    """Events and a replay of all of them: each is kept once."""
    twice = _stream(spark, d).unionByName(_stream(spark, d))
    kept = arrivals.stream_dedup(twice, ["event_id", "event_type"], "ts", DELAY).select("event_id", "user_id", "event_type", "value")
    return _landed(spark, kept, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE")


def _score(frame, spark, d):
    known = base.patients(spark, d).select(F.col("id").alias("user_id"), "balance").where("balance > 0")
    scored = arrivals.stream_score(frame, known, "user_id", COEF, INTERCEPT)
    return scored.select("event_id", "user_id", "score")


def _stream_score(spark, d):
    return r6(_landed(spark, _score(_stream(spark, d), spark, d), "event_id BIGINT, user_id BIGINT, score DOUBLE"))


def _batch_score(spark, d):
    return r6(_score(load(spark, d, "events"), spark, d))


def _stream_overdue(spark, d):
    """Users without an event in the two days after one."""
    settings = {"spark.sql.streaming.stateStore.providerClass": arrivals.ROCKSDB, arrivals.MERGE_LOCALLY: "true"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        alerts = arrivals.stream_overdue(_stream(spark, d), "user_id", "ts", DUE_DAYS, DELAY)
        return _landed(spark, alerts, "id BIGINT, last_ms BIGINT, due_ms BIGINT")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


QUERIES = {
    "J1_risk_table": _risk,
    "J2_risk_tier": _tier,
    "J3_next_visit": _next,
    "J1_prediction_record": _record,
    "J4_flag_list_by_site": _list,
    "J4_flag_list": _list_all,
    "J5_reliability": _reliability,
    "L1_pseudonymize": _pseudonyms,
    "L2_mask_text": _masked,
    "L3_shift_dates": _shifted,
    "L4_k_anonymity": _cells,
    "L4_suppress_small_cells": _suppressed,
    "M1_scorecard": _cards,
    "M2_rank_cards": _ranked,
    "N1_stream_dedup": _stream_dedup,
    "N2_stream_score": _stream_score,
    "N2_batch_score": _batch_score,
    "N3_stream_overdue": _stream_overdue,
}

_TIER = f"CASE WHEN score < {TIERS[0]} THEN 'Low' WHEN score < {TIERS[1]} THEN 'Moderate' ELSE 'High' END"
_DEV = {
    "fo": "SELECT id, vk AS l_orderkey, n_visits FROM ranked WHERE rn = 1",
    "fl": "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey",
    "dev": "SELECT id, n_visits, p_brand, p_size FROM fo JOIN fl USING (l_orderkey) JOIN part ON p_partkey = l_partkey",
}
_CRIT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {w}" for (k, n), w in zip(CRITERIA.items(), scorecard.CRITERION_WEIGHTS.values())) + " END"
_CARDS = {
    # Values to six decimals, added as whole numbers: sums of doubles would depend on the order of rows.
    "su": f"SELECT user_id AS entity, event_type, {_CRIT} AS w, sum(CAST(floor(value * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS s, nullif(count(value), 0) * 15000000 AS width FROM events GROUP BY user_id, event_type",
    "sc": "SELECT entity, event_type, w, CAST(greatest(0, least(6, (s - ((s % width) + width) % width) // width + 1)) AS INTEGER) AS score FROM su",
    "cards": "SELECT entity, count(*) AS n_scores, CAST(sum(CAST(score NOT BETWEEN 1 AND 5 AS INTEGER)) AS BIGINT) AS n_rejected, "
    "CAST(count(DISTINCT event_type) = 5 AND max(score) <= 5 AND min(score) >= 1 AS INTEGER) AS is_valid, "
    "CAST(CASE WHEN count(DISTINCT event_type) = 5 AND max(score) <= 5 AND min(score) >= 1 THEN sum(score * w) END AS DOUBLE) AS weighted_score "
    "FROM sc GROUP BY entity",
}
_P = privacy.TEXT_PATTERNS


def _mask_sql() -> str:
    step1 = f"regexp_replace(text, '{_P['email'][0]}', '{_P['email'][1]}', 'g')"
    return (
        f"SELECT doc_id, CAST(len(regexp_extract_all(t0, '{_P['email'][0]}')) AS INTEGER) AS n_email, "
        f"CAST(len(regexp_extract_all(t1, '{_P['ip'][0]}')) AS INTEGER) AS n_ip, "
        f"CAST(len(regexp_extract_all(t2, '{_P['phone'][0]}')) AS INTEGER) AS n_phone, "
        f"regexp_replace(t2, '{_P['phone'][0]}', '{_P['phone'][1]}', 'g') AS text FROM "
        f"(SELECT *, regexp_replace(t1, '{_P['ip'][0]}', '{_P['ip'][1]}', 'g') AS t2 FROM "
        f"(SELECT doc_id, text AS t0, {step1} AS t1 FROM documents))"
    )


_SCORE = (
    f"SELECT event_id, user_id, {rd(f'CASE WHEN balance IS NOT NULL THEN 1 / (1 + exp(-({INTERCEPT}::DOUBLE + value * {COEF['value']}::DOUBLE + balance * ({COEF['balance']}::DOUBLE)))) END')} AS score "
    "FROM events LEFT JOIN (SELECT id AS user_id, balance FROM pat WHERE balance > 0) USING (user_id)"
)

SQL = {
    "J1_risk_table": sql(
        "coh",
        f"SELECT id, CAST(h AS INTEGER) AS horizon, {rd('1 - exp(-pow(h / (1000.0::DOUBLE + index_x / 100.0::DOUBLE), 1.5::DOUBLE))')} AS prob "
        "FROM coh, (VALUES (1826), (2922), (3652)) q(h)",
    ),
    "J2_risk_tier": sql("scor", f"SELECT id, score, {_TIER} AS tier FROM scor"),
    "J3_next_visit": sql(
        "scor ends",
        f"SELECT id, tier, {day('last_t')} AS last_t, CAST(days AS INTEGER) AS next_days, {day('last_t + to_days(days)')} AS next_due FROM "
        f"(SELECT id, {_TIER} AS tier FROM scor) JOIN ends USING (id) JOIN (VALUES {', '.join(f'({k!r}, {v})' for k, v in PLAN.items())}) p(tier, days) USING (tier)",
    ),
    "J4_flag_list_by_site": sql(
        "scor",
        "SELECT id, site, score, 'High' AS tier, CAST(k AS INTEGER) AS list_rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, id) AS k "
        f"FROM scor WHERE score >= {TIERS[1]}) WHERE k <= 5",
    ),
    "J4_flag_list": sql("scor", f"SELECT id, score, 'High' AS tier FROM scor WHERE score >= {TIERS[1]} ORDER BY score DESC, id LIMIT 20"),
    "J5_reliability": sql(
        "ranked",
        "SELECT id, n_visits, p_brand, n_device, CASE WHEN n_visits < 6 AND n_device < 50 THEN 'sparse follow-up, new device' "
        "WHEN n_visits < 6 THEN 'sparse follow-up' WHEN n_device < 50 THEN 'new device' ELSE 'ok' END AS reliability FROM "
        "(SELECT *, count(*) OVER (PARTITION BY p_brand) AS n_device FROM dev)",
        **_DEV,
    ),
    "L1_pseudonymize": sql("v", "SELECT sha256('pepper' || id) AS id, sha256('pepper' || vk) AS vk, prio FROM v"),
    "L2_mask_text": _mask_sql(),
    "L3_shift_dates": sql("v", f"SELECT id, vk, {day('t + to_days(CAST(' + hashed('id', 'shift') + ' % 361 - 180 AS INTEGER))')} AS t FROM v"),
    "L4_k_anonymity": sql(
        "ranked pat", "SELECT site, p_brand, p_size, count(*) AS n_rows FROM dev JOIN pat USING (id) GROUP BY ALL HAVING count(*) < 3", **_DEV
    ),
    "L4_suppress_small_cells": sql(
        "ranked pat",
        "SELECT id, CASE WHEN n >= 8 THEN site END AS site, CASE WHEN n >= 8 THEN p_brand END AS p_brand, CAST(n < 8 AS INTEGER) AS is_suppressed FROM "
        "(SELECT id, site, p_brand, count(*) OVER (PARTITION BY site, p_brand) AS n FROM dev JOIN pat USING (id))",
        **_DEV,
    ),
    "M1_scorecard": sql("", "SELECT * FROM cards", **_CARDS),
    "M2_rank_cards": sql(
        "",
        "SELECT entity, weighted_score, rank() OVER (ORDER BY weighted_score DESC) AS rank, dense_rank() OVER (ORDER BY weighted_score DESC) AS dense_rank "
        "FROM cards WHERE is_valid = 1",
        **_CARDS,
    ),
    "J1_prediction_record": _record_sql(),
    "N1_stream_dedup": "SELECT DISTINCT event_id, user_id, event_type, value FROM events",
    "N2_stream_score": sql("pat", _SCORE),
    "N2_batch_score": sql("pat", _SCORE),
    # An alert fires once the hour that holds the due time is past the last watermark: the latest event less the lateness bound.
    "N3_stream_overdue": "WITH e AS (SELECT DISTINCT user_id AS id, epoch_us(ts) // 1000 AS t FROM events), "
    "n AS (SELECT id, t, lead(t) OVER (PARTITION BY id ORDER BY t) AS following FROM e) "
    f"SELECT id, t AS last_ms, t + {DUE_DAYS * 86400000} AS due_ms FROM n WHERE ((t + {DUE_DAYS * 86400000}) // 3600000 + 1) * 3600000 "
    f"<= (SELECT epoch_us(max(ts)) // 1000 - 7200000 FROM events) AND (following IS NULL OR following > t + {DUE_DAYS * 86400000})",
}
