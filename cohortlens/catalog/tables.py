"""Sources, cleaning and cohort construction (groups A to C)."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import functions as F

from cohortlens.catalog import base
from cohortlens.catalog.base import day, r6, rd, sql
from cohortlens.operators import cleaning
from cohortlens.operators.cohort import attrition, cohort_size, exclude_history, include, incidence, index_event
from cohortlens.plans.skew import skew_join
from cohortlens.session import shared_dir
from cohortlens.sources import harmonize_codes, load, unmapped_codes, write_table

# The column whose total each table reports, so that the scan reads more than a footer.
TOTALS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_partkey", "events": "user_id", "documents": "n_chars",
    "embeddings": "label", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "turn",
}
BRAND_MAP = [(f"Brand#{i}", f"Maker {(i - 1) // 5 + 1}") for i in range(1, 21)]
UNITS = {"F": 1.0, "O": 1.0 / 1.35951}
NUMBERS = {"percent": r"([0-9]+(?:\.[0-9]+)?)%", "dollars": r"([0-9]+(?:\.[0-9]+)?)\$"}


def _load(spark, d):
    counts = [
        load(spark, d, t).agg(
            F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(c).cast("bigint")).alias("total")
        )
        for t, c in TOTALS.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


def _mapping(spark):
    return spark.createDataFrame(BRAND_MAP, "p_brand STRING, canonical STRING")


def _harmonize(spark, d):
    parts = load(spark, d, "part").select("p_partkey", "p_brand")
    return harmonize_codes(parts, _mapping(spark), "p_brand")


def _written(spark, d):
    """Write visits by status, read one status back, so that partition pruning is used."""
    path = os.path.join(shared_dir(spark), f"visits-{uuid.uuid4().hex}")
    write_table(base.visits(spark, d), path, "status")
    back = spark.read.schema("id BIGINT, vk BIGINT, t TIMESTAMP_NTZ, x DOUBLE, prio STRING, status STRING").parquet(path)
    return r6(back.where(F.col("status") == "F").groupBy("prio").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")), 2)


def _dedup(spark, d):
    lines = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    order = [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_quantity"]
    return cleaning.dedup(lines, ["l_orderkey", "l_linenumber"], order)


def _range(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return cleaning.range_clean(lines, {"l_quantity": (5.0, 45.0), "l_extendedprice": (None, 90_000.0)})


def _units(spark, d):
    v = base.visits(spark, d).select("vk", "x", "status")
    return r6(cleaning.normalize_units(v, "x", "status", UNITS, "F"))


def _extract(spark, d):
    return cleaning.extract_measures(load(spark, d, "documents"), "text", NUMBERS, ["doc_id"])


def _availability(spark, d):
    return r6(cleaning.availability(
        base.visits(spark, d), base.cohort(spark, d), id="id", t="t", index="index_t",
        horizon_days=1826, tol_days=90, min_share=0.6, by="site",
    ))


def _missing(spark, d):
    v = skew_join(base.gappy_visits(spark, d), base.patients(spark, d).select("id", "site"), "id")
    v = v.withColumn("prio", F.when(F.col("prio") != "5-LOW", F.col("prio")))
    return r6(cleaning.missing_profile(v, ["x", "prio", "t"], "site"))


def _sparse(spark, d):
    v = base.gappy_visits(spark, d).select("vk", "x", "prio", "status")
    v = v.withColumns({
        "prio": F.when(F.col("prio") == "5-LOW", F.col("prio")),
        "status": F.when(F.col("status") != "P", F.col("status")),
    })
    return cleaning.drop_sparse(v, ["x", "prio", "status"], max_col_rate=0.5, max_row_rate=0.5)


def _readers(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return r6(cleaning.reader_variability(lines, ["l_orderkey", "l_linenumber"], "l_suppkey", "l_quantity"))


def _pooled(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    reads = cleaning.reader_variability(lines, ["l_orderkey", "l_linenumber"], "l_suppkey", "l_quantity")
    return r6(cleaning.pooled_variability(reads))


def _index(spark, d):
    return r6(index_event(base.visits(spark, d), "id", "t", ["x", "prio"], "vk"))


def _include(spark, d):
    c = base.cohort(spark, d).select("id", "segment", "balance", "index_x")
    return include(c, [F.col("segment").isin("BUILDING", "MACHINERY"), F.col("balance") > 0], id="id",
                   visits=base.visits(spark, d), t="t", min_visits=5, min_follow_up_days=1000)


def _exclude(spark, d):
    c = base.cohort(spark, d).select("id", "segment", "index_t")
    return r6(exclude_history(c, base.shipped(spark, d), id="id", index="index_t", t="t", kind="kind", kinds=["A"],
                              before_days=365, after_days=30))


def _criteria():
    return [
        ("five visits", F.col("n_visits") >= 5),
        ("positive balance", F.col("balance") > 0),
        ("baseline under 400k", F.col("index_x") < 400_000),
        ("followed two years", F.col("time") >= 730),
    ]


def _attrition(spark, d):
    return attrition(base.survival(spark, d), _criteria())


def _size(spark, d):
    return r6(cohort_size(base.survival(spark, d), "event", 12, "site"))


def _incidence(spark, d):
    return r6(incidence(base.survival(spark, d), "time", "event", "segment"))


QUERIES = {
    "A1_load": _load,
    "A2_harmonize_codes": _harmonize,
    "A2_unmapped_codes": lambda s, d: unmapped_codes(load(s, d, "part").select("p_brand"), _mapping(s), "p_brand"),
    "A3_write_table": _written,
    "B1_dedup": _dedup,
    "B2_range_clean": _range,
    "B3_normalize_units": _units,
    "B4_extract_measures": _extract,
    "B5_availability": _availability,
    "B6_missing_profile": _missing,
    "B7_drop_sparse": _sparse,
    "B8_reader_variability": _readers,
    "B8_pooled_variability": _pooled,
    "C1_index_event": _index,
    "C2_include": _include,
    "C3_exclude_history": _exclude,
    "C4_attrition": _attrition,
    "C5_cohort_size": _size,
    "C6_incidence": _incidence,
}

_MAP_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in BRAND_MAP)
_READS = (
    "SELECT l_orderkey, l_linenumber, count(*) AS n_reads, count(DISTINCT l_suppkey) AS n_readers, "
    "avg(l_quantity) AS mean_read, stddev_samp(l_quantity) AS sd_read, max(l_quantity) - min(l_quantity) AS range_read "
    "FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1"
)

SQL = {
    "A1_load": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST(sum({c}) AS BIGINT) AS total FROM {t}"
        for t, c in TOTALS.items()
    ),
    "A2_harmonize_codes": f"SELECT p_partkey, p_brand, coalesce(canonical, p_brand) AS canonical, "
    f"CAST(canonical IS NOT NULL AS INTEGER) AS is_mapped FROM part LEFT JOIN (VALUES {_MAP_VALUES}) m(code, canonical) "
    "ON p_brand = code",
    "A2_unmapped_codes": f"SELECT p_brand, count(*) AS n_rows FROM part WHERE p_brand NOT IN "
    f"(SELECT code FROM (VALUES {_MAP_VALUES}) m(code, canonical)) GROUP BY p_brand",
    "A3_write_table": sql("v", f"SELECT prio, count(*) AS n, {rd('sum(x)', 2)} AS x FROM v WHERE status = 'F' GROUP BY prio"),
    "B1_dedup": "SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, "
    "l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber, l_extendedprice DESC, l_partkey, l_suppkey, l_quantity",
    "B2_range_clean": "SELECT l_orderkey, l_linenumber, l_partkey, "
    "CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS l_quantity, "
    "CASE WHEN l_extendedprice <= 90000 THEN l_extendedprice END AS l_extendedprice, "
    "CAST(NOT l_quantity BETWEEN 5 AND 45 AS INTEGER) AS l_quantity_out_of_range, "
    "CAST(l_extendedprice > 90000 AS INTEGER) AS l_extendedprice_out_of_range FROM lineitem",
    "B3_normalize_units": sql(
        "v",
        f"SELECT vk, {rd('x * f')} AS x, CASE WHEN f IS NULL THEN status ELSE 'F' END AS status, "
        "CAST(f IS NULL AS INTEGER) AS x_unit_unknown FROM v LEFT JOIN fac USING (status)",
        fac=f"SELECT * FROM (VALUES ('F', 1.0::DOUBLE), ('O', {UNITS['O']!r}::DOUBLE)) u(status, f)",
    ),
    "B4_extract_measures": " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS measure, CAST(i AS INTEGER) AS position, TRY_CAST(l[i] AS DOUBLE) AS value FROM "
        f"(SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM "
        f"(SELECT doc_id, regexp_extract_all(text, '{pattern}', 1) AS l FROM documents))"
        for name, pattern in NUMBERS.items()
    ),
    "B5_availability": sql(
        "coh v",
        f"SELECT site, count(*) AS n, CAST(sum(seen) AS BIGINT) AS n_available, {rd('avg(seen)')} AS share, "
        "CAST(avg(seen) >= 0.6 AS INTEGER) AS meets_share FROM (SELECT site, CAST(EXISTS (SELECT 1 FROM v WHERE v.id = coh.id "
        "AND abs(date_diff('day', coh.index_t, v.t) - 1826) <= 90) AS INTEGER) AS seen FROM coh) GROUP BY site",
    ),
    "B6_missing_profile": sql(
        "gv pat",
        " UNION ALL ".join(
            f"SELECT site, count(*) AS n, '{c}' AS \"column\", CAST(sum(CAST({e} AS INTEGER)) AS BIGINT) AS n_missing, "
            f"{rd(f'avg(CAST({e} AS INTEGER))')} AS missing_rate FROM gv JOIN pat USING (id) GROUP BY site"
            for c, e in {"x": "x IS NULL", "prio": "prio = '5-LOW'", "t": "t IS NULL"}.items()
        ),
    ),
    "B7_drop_sparse": sql(
        "gv",
        "SELECT vk, x, status FROM (SELECT vk, x, CASE WHEN status <> 'P' THEN status END AS status FROM gv) "
        "WHERE x IS NOT NULL OR status IS NOT NULL",
    ),
    "B8_reader_variability": f"SELECT l_orderkey, l_linenumber, n_reads, n_readers, {rd('mean_read')} AS mean_read, "
    f"{rd('sd_read')} AS sd_read, {rd('range_read')} AS range_read FROM ({_READS})",
    "B8_pooled_variability": f"SELECT count(*) AS n_measurements, CAST(sum(n_reads) AS BIGINT) AS n_reads, "
    f"{rd('sqrt(sum((n_reads - 1) * sd_read * sd_read) / sum(n_reads - 1))')} AS pooled_sd FROM ({_READS})",
    "C1_index_event": sql(
        "ranked", f"SELECT id, {day('t')} AS index_t, {rd('x')} AS index_x, prio AS index_prio, n_visits FROM ranked WHERE rn = 1"
    ),
    "C2_include": sql(
        "coh v",
        "SELECT id, segment, balance, index_x FROM coh WHERE segment IN ('BUILDING', 'MACHINERY') AND balance > 0 AND n_visits >= 5 "
        "AND (SELECT date_diff('day', min(t), max(t)) FROM v WHERE v.id = coh.id) >= 1000",
    ),
    "C3_exclude_history": sql(
        "coh ship",
        f"SELECT id, segment, {day('index_t')} AS index_t FROM coh WHERE NOT EXISTS (SELECT 1 FROM ship s WHERE s.id = coh.id "
        "AND s.kind = 'A' AND date_diff('day', coh.index_t, s.t) BETWEEN -365 AND 30)",
    ),
    "C4_attrition": sql(
        "surv",
        "SELECT CAST(step AS INTEGER) AS step, criterion, n_left, coalesce(lag(n_left) OVER (ORDER BY step) - n_left, 0) AS n_dropped FROM ("
        + " UNION ALL ".join(
            f"SELECT {i} AS step, '{name}' AS criterion, count(*) AS n_left FROM surv WHERE {cond}"
            for i, (name, cond) in enumerate([
                ("all rows", "true"),
                ("five visits", "n_visits >= 5"),
                ("positive balance", "n_visits >= 5 AND balance > 0"),
                ("baseline under 400k", "n_visits >= 5 AND balance > 0 AND index_x < 400000"),
                ("followed two years", "n_visits >= 5 AND balance > 0 AND index_x < 400000 AND time >= 730"),
            ])
        )
        + ")",
    ),
    "C5_cohort_size": sql(
        "surv",
        f"SELECT site, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_events, {rd('avg(event)')} AS prevalence, "
        f"{rd('sum(event) / 12.0')} AS events_per_variable FROM surv GROUP BY site",
    ),
    "C6_incidence": sql(
        "surv",
        f"SELECT segment, CAST(sum(event) AS BIGINT) AS n_events, {rd('sum(time) / 365.25::DOUBLE')} AS person_years, "
        f"{rd('sum(event) / (sum(time) / 365.25::DOUBLE)')} AS rate FROM surv GROUP BY segment",
    ),
}
