"""Stand-in cohort on the given tables, and the same cohort as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.cohort import index_event
from cohortlens.operators.endpoints import competing, first_event, survival_table
from cohortlens.operators.features import from_baseline
from cohortlens.plans.flows import time_to_causes, time_to_crossing
from cohortlens.plans.skew import skew_join
from cohortlens.sources import load

RISE, LEVEL = 200_000.0, 400_000.0
MISSING_BELOW = 100_000.0
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def visits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderkey").alias("vk"),
        F.col("o_orderdate").alias("t"),
        F.col("o_totalprice").alias("x"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("prio"),
    )


def gappy_visits(spark: SparkSession, d: str) -> DataFrame:
    """Visits whose low measures count as missing."""
    return visits(spark, d).withColumn("x", F.when(F.col("x") >= MISSING_BELOW, F.col("x")))


def patients(spark: SparkSession, d: str) -> DataFrame:
    nation, region = load(spark, d, "nation"), load(spark, d, "region")
    site = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    c = load(spark, d, "customer")
    return c.join(site, c.c_nationkey == site.n_nationkey).select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("site"),
        F.col("c_acctbal").alias("balance"),
    )


def cohort(spark: SparkSession, d: str) -> DataFrame:
    return index_event(visits(spark, d), "id", "t", ["x"], "vk").join(patients(spark, d), "id")


def crossings(spark: SparkSession, d: str) -> DataFrame:
    """Visits with their change from baseline and whether they cross the stand-in threshold."""
    v = visits(spark, d)
    changed = from_baseline(v, index_event(v, "id", "t", ["x"], "vk"), id="id", x="x", baseline="index_x")
    crossed = (F.col("x_change") >= RISE) & (F.col("x") >= LEVEL)
    return changed.withColumn("flag", crossed.cast("int"))


def survival(spark: SparkSession, d: str) -> DataFrame:
    """(id, segment, site, balance, index_t, index_x, n_visits, time, event)."""
    return time_to_crossing(
        visits(spark, d), patients(spark, d), id="id", order=["t", "vk"], x="x", rise=RISE, level=LEVEL,
        keep=["segment", "site", "balance"],
    )


def survival_by_steps(spark: SparkSession, d: str) -> DataFrame:
    """The same from the separate operators: index, change, first event, censoring."""
    events = first_event(crossings(spark, d), "id", ["t", "vk"], "flag")
    return survival_table(
        cohort(spark, d), events, visits(spark, d), id="id", index="index_t", event_t="event_t", last_t="t",
    )


def shipped(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their customer: another source of dated outcomes."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    owners = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    return skew_join(lines, owners, "l_orderkey").select(
        "id", F.col("l_shipdate").alias("t"), F.col("l_returnflag").alias("kind")
    )


def causes(spark: SparkSession, d: str) -> DataFrame:
    """Cause 1: the measure crossed; cause 2: an R shipment more than two years after index."""
    crossed = crossings(spark, d).where("flag = 1").select("id", "t", F.lit(1).alias("cause"))
    late = skew_join(shipped(spark, d).where(F.col("kind") == "R"), cohort(spark, d).select("id", "index_t"), "id")
    late = late.where(F.datediff("t", "index_t") > 730).select("id", "t", F.lit(2).alias("cause"))
    return crossed.unionByName(late)


def competing_table(spark: SparkSession, d: str) -> DataFrame:
    """(id, segment, site, time, cause) from one pass over the visits."""
    others = shipped(spark, d).where(F.col("kind") == "R").withColumn("cause", F.lit(2))
    return time_to_causes(
        visits(spark, d), patients(spark, d), others, id="id", order=["t", "vk"], x="x", rise=RISE, level=LEVEL,
        t="t", after_days=730, keep=["segment", "site"],
    )


def competing_by_steps(spark: SparkSession, d: str) -> DataFrame:
    """The same from the separate operators: cohort, causes, last contact."""
    return competing(
        cohort(spark, d), causes(spark, d), visits(spark, d),
        id="id", index="index_t", t="t", cause="cause", last_t="t", keep=["segment", "site"],
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """The survival table with two stand-in risk scores, not rounded."""
    low = (F.lit(600_000.0) - F.col("index_x")) / 600_000.0
    bal = (F.col("balance") + 1000.0) / 11_000.0
    return survival(spark, d).withColumns({"score": low, "other": bal})


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at six decimals and dates as text, so that engines can be compared.

    Halves go up, by arithmetic both engines do alike; their own ``round`` treats them differently.
    """
    cols: list[Column] = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            c = F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(field.name))
    return df.select(*cols)


# ---- the same things in SQL -------------------------------------------------------------

CTES = {
    "v": "SELECT o_custkey AS id, o_orderkey AS vk, o_orderdate AS t, o_totalprice AS x, "
    "o_orderstatus AS status, o_orderpriority AS prio FROM orders",
    "gv": f"SELECT id, vk, t, CASE WHEN x >= {MISSING_BELOW} THEN x END AS x, status, prio FROM v",
    "pat": "SELECT c_custkey AS id, c_mktsegment AS segment, r_name AS site, c_acctbal AS balance FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, vk) AS rn, "
    "count(*) OVER (PARTITION BY id) AS n_visits FROM v",
    "coh": "SELECT r.id, r.t AS index_t, r.x AS index_x, r.n_visits, p.segment, p.site, p.balance "
    "FROM ranked r JOIN pat p ON p.id = r.id WHERE rn = 1",
    "cross_": "SELECT v.*, c.index_x, v.x - c.index_x AS x_change, "
    f"CASE WHEN v.x - c.index_x >= {RISE} AND v.x >= {LEVEL} THEN 1 ELSE 0 END AS flag "
    "FROM v JOIN (SELECT id, x AS index_x FROM ranked WHERE rn = 1) c ON c.id = v.id",
    "ends": "SELECT id, max(t) AS last_t FROM v GROUP BY id",
    "firsts": "SELECT id, min(t) AS event_t FROM cross_ WHERE flag = 1 GROUP BY id",
    "surv": "SELECT coh.*, CAST(date_diff('day', index_t, coalesce(event_t, last_t)) AS INTEGER) AS time, "
    "CAST(event_t IS NOT NULL AS INTEGER) AS event FROM coh JOIN ends USING (id) LEFT JOIN firsts USING (id)",
    "ship": "SELECT o_custkey AS id, l_shipdate AS t, l_returnflag AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "caus": "SELECT id, t, 1 AS cause FROM cross_ WHERE flag = 1 UNION ALL SELECT s.id, s.t, 2 FROM ship s "
    "JOIN coh c ON c.id = s.id WHERE s.kind = 'R' AND date_diff('day', c.index_t, s.t) > 730",
    "fc": "SELECT id, t, cause FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, cause) AS k FROM caus) WHERE k = 1",
    "comp": "SELECT coh.id, segment, site, CAST(date_diff('day', index_t, least(coalesce(fc.t, last_t), last_t)) AS INTEGER) AS time, "
    "CAST(CASE WHEN fc.t <= last_t THEN cause ELSE 0 END AS INTEGER) AS cause "
    "FROM coh JOIN ends USING (id) LEFT JOIN fc USING (id)",
    "scor": "SELECT *, (600000.0::DOUBLE - index_x) / 600000.0::DOUBLE AS score, (balance + 1000.0::DOUBLE) / 11000.0::DOUBLE AS other FROM surv",
}
NEEDS = {
    "gv": ["v"], "ranked": ["v"], "coh": ["ranked", "pat"], "cross_": ["ranked"], "ends": ["v"], "firsts": ["cross_"],
    "surv": ["coh", "ends", "firsts"], "caus": ["cross_", "ship", "coh"], "fc": ["caus"],
    "comp": ["coh", "ends", "fc"], "scor": ["surv"],
}


def sql(names: str, body: str, **extra: str) -> str:
    """``body`` behind the named shared CTEs, those they need, and its own."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({text})" for n, text in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def rd(expr: str, digits: int = 6) -> str:
    """As ``r6`` rounds."""
    unit = f"1e{digits}::DOUBLE"
    return f"(floor(CAST({expr} AS DOUBLE) * {unit} + 0.5::DOUBLE) / {unit})"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"
