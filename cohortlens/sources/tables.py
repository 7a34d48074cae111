"""Explicit schemas, the typed reader and the partitioned writer.

Schemas are always given, never inferred: inference reads the data an extra time and
lets one odd file change a column's type.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.plans.skew import as_list

# The tables the catalogue's queries read.
TABLE_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# The clinical tables the operators are meant for.
DOMAIN_SCHEMAS: dict[str, str] = {
    "patient": "patient_id STRING, site STRING, birth_year INT, sex STRING, ethnicity STRING, height_cm DOUBLE, "
    "weight_kg DOUBLE, comorbidities ARRAY<STRING>, medications ARRAY<STRING>",
    "implant": "patient_id STRING, implant_ts TIMESTAMP, approach STRING, valve_type STRING, manufacturer STRING, "
    "model STRING, size_mm INT",
    "echo": "patient_id STRING, visit_ts TIMESTAMP, reader STRING, mean_gradient DOUBLE, gradient_unit STRING, "
    "peak_velocity DOUBLE, eoa_cm2 DOUBLE, report STRING",
    "outcome": "patient_id STRING, event_ts TIMESTAMP, source STRING, kind STRING",
    "prediction": "patient_id STRING, pred_ts TIMESTAMP, risk ARRAY<STRUCT<horizon: INT, prob: DOUBLE>>, tier STRING, "
    "top ARRAY<STRUCT<feature: STRING, contribution: DOUBLE>>, next_days INT",
    "score": "entity STRING, criterion STRING, score INT",
    "weight": "criterion STRING, weight DECIMAL(4,2)",
}

READERS = ("parquet", "csv", "json", "orc")


def load(
    spark: SparkSession,
    folder: str,
    table: str,
    schema: str | T.StructType | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Read ``folder/table.fmt`` with an explicit schema (A1)."""
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt}; use one of {', '.join(READERS)}")
    schema = schema or TABLE_SCHEMAS.get(table) or DOMAIN_SCHEMAS.get(table)
    if schema is None:
        raise KeyError(f"no schema known for {table}; pass one")
    if fmt == "csv":
        options = {"header": "true", "mode": "FAILFAST", **options}
    return spark.read.format(fmt).schema(schema).options(**options).load(os.path.join(folder, f"{table}.{fmt}"))


def write_table(
    df: DataFrame,
    path: str,
    partition_by: str | Sequence[str] | None = None,
    mode: str = "errorifexists",
    max_rows_per_file: int = 5_000_000,
) -> None:
    """Write a feature or prediction table as Parquet, laid out by partition value (A3).

    Rebalancing first gives each partition value few, evenly sized files: adaptive
    execution splits a value that holds much of the data and merges the small ones, so
    one dominant site neither lands in one task nor leaves a file per map task.
    """
    cols = as_list(partition_by)
    out = df.hint("rebalance", *[F.col(c) for c in cols]) if cols else df.hint("rebalance")
    writer = out.write.mode(mode).option("maxRecordsPerFile", max_rows_per_file)
    if cols:
        writer = writer.partitionBy(*cols)
    writer.parquet(path)
