"""Run registered queries against their SQL in DuckDB.

    python tests/check_queries.py [name-prefix ...] [--sf 0.01]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ROOT = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v)
        df[c] = df[c].map(lambda v: "null" if v is None else repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark_df, con, text: str) -> str:
    """Empty when equal, else what differs."""
    kinds = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()) for f in spark_df.schema}
    got = canonical(spark_df.toPandas())
    rel = con.sql(text)
    want_kinds = dict(zip(rel.columns, [str(t) for t in rel.types]))
    want = canonical(rel.df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    notes = [f"type {c}: {kinds[c]} != {want_kinds[c]}" for c in kinds if kinds[c] != want_kinds[c]]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got.equals(want):
        off = (got != want).any(axis=1)
        return f"{int(off.sum())} of {len(got)} rows differ\n{got[off].head(3).to_string()}\n{want[off].head(3).to_string()}"
    if len(got) == 0:
        notes.append("no rows")
    return "; ".join(notes)


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from cohortlens.session import local_session

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    d = f"{ROOT}/sf{sf}"
    con = connect(d)
    texts, bad = e.oracle_sql(), 0
    for name, query in e.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t0 = time.time()
        try:
            df = query(spark, d)
            note = compare(df, con, texts[name]) if name in texts else f"rows only: {df.count()}"
        except Exception as exc:  # report and go on to the next query
            note = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(note) and not note.startswith("rows only")
        print(f"{name:28s} {time.time() - t0:6.2f}s  {note or 'ok'}", flush=True)
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
