"""Structured Streaming operators on arriving measurements.

Event times must be TIMESTAMP, since a watermark cannot be set on TIMESTAMP_NTZ; read with
``event_time`` to convert. All three run with bounded state: the watermark drops it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.plans.skew import as_list


def event_time(df: DataFrame, t: str) -> DataFrame:
    """Read a zoneless time column as UTC so that it can carry a watermark."""
    return df.withColumn(t, F.col(t).cast("timestamp"))


def stream_dedup(stream: DataFrame, keys, t: str, delay: str) -> DataFrame:
    """Drop repeats of a measurement that arrive within the lateness bound."""
    return stream.withWatermark(t, delay).dropDuplicatesWithinWatermark(as_list(keys))


def linear_score(coef: Mapping[str, float], intercept: float) -> Column:
    """Logistic probability of a linear predictor, as one expression; missing inputs add nothing."""
    z = F.lit(float(intercept))
    for name, b in coef.items():
        z = z + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * F.lit(float(b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def stream_score(
    stream: DataFrame, cohort: DataFrame, id: str, coef: Mapping[str, float], intercept: float, out: str = "score"
) -> DataFrame:
    """Score each arriving row against the static cohort (N2); rows of unknown entities are kept, unscored.

    Spark broadcasts the cohort only if its size is under the session's limit and shuffles
    otherwise. Works the same on a batch frame.
    """
    known = cohort.withColumn("_known", F.lit(1))
    both = stream.join(known, id, "left")
    return both.withColumn(out, F.when(F.col("_known") == 1, linear_score(coef, intercept))).drop("_known")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Merges sessions within map tasks before they are shuffled.
MERGE_LOCALLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def stream_overdue(
    stream: DataFrame, id: str, t: str, due_days: int, delay: str, slot_seconds: int = 3600
) -> DataFrame:
    """One alert per visit that is not followed by another within ``due_days``.

    ``last_ms`` is the visit, ``due_ms`` when the next was due; both are exact, to the
    millisecond. Alerts fire as the watermark passes the slot that holds the due time, so a
    stream that stops sending altogether raises none until something arrives, and results do not
    depend on how arrivals were cut into batches. A visit opens a session up to its due time,
    which a visit by then extends; the last one of a session was not followed in time. State holds
    a row per open session and one per session that waits for the end of its slot, however many
    visits there are. With ``MERGE_LOCALLY`` a busy entity's visits are merged before they are shuffled.

    A visit that comes later than ``delay`` still counts if its own due time has not passed.
    """
    if slot_seconds >= due_days * 86_400:
        raise ValueError("a slot must be shorter than the due interval")
    due_ms = due_days * 86_400_000
    # visits lie on whole milliseconds and sessions that touch are merged: one closes after its due time, before the next millisecond
    visits = stream.withColumn(t, F.date_trunc("millisecond", t)).withWatermark(t, delay)
    sessions = (
        visits.groupBy(F.col(id).alias("id"), F.session_window(t, f"{due_ms * 1000 + 999} microseconds").alias("open"))
        .agg(F.max(F.unix_millis(t)).alias("last_ms"))
    )
    # sessions of an entity end further apart than a slot is long, so each is alone in its slot
    return (
        sessions.groupBy("id", F.window(F.window_time("open"), f"{slot_seconds} seconds").alias("slot"))
        .agg(F.max("last_ms").alias("last_ms"))
        .select("id", "last_ms", (F.col("last_ms") + F.lit(due_ms)).alias("due_ms"))
    )


def read_file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet file stream with an explicit schema, from a folder or a single file.

    A plain path must be a folder; written as a pattern, it may be a file as well.
    """
    pattern = path if any(ch in path for ch in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def write_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived into Parquet, exactly once, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
