"""Exact de-duplication as a stateful stream, with full texts compared on hits.

Keys of arriving rows (digest, identifier, place of the content) are landed as files. A
structured stream reads them and keeps, for every digest and without expiry, the smallest
identifier, where that row's content is, and how many rows had the digest; the state lives
in RocksDB on the executors' disks and is checkpointed in the shared folder, so later
arrivals continue it. A row whose digest is known is a hit: its whole text is compared with
the text found at the stored place, and texts that differ under one digest are classed by
the text itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.rows import RowMarks, small_enough
from cohortlens.session import materialized, shared_dir

#: Settings of the keyed state: on disk, with its memory on an executor bounded.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk set aside for each
}
#: Bytes of landed keys that one micro-batch takes.
BATCH_BYTES = 16 << 30


def normalised(text: Column) -> Column:
    """Null as empty; each run of space, tab, LF, VT, FF, CR as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(df: DataFrame) -> DataFrame:
    """``df`` with ``_path`` and ``_row``: the file and the row in it. Anything but a scan is written first."""
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")]
    bare = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("_metadata", "_path", "_row")])
    try:
        return bare.select("*", *place)
    except AnalysisException:
        return materialized(bare).select("*", *place)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _least() -> Column:
    """The row that stays: smallest identifier, null last; then its place, so that it is one row."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "path", "row"))


def land(docs: DataFrame, folder: str, id: str, text: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Append the keys of ``docs``, which has ``_path`` and ``_row``, to the landing folder."""
    docs.select(
        F.col(f"`{id}`").alias("id"), F.col("_path").alias("path"), F.col("_row").alias("row"), digest(normalised(F.col(f"`{text}`"))).alias("digest")
    ).write.mode("append").parquet(folder)


def absorb(spark: SparkSession, folder: str, checkpoint: str, schema, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Run the stream over what has landed since last time; the state: (digest, first, n) per digest."""
    with _settings(spark, STATE):
        arrivals = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(folder)
        kept = arrivals.groupBy("digest").agg(_least().alias("first"), F.count(F.lit(1)).alias("n"))
        query = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        first, n = (f.name for f in state.schema["value"].dataType.fields)
        return materialized(state.select("key.digest", F.col(f"value.{first}").alias("first"), F.col(f"value.{n}").alias("n")))


def dedup(
    docs: DataFrame, id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256,
    folder: str | None = None, arrived: DataFrame | None = None, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(id, path, row, keep_id, keep_path, keep_row, group_size, kept, digest) per row of located ``docs``.

    Of rows with equal normalised text that with the smallest identifier stays; a null one
    only if all are null; of equal identifiers the first by place, so that exactly one row
    stays. Null text is empty text. ``folder`` keeps landing files and state for a later call,
    whose ``arrived`` are the rows of ``docs`` that are new; without it a fresh one is used and
    all of ``docs`` arrive. An empty table gives no rows. Texts of any length are compared whole; other
    columns are not read, whatever their names, but ``_path`` and ``_row`` are the places of rows.
    """
    spark = docs.sparkSession
    base = folder or f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
    land(docs if arrived is None else arrived, f"{base}/landed", id, text, digest)
    landed = spark.read.parquet(f"{base}/landed")
    state = absorb(spark, f"{base}/landed", f"{base}/state", landed.schema, batch_bytes)
    classed = landed.join(state, "digest")
    other = _unequal(docs, state.where("n > 1").select("digest", F.col("first.path").alias("_first_path"), F.col("first.row").alias("_first_row")), id, text, digest)
    other = materialized(other)
    if other.isEmpty():
        out = classed
    else:  # some texts share a digest and differ
        fewer = other.groupBy("digest").agg(F.count(F.lit(1)).alias("_fewer"))
        own = other.withColumnsRenamed({"first": "_first", "n": "_n"}).drop("digest")
        out = classed.join(small_enough(materialized(fewer)), "digest", "left").join(own, ["path", "row"], "left")
        out = out.withColumns({"n": F.coalesce("_n", F.col("n") - F.coalesce("_fewer", F.lit(0))), "first": F.coalesce("_first", "first")})
    kept = (F.col("path") == F.col("first.path")) & (F.col("row") == F.col("first.row"))
    return out.select(
        "id", "path", "row", F.col("first.id").alias("keep_id"), F.col("first.path").alias("keep_path"), F.col("first.row").alias("keep_row"),
        F.col("n").alias("group_size"), kept.alias("kept"), "digest",
    )


def _unequal(docs: DataFrame, groups: DataFrame, id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Hits whose whole text differs from the text at the stored place: (path, row, digest, first, n) by their own text."""
    keyed = docs.select(F.col(f"`{id}`").alias("id"), F.col("_path").alias("path"), F.col("_row").alias("row"), normalised(F.col(f"`{text}`")).alias("text"))
    members = keyed.withColumn("digest", digest(F.col("text"))).join(small_enough(groups), "digest")
    at_place = (F.col("path") == F.col("_first_path")) & (F.col("row") == F.col("_first_row"))
    stored = members.where(at_place).select("digest", F.col("text").alias("stored"))
    hits = members.where(~at_place).select("digest", "id", "path", "row", "text")
    wrong = materialized(hits.join(stored, "digest").where(F.col("text") != F.col("stored")).drop("stored"))  # as a rule none
    classes = wrong.groupBy("digest", "text").agg(_least().alias("first"), F.count(F.lit(1)).alias("n"))
    return wrong.join(classes, ["digest", "text"]).select("path", "row", "digest", "first", "n")


def kept_rows(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of located ``docs`` that stay, with their own columns; they are told by marks, so texts stay where they are."""
    gone = materialized(classes.where("not kept").select(F.col("path").alias("_path"), F.col("row").alias("_row")))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("_path", "_row")]
    marks = RowMarks(gone, {"gone": F.lit(True)})
    if marks.bits is None:
        return docs.join(gone, ["_path", "_row"], "left_anti").select(*own)
    marked, is_set = marks.on(docs)
    return marked.where(~is_set["gone"]).select(*own)
