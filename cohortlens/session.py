"""Session settings the operators are designed for.

None is required for right results. ``forceOptimizeSkewedJoin`` matters at scale:
without it Spark leaves a skewed join alone when splitting it would cost a later
aggregate its partitioning, which is exactly the join-then-group-by-entity shape
used throughout this package.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: The most that a task reads, as stored: sorts and hash tables hold some ten times that. Smaller values of the session stay.
TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": 32 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
}
#: Parts that a shuffle is cut into at least before adaptive execution joins the small ones: with the session's number
#: alone, often that of its cores, a task's memory grows with the input.
PARTS = 400


def _bytes(setting: str) -> int:
    """The number of bytes of a size as Spark writes it, such as 128MB, 16m or 67108864b."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", setting.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to a running session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    for key, most in TASK_BYTES.items():
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, f"{most}b")
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "cohortlens") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session that
    names none gets a temporary folder; elsewhere a missing setting is an error,
    because a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, so lost executors cost nothing already
    computed, but computes ``df`` once rather than twice and keeps it columnar, so later
    reads prune columns and know its true size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cohortlens-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def splits_skewed_joins(spark: SparkSession) -> bool:
    """Whether adaptive execution splits skewed joins, whatever comes after them."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin")
    return all(spark.conf.get(n, "false").lower() == "true" for n in names)
