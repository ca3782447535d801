"""Session helpers: local test session, shared scratch folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

# A side is broadcast only where its estimated size in bytes is at or below this bound.
BROADCAST_BYTES = 64 << 20

# Files' bytes behind one partition of a shuffle whose tasks hold their rows: the session's number of partitions is fixed, and
# a task's memory would grow with the tables.
DEALT_BYTES = 8 << 20


def local_session(cores: str = "8", partitions: int = 8, app: str = "orrery") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one the session names, or a fresh local one in local mode."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return named or current
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors can reach")
        named = tempfile.mkdtemp(prefix="orrery-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are on shared storage and survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, by a Parquet table in the shared folder: the planner then sees its true size. A checkpoint keeps
    the estimate of its plan, which a loop that joins a table to what came of it multiplies without end."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_bytes(df: DataFrame) -> int:
    """Size of the files under a frame, by the planner's figures for its scans; each scan counts."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(s.stats().sizeInBytes())) for s in scans if s.getClass().getSimpleName() == "LogicalRelation")


def dealt(df: DataFrame, *keys: str, per_partition: int | None = None) -> DataFrame:
    """Hash-partition by the keys, so that a partition stands for at most ``DEALT_BYTES`` of the files under the frame. As
    it is while the session's number of partitions is enough for that."""
    parts = -(-file_bytes(df) // (per_partition or DEALT_BYTES))
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the planner's own estimate of the side, in bytes, fits the bound; no job is run.

    Beyond the bound the join is left to shuffle, and to adaptive execution.
    """
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(estimate)) <= limit else df
