"""The incremental load as a stream of files: every micro-batch is merged by the batch function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.entities import ingest_objects
from orrery.sources.files import path_exists


# Objects are dealt into this many buckets by their id; a micro-batch rewrites the buckets that it touches.
BUCKETS = 64


def _version_path(target: str, version: int) -> str:
    return f"{target}/version={version}"


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers n of the folders ``name=n`` below a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}="))


def _versions(spark: SparkSession, target: str, below: int | None = None) -> dict[int, list[int]]:
    """Per bucket its complete versions, oldest first; a version counts once its success marker is there."""
    found: dict[int, list[int]] = {}
    for version in _numbered(spark, target, "version"):
        if (below is None or version < below) and path_exists(spark, f"{_version_path(target, version)}/_SUCCESS"):
            for bucket in _numbered(spark, _version_path(target, version), "bucket"):
                found.setdefault(bucket, []).append(version)
    return found


def _read(spark: SparkSession, target: str, schema: T.StructType, newest: dict[int, int]) -> DataFrame:
    paths = [f"{_version_path(target, v)}/bucket={b}" for b, v in sorted(newest.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_current(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The newest complete version of every bucket."""
    return _read(spark, target, schema, {b: own[-1] for b, own in _versions(spark, target).items()})


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def merge_batches(target: str, schema: T.StructType, id_col: str, seq: str, refresh: bool = True):
    """foreachBatch handler. Batch n merges the buckets that it touches with their newest version below n and writes them
    as version n, so a repeated batch after a failure gives the same result instead of being applied twice. Once it is
    complete, versions of these buckets before the one that it merged with are dropped."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(id_col), F.lit(BUCKETS))
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS numbers
        earlier = {b: own for b, own in _versions(spark, target, below=batch_id).items() if b in touched}
        known = _read(spark, target, schema, {b: own[-1] for b, own in earlier.items()})
        merged = ingest_objects(known, batch, id_col, seq, refresh)
        merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(_version_path(target, batch_id))
        for b, own in earlier.items():
            for version in own[:-1]:
                _drop(spark, f"{_version_path(target, version)}/bucket={b}")

    return handle


def run_available(
    spark: SparkSession, source: str, schema: T.StructType, target: str, id_col: str, seq: str, refresh: bool = True, files_per_batch: int = 100
) -> DataFrame:
    """Load all files that have arrived and return the merged table; the offsets are kept below the target."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    handle = merge_batches(target, schema, id_col, seq, refresh)
    running = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{target}/_offsets").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    current = read_current(spark, target, schema)
    return current.select(id_col, *[F.col(c) for c in current.columns if c != id_col])
