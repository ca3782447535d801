"""Shared steps of the text operators: stored tables, process-wide stores, groups out of sorted partitions, word ids."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import fresh_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: short lineage that survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame) -> int:
    """Partitions for an exchange of whole texts: the session's number, more where the input has more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def process_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that later tasks of a worker find it filled."""
    module = sys.modules.setdefault("_orrery_llm_store", types.ModuleType("_orrery_llm_store"))
    return module.__dict__.setdefault(name, {})


class WordCache:
    """Memo from a piece of text to its encoded form, for one worker, in two generations.

    New entries and hits go to the young generation; when it holds half of ``limit`` it becomes the old one, and the
    former old one is dropped. Common pieces stay, rare ones leave. ``encode_many`` gets a list of distinct pieces and
    returns their encodings in the same order.
    """

    def __init__(self, name: str, encode_many: Callable[[list], Iterable], limit: int = 600_000):
        self.store = process_store(name)
        self.store.setdefault("young", {})
        self.store.setdefault("old", {})
        self.encode_many = encode_many
        self.limit = limit

    def learn(self, pieces: Iterable) -> dict:
        """A mapping that holds these pieces; good until the next call."""
        if len(self.store["young"]) > self.limit // 2:
            self.store["old"], self.store["young"] = self.store["young"], {}
        young, old = self.store["young"], self.store["old"]
        missing = set(pieces).difference(young)
        if old and missing:
            known = {p: old[p] for p in missing if p in old}
            young.update(known)
            missing.difference_update(known)
        if missing:
            missing = list(missing)
            young.update(zip(missing, self.encode_many(missing)))
        return young


def spoonfuls(texts: Iterable[str | None], chars: int = 500_000) -> Iterator[list[str]]:
    """Texts in lists of some ``chars`` characters (a longer text alone), null as empty."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup the frames of a sorted partition so that no group of equal keys is torn between two of them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        changed = np.zeros(len(frame), bool)
        for k in keys:
            v = frame[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(changed)
        if held and any(held[-1][k].iloc[-1] != frame[k].iloc[0] for k in keys):
            yield pd.concat(held, ignore_index=True)
            held = []
        if len(cuts):
            yield pd.concat([*held, frame.iloc[: cuts[-1]]], ignore_index=True)
            held = [frame.iloc[cuts[-1] :]]
        else:
            held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Start positions of the groups of a sorted frame, and its length at the end."""
    changed = np.ones(len(frame), bool)
    if len(frame) > 1:
        changed[1:] = False
        for k in keys:
            v = frame[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(changed), len(frame))


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Send texts to Python in batches of at most ``rows``: a batch is held by the JVM and the worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def smallest_draws(df: DataFrame, draw: str, n: int) -> DataFrame:
    """Some rows with the smallest 64-bit hashes, about 4 n of all, however many partitions there are: a top-n of
    them reads little, where a top-n of everything would bring n rows of every partition to one task."""
    rows = df.count()
    if rows <= 4 * n:
        return df
    return df.filter(F.col(draw) < int(-(2**63) + 2**64 * (4 * n / rows)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
