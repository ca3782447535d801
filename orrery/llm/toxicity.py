"""Toxicity by logistic regression with the FTRL-proximal rule over hashed word n-grams and skip-grams.

The features of a text are its distinct words, pairs of neighbours, and pairs with one word between them, hashed
to ``BUCKETS``. Every coordinate has a learning rate of its own, and the L1 term leaves few weights, which travel in
the tasks' closure: a sorted list of buckets and their weights, bounded by ``BUCKETS``.

The model learns from at most ``SAMPLE`` labelled documents, those with the smallest hashes of doc_id. Features in less
than ``LEAST_SHARE`` of them, or in fewer than ``LEAST``, are left out. The sample is packed into ``SHARDS`` rows of kept features; in
each of ``ROUNDS`` rounds every shard runs once through its documents from the common state, and the new state adds the
mean change over the shards that touched a coordinate. Counts and changes travel as packed runs of coordinates. Only the
state (two numbers per kept feature) passes the driver.

Defined cases: a null, empty or wordless text has the score of the bias alone; label rows with a null doc_id or label are
ignored; of several labels of a document the highest holds; of several texts of a labelled doc_id the smallest is learnt;
without labels every score is 0; a null doc_id reads as the empty string in the split; repeated rows each come out;
other columns are ignored; an empty table gives an empty one; long texts are read in windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from orrery.llm.helpers import smallest_draws, stored

BITS = 21
BUCKETS = 1 << BITS
GAPS = (1, 2)
SAMPLE, LEAST_SHARE, LEAST = 20_000, 0.001, 3
SHARDS, ROUNDS = 4, 6
# Coordinates in one packed run.
RUN = 1 << 14
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1.0, 1.0
BOUND = 0.3
WORD = re.compile(r"[^\W_]+")
WINDOW = 100_000
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's words and pairs, ascending."""
    found = []
    tail = np.zeros(0, np.uint64)
    for some in batched((m.group() for m in WORD.finditer((text or "").lower())), WINDOW):
        own = np.fromiter(map(xxh64_intdigest, some), np.uint64, len(some))
        words = np.concatenate((tail, own))
        hashes = [own]
        for gap in GAPS:
            # Pairs within the tail were found with the window before.
            left = words[max(0, len(tail) - gap) : -gap]
            hashes.append((left * MIX ^ words[len(words) - len(left) :]) * np.uint64(STEP + 2 * gap))
        found.append(np.unique((np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int32)))
        tail = words[-max(GAPS) :]
    return found[0] if len(found) == 1 else np.unique(np.concatenate([np.zeros(0, np.int32), *found]))


def weights_of(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float = L1) -> np.ndarray:
    """The weights that the sums of gradients (z) and of their squares (n) stand for."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class State:
    """z and n of the kept features, and of the bias in the last place, which no L1 term holds down."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step for an example with these features."""
        at = np.append(at, len(self.z) - 1)
        l1 = np.full(len(at), L1)
        l1[-1] = 0.0
        z, n = self.z[at], self.n[at]
        w = weights_of(z, n, l1)
        g = sigmoid(w.sum()) - label
        root = np.sqrt(n)
        self.z[at] = z + g - (np.sqrt(n + g * g) - root) / ALPHA * w
        self.n[at] = n + g * g


def passed(state: State, examples: Iterable[tuple[np.ndarray, int]]) -> State:
    """The state after one pass over a shard."""
    own = State(len(state.z) - 1)
    own.z[:], own.n[:] = state.z, state.n
    for at, label in examples:
        own.learn(at, label)
    return own


def runs(values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of every run of coordinates that holds anything (the last axis is cut)."""
    for number, at in enumerate(range(0, values.shape[-1], RUN)):
        part = values[..., at : at + RUN]
        if part.any():
            yield number, part.tobytes()


def summed(packed: DataFrame, rows: int, size: int) -> np.ndarray:
    """Sums of the packed runs of a bounded number of tasks or shards, as an array of ``rows`` by ``size``."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for number, part in zip(frame["run"].tolist(), frame["part"]):
                values = np.frombuffer(part, np.float64)
                sums[number] = sums[number] + values if number in sums else values
        yield pd.DataFrame({"run": list(sums), "part": [v.tobytes() for v in sums.values()]})

    out = np.zeros((rows, size))
    for r in packed.repartition("run").mapInPandas(add, "run int, part binary").toLocalIterator():
        part = np.frombuffer(bytes(r.part), np.float64).reshape(rows, -1)
        out[:, r.run * RUN : r.run * RUN + part.shape[1]] = part
    return out


class Weights:
    """Buckets with a weight (ascending), their weights, and the bias."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray, bias: float):
        self.buckets, self.values, self.bias = buckets, values, bias


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, label, text): at most ``size`` labelled documents outside the held-out part."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    learnable = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    drawn = marks.join(learnable.select("doc_id"), "doc_id", "left_semi").withColumn("_draw", F.xxhash64("doc_id", F.lit(13)))
    chosen = stored(smallest_draws(drawn, "_draw", size).orderBy("_draw").limit(size).select("doc_id", "label"), "labelled")
    # Two numbers for each of at most ``size`` rows.
    return learnable.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def kept_features(sample: DataFrame) -> np.ndarray:
    """Buckets in at least ``LEAST_SHARE`` of the sample, and in ``LEAST`` documents, ascending."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS)
        for frame in frames:
            for text in frame["text"]:
                counts[features(text)] += 1
        yield pd.DataFrame(runs(counts), columns=["run", "part"])

    counts = summed(sample.mapInPandas(counted, "run int, part binary"), 1, BUCKETS)[0]
    return np.flatnonzero(counts >= max(LEAST, LEAST_SHARE * sample.count())).astype(np.int32)


def packed_examples(sample: DataFrame, kept: np.ndarray) -> DataFrame:
    """One row per shard: labels, number of features, and features of its documents, in the order of their hashes."""
    hashes = {"shard": F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(SHARDS)).cast("int"), "order": F.xxhash64("doc_id", F.lit(19))}
    sent = sample.sparkSession.sparkContext.broadcast(kept)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(BUCKETS, -1, np.int32)
        place[sent.value] = np.arange(len(sent.value))
        for frame in frames:
            places = [place[features(t)] for t in frame["text"]]
            yield frame[["shard", "order", "label"]].assign(places=[p[p >= 0].tobytes() for p in places])

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order")
        sizes = (frame["places"].str.len() // 4).to_numpy(np.int32)
        return pd.DataFrame({"labels": [frame["label"].to_numpy(np.int8).tobytes()], "sizes": [sizes.tobytes()], "places": [b"".join(frame["places"])]})

    rows = sample.withColumns(hashes).mapInPandas(hashed, "shard int, order long, label int, places binary")
    return stored(rows.groupBy("shard").applyInPandas(packed, "labels binary, sizes binary, places binary"), "examples")


def fit(sample: DataFrame) -> Weights | None:
    """Learn from rows (doc_id, label 0 or 1, text), a bounded sample."""
    sample = stored(sample, "sample")
    if sample.isEmpty():
        return None
    kept = kept_features(sample)
    shards = packed_examples(sample, kept)
    state = State(len(kept))
    for _ in range(ROUNDS):
        sent = sample.sparkSession.sparkContext.broadcast(state)

        def passes(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for labels, sizes, places in zip(frame["labels"], frame["sizes"], frame["places"]):
                    cuts = np.cumsum(np.frombuffer(sizes, np.int32))[:-1]
                    examples = zip(np.split(np.frombuffer(places, np.int32), cuts), np.frombuffer(labels, np.int8).tolist())
                    state = sent.value
                    own = passed(state, examples)
                    changes = np.stack([own.z - state.z, own.n - state.n, (own.n != state.n).astype(np.float64)])
                    yield pd.DataFrame(runs(changes), columns=["run", "part"])

        z, n, times = summed(shards.mapInPandas(passes, "run int, part binary"), 3, len(kept) + 1)
        state.z += z / np.maximum(times, 1)
        state.n += n / np.maximum(times, 1)
        sent.destroy()
    values = weights_of(state.z[:-1], state.n[:-1])
    some = np.flatnonzero(values)
    return Weights(kept[some], values[some], float(weights_of(state.z[-1:], state.n[-1:], 0.0)[0]))


def scored(docs: DataFrame, weights: Weights | None) -> DataFrame:
    """(doc_id, score): the probability that a document is toxic."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if weights is None:
        return slim.select("doc_id", F.lit(0.0).alias("score"))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(BUCKETS)
        dense[weights.buckets] = weights.values
        for some in texts:
            yield pd.Series([float(sigmoid(dense[features(t)].sum() + weights.bias)) for t in some], dtype="float64")

    return slim.select("doc_id", score("text").alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, by the labels of the learning part."""
    found = scored(docs, fit(labelled_sample(docs, labels)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= BOUND).cast("int").alias("predicted"))
