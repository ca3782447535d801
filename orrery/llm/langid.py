"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (1 to 3 letters, words parted by one blank) that occur in
both, blended over the lengths and divided by the root of the texts' own numbers. N-grams are hashed to ``BUCKETS``
buckets; presence counts, not frequency. A bounded set of landmark texts spans the feature space (Nyström), one
ridge regression per language separates it from the rest, and texts are scored by the product of a batch's presence
matrix with the landmarks' presence and the solution. As the product of the latter two is the same for all texts, it is
formed once.

The model learns from at most ``PER_LANGUAGE`` texts of each language, those with the smallest hashes of doc_id, of which
``LANDMARKS`` are landmarks; every text is read whole and every document is scored.

Defined cases: a null text, and one without a letter, is `und` with score 0; without any labelled text all are; a null
doc_id reads as the empty string, which counts as held out; repeated rows each come out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.helpers import process_store, spoonfuls

BUCKETS = 1 << 20
PER_LANGUAGE, LANDMARKS = 200, 16
RIDGE = 1e-3
SHARPNESS = 4.0
UNKNOWN = "und"
# A winner with less than this many times the mean weight of the other languages is no better than an even split.
LEAST_ODDS = 9 / 7
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def letters() -> np.ndarray:
    """By code point: is it a letter?"""
    known = process_store("letters")
    if "table" not in known:
        known["table"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return known["table"]


class Grams:
    """Distinct buckets of a text's n-grams; one scratch table serves all texts of a task."""

    def __init__(self):
        self.letters = letters()
        self.mark = np.zeros(BUCKETS, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.where(self.letters[points], points, 0).astype(np.uint64)
        filled = points != 0
        if not filled.any():
            return np.zeros(0, np.int64)
        # One blank between words and at both ends.
        keep = filled.copy()
        keep[1:] |= filled[:-1]
        points = points[keep]
        blank = np.zeros(1, np.uint64)
        points = np.concatenate((blank, points, blank[: int(points[-1] != 0)]))
        code = np.zeros(len(points), np.uint64)
        codes = []
        for n, factor in enumerate(FACTORS):
            code = (code[: len(points) - n] + points[n:] + np.uint64(1)) * np.uint64(factor)
            code ^= code >> np.uint64(29)
            codes.append((code * np.uint64(FACTORS[0])) >> np.uint64(44))
        codes = np.concatenate(codes).astype(np.int64)
        order = np.arange(len(codes), dtype=np.int32)
        self.mark[codes] = order
        return codes[self.mark[codes] == order]


def products(texts: Iterable[str | None], grams: Grams, place: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batch by batch: the presence matrix of the texts times ``matrix`` (a row per place; bucket b has row place[b]),
    each row divided by the root of the text's number of n-grams; and these numbers."""
    for some in spoonfuls(texts):
        found = [grams(t) for t in some]
        sizes = np.array([len(g) for g in found], np.int64)
        rows = [place[g] for g in found]
        rows = [r[r >= 0] for r in rows]
        counts = np.array([len(r) for r in rows], np.int64)
        out = np.zeros((len(some), matrix.shape[1]))
        full = np.flatnonzero(counts)
        if len(full):
            starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
            out[full] = np.add.reduceat(matrix[np.concatenate(rows)], starts, axis=0)
        yield out / np.sqrt(np.maximum(sizes, 1))[:, None], sizes


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text, rank): at most ``per_language`` labelled texts of each language, outside the held-out fifth."""
    draw = F.xxhash64(F.col("doc_id"), F.lit(11))
    learnable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).withColumn("_draw", draw)
    first = Window.partitionBy("lang").orderBy("_draw")
    slim = learnable.select("lang", "_draw").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_language)
    limits = {r.lang: r.most for r in slim.groupBy("lang").agg(F.max("_draw").alias("most")).collect()}
    if not limits:
        return learnable.select("lang", "text", F.lit(0).alias("rank")).limit(0)
    under = F.lit(False)
    for lang, most in sorted(limits.items()):
        under = under | ((F.col("lang") == lang) & (F.col("_draw") <= most))
    order = Window.partitionBy("lang").orderBy("_draw", F.xxhash64("text"))
    ranked = learnable.filter(under).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= per_language).select("lang", "text", "rank")


class Model:
    """Languages, row of each bucket, and the weights: presence times weights is the score before the division."""

    def __init__(self, languages: list[str], place: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.place, self.weights, self.bias = languages, place, weights, bias


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on the bounded sample; only n-grams of landmarks and kernel rows of sample texts reach the driver."""
    sample = training_rows(docs.select("doc_id", "lang", "text"), per_language).persist()

    def landmark_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for frame in frames:
            yield pd.DataFrame({"grams": [grams(t or "").astype("<i4").tobytes() for t in frame["text"]]})

    rows = sample.filter(F.col("rank") <= landmarks).orderBy("lang", "rank").mapInPandas(landmark_grams, "grams binary").collect()
    marks = [g for r in rows if len(g := np.frombuffer(bytes(r.grams), "<i4"))]
    if not marks:
        sample.unpersist()
        return None
    buckets = np.unique(np.concatenate(marks))
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    presence = np.zeros((len(buckets), len(marks)), np.float32)
    for i, g in enumerate(marks):
        presence[place[g], i] = 1 / np.sqrt(len(g))

    def kernel_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for frame in frames:
            at = 0
            for rows, sizes in products(frame["text"], grams, place, presence):
                own = frame["lang"].iloc[at : at + len(rows)]
                at += len(rows)
                some = sizes > 0
                yield pd.DataFrame({"lang": own[some], "row": list(rows[some])})

    kernel = sample.mapInPandas(kernel_rows, "lang string, row array<double>").collect()
    sample.unpersist()
    languages = sorted({r.lang for r in kernel})
    between = np.stack([presence[place[g]].sum(0) / np.sqrt(len(g)) for g in marks]).astype(np.float64)
    value, vector = np.linalg.eigh((between + between.T) / 2)
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    features = np.array([r.row for r in kernel]) @ root
    features = np.hstack((features, np.ones((len(features), 1))))
    target = np.where(np.array([r.lang for r in kernel])[:, None] == np.array(languages), 1.0, -1.0)
    penalty = ridge * len(features) * np.eye(features.shape[1])
    penalty[-1, -1] = 0
    solution = np.linalg.solve(features.T @ features + penalty + 1e-12 * np.eye(len(penalty)), features.T @ target)
    weights = presence @ (root @ solution[:-1]).astype(np.float32)
    return Model(languages, place, weights, solution[-1])


def odds(score: Column, model: Model) -> Column:
    """Weight of the winner over the mean weight of the other languages: 1 for an even split, however many there are."""
    return F.try_divide(score * (len(model.languages) - 1), 1 - score)


def least_odds(found: DataFrame, model: Model) -> float:
    """The bound on ``odds`` under which a language counts as not recognised: ``LEAST_ODDS``, or less if over one in a
    thousand of the held-out labelled documents that are identified rightly would fall under it."""
    clean = found.filter(held_out(F.col("doc_id")) & (F.col("lang_pred") != UNKNOWN) & (F.col("lang") == F.col("lang_pred")))
    low = clean.agg(F.percentile_approx(F.coalesce(odds(F.col("lang_score"), model), F.lit(LEAST_ODDS)), 0.001, 100_000)).first()[0]
    return LEAST_ODDS if low is None else min(LEAST_ODDS, low)


def recognised(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents whose language is recognised; without a model, all that have a letter."""
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, model)
    bound = least_odds(identify(docs.select("doc_id", "lang", "text").filter(held_out(F.col("doc_id")) & F.col("lang").isNotNull()), model), model)
    # Without a second language, or with all the weight on one, there is nothing to compare with.
    clear = F.coalesce(odds(F.col("lang_score"), model) >= bound, F.lit(True)) if len(model.languages) > 1 else F.lit(True)
    return found.filter((F.col("lang_pred") != UNKNOWN) & clear).select(*docs.columns)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of the documents, with lang_pred and lang_score (columns of these names are replaced)."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0)})

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        grams = Grams()
        names, scores = [], []
        for sums, sizes in products(texts, grams, model.place, model.weights):
            margin = SHARPNESS * (sums + model.bias)
            margin -= margin.max(1, keepdims=True)
            share = np.exp(margin)
            best = margin.argmax(1)
            share = share[np.arange(len(best)), best] / share.sum(1)
            names += [model.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), sizes.tolist())]
            scores += np.where(sizes > 0, share, 0.0).tolist()
        return pd.DataFrame({"lang": names, "score": scores})

    out = docs.withColumn("_found", predict("text"))
    return out.withColumns({"lang_pred": F.col("_found.lang"), "lang_score": F.col("_found.score")}).drop("_found")
