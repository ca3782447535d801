"""Linear models: one fit, a cut-off sweep over dummy columns, many refits, significance and explanations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.hashing import uniform
from orrery.operators.profile import regression_scores


def _fit(df: DataFrame, features: Sequence[str], target: str):
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    return LinearRegression(featuresCol="_x", labelCol=target, predictionCol="pred", solver="normal", regParam=0.0).fit(ready), ready


def fit_linear(df: DataFrame, features: Sequence[str], target: str, row_key: Sequence[str], train: float = 0.7, seed: int = 17):
    """Fit on a hash share of the rows, predict all: (rows with pred and delta, weights by size, intercept, scores)."""
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    model = LinearRegression(featuresCol="_x", labelCol=target, predictionCol="pred", solver="normal").fit(
        ready.filter(uniform(seed, *row_key) < train)
    )
    rows = model.transform(ready).drop("_x").withColumn("delta", F.col(target) - F.col("pred"))
    weights = sorted(zip(features, [float(c) for c in model.coefficients]), key=lambda p: p[1])
    return rows, weights, float(model.intercept), regression_scores(rows, target, "pred")


# -- Gram matrices -----------------------------------------------------------------------------------------------------
def _products(names: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(names)) for j in range(i, len(names))]


def _gram_columns(names: Sequence[str]) -> list[Column]:
    return [F.sum(F.col(names[i]).cast("double") * F.col(names[j])).alias(f"g{i}_{j}") for i, j in _products(names)]


def _matrix(values: Sequence[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for (i, j), v in zip([(i, j) for i in range(size) for j in range(i, size)], values):
        out[i, j] = out[j, i] = v
    return out


def _solve(gram: np.ndarray, picks: Sequence[int], target: int) -> tuple[np.ndarray, float]:
    """Coefficients on the picked columns (0 is the constant) and R squared; collinear columns share their weight."""
    inner, cross = gram[np.ix_(picks, picks)], gram[picks, target]
    scale = 1 / np.sqrt(np.maximum(np.diag(inner), 1e-300))
    beta = scale * (np.linalg.pinv(inner * np.outer(scale, scale), rcond=1e-11, hermitian=True) @ (scale * cross))
    n, total = gram[0, 0], gram[0, target]
    spread = gram[target, target] - total * total / n
    error = gram[target, target] - 2 * beta @ cross + beta @ inner @ beta
    return beta, 1 - error / spread if spread > 0 else float("nan")


def cutoff_sweep(df: DataFrame, dummies: Sequence[str], target: str, start: float = 0.8, step: float = 0.01) -> list[dict]:
    """Fits on the dummy columns whose sum exceeds a falling share of the rows, best R squared first.

    One aggregate yields all inner products; every cut-off then solves a part of that small matrix. Kept are fits with a
    positive R squared and intercept; ``best`` marks the largest R squared times ten over the number of columns.
    """
    names = ["_one", *dummies, target]
    row = df.withColumn("_one", F.lit(1.0)).agg(*_gram_columns(names)).first()
    gram = _matrix([float(v or 0.0) for v in row], len(names))
    n = gram[0, 0]
    out = []
    solved: dict[tuple[int, ...], tuple[np.ndarray, float]] = {}
    share = start
    while share > 0.0:
        picks = tuple(i for i in range(1, len(names) - 1) if gram[0, i] > share * n)
        if picks:
            if picks not in solved:
                solved[picks] = _solve(gram, [0, *picks], len(names) - 1)
            beta, r2 = solved[picks]
            r2 = float(r2)
            if r2 > 0 and beta[0] > 0:
                out.append({"cutoff": float(share * n), "r2": r2, "columns": [names[i] for i in picks], "intercept": float(beta[0]), "weights": beta[1:].tolist()})
        share -= step
    out.sort(key=lambda r: -r["r2"])
    if out:
        best = max(range(len(out)), key=lambda i: out[i]["r2"] * 10.0 / len(out[i]["columns"]))
        for i, r in enumerate(out):
            r["best"] = i == best
    return out


def best_features(sweep: Sequence[dict], numeric: Sequence[str], exclude: Sequence[str] = (), after: int = 3) -> list[str]:
    """Dummy columns of all fits up to two places after the best one, then the numeric columns."""
    best = next((i for i, r in enumerate(sweep) if r["best"]), 0)
    seen = {c: None for r in sweep[: best + after] for c in r["columns"]}
    return [c for c in [*seen, *numeric] if c not in exclude]


def repeated_fits(df: DataFrame, features: Sequence[str], target: str, row_key: Sequence[str], fits: int = 300, train: float = 0.7, buckets: int = 1000, seed: int = 17) -> DataFrame:
    """(fit, intercept, r2, one weight column per feature) of refits on random shares of the rows.

    Rows are hashed into buckets and the inner products summed once per bucket; every fit draws its training buckets, so
    the table is read once however many fits are asked for. R squared is over all rows.
    """
    names = ["_one", *features, target]
    size = len(names)
    cells = [f"g{i}_{j}" for i, j in _products(names)]
    bucket = F.floor(uniform(seed, *row_key) * buckets).cast("int")
    grams = df.withColumn("_one", F.lit(1.0)).groupBy(bucket.alias("bucket")).agg(*_gram_columns(names))
    drawn = grams.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(fits - 1))))
    inside = uniform(seed + 1, "bucket", "fit") < train
    sums = drawn.groupBy("fit").agg(
        *[F.sum(F.when(inside, F.col(c)).otherwise(0.0)).alias(f"t{c}") for c in cells], *[F.sum(c).alias(c) for c in cells]
    )
    schema = "fit int, intercept double, r2 double, " + ", ".join(f"`{f}` double" for f in features)

    def solve(frames):
        for pdf in frames:
            out = []
            for rec in pdf.to_dict("records"):
                beta, _ = _solve(_matrix([rec[f"t{c}"] for c in cells], size), list(range(size - 1)), size - 1)
                whole = _matrix([rec[c] for c in cells], size)
                inner, cross, n = whole[: size - 1, : size - 1], whole[: size - 1, size - 1], whole[0, 0]
                spread = whole[-1, -1] - whole[0, -1] ** 2 / n
                error = whole[-1, -1] - 2 * beta @ cross + beta @ inner @ beta
                out.append([rec["fit"], beta[0], 1 - error / spread, *beta[1:]])
            yield pd.DataFrame(out, columns=["fit", "intercept", "r2", *features])

    return sums.mapInPandas(solve, schema)


def mean_weights(fits: DataFrame) -> DataFrame:
    """(feature, weight): the mean over all refits, the intercept included."""
    cols = [c for c in fits.columns if c not in ("fit", "r2")]
    return fits.agg(*[F.avg(c).alias(c) for c in cols]).unpivot([], cols, "feature", "weight")


def significance(df: DataFrame, features: Sequence[str], target: str, level: float = 0.1) -> DataFrame:
    """(feature, weight, p_value, significant), the constant left out."""
    model, _ = _fit(df, features, target)
    rows = [(f, float(w), float(p), bool(p <= level)) for f, w, p in zip(features, model.coefficients, model.summary.pValues)]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double, p_value double, significant boolean")


def explain_rows(df: DataFrame, id_cols: Sequence[str], features: Sequence[str], weights: dict[str, float], intercept: float) -> DataFrame:
    """(ids, feature, weight, value, product, prediction): the parts of each row's prediction."""
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.lit(float(weights[f])).alias("weight"), F.col(f).cast("double").alias("value"), (F.col(f) * float(weights[f])).alias("product"))
            for f in features
        ]
    )
    total: Column = F.lit(float(intercept))
    for f in features:
        total = total + F.col(f) * float(weights[f])
    return df.select(*id_cols, total.alias("prediction"), F.inline(cells))
