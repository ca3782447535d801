"""Exact top-k inner products over a bit-sliced index.

Every attribute of a block of rows is quantised to an integer and stored as slices: one bitmap per bit, over the rows.
For a query the slices are added as bitmaps, shifted by the bits of its weights (a negative weight adds the complement),
with full adders column by column; a batch of queries is added at once. The slices of the sums are then read from the
most significant downward: a row set either holds enough rows and becomes the candidate set, or all of it is in the
result. What is left at the end ties, and the smaller ids win. The k best of every block are merged by Spark.

Queries are met with all rows in blocks of both. Vectors are compared with those of their own length only.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; an
empty vector scores 0 with other empty ones; a query's own row is left out, a repeated row is a row of its own; a score
beyond a long is clipped to it; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.helpers import stored

SCALE = 256
BLOCK_ROWS = 1 << 15
QUERY_ROWS = 512
# Words of 64 rows that one bitmap operation covers, over all queries of a batch.
BATCH_WORDS = 1 << 14
LONG = 2**63


def quantise(vectors: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of equally long vectors; Python integers where longs could overflow."""
    scaled = np.floor(scale * np.array(vectors, np.float64).reshape(len(vectors), -1))
    if scaled.size and np.abs(scaled).max() >= 2**31:
        return np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)
    return scaled.astype(np.int64)


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Row flags as words of 64 rows, row 0 in the lowest bit."""
    packed = np.packbits(bits.astype(bool), bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def slices(values: np.ndarray) -> tuple[list[list[np.ndarray]], list[int]]:
    """Bitmaps per attribute, lowest bit first, of the values above the attribute's least one, and these least values."""
    if not values.shape[1]:
        return [], []
    least = [int(x) for x in values.min(0)]
    out = []
    for d, low in enumerate(least):
        above = values[:, d] - low
        out.append([bitmap((above >> k) & 1) for k in range(int(above.max()).bit_length())])
    return out, least


def add_slices(sliced: list[list[np.ndarray]], weights: np.ndarray, words: int) -> list[np.ndarray]:
    """Slices (queries x words) of the sum of |weight| times the attribute, or its complement for a negative weight."""
    columns: dict[int, list[np.ndarray]] = {}
    ones = np.uint64(2**64 - 1)
    flip = np.where(weights < 0, ones, np.uint64(0)).astype(np.uint64)
    size = np.abs(weights)
    shape = (len(weights), words)

    def put(column: int, new: np.ndarray) -> None:
        """Add a bitmap to a column: three of them leave their sum, and their carry goes to the next column."""
        waiting = columns.setdefault(column, [])
        if len(waiting) < 2:
            waiting.append(new)
            return
        a, b = waiting.pop(), waiting.pop()
        half = a ^ b
        carry = half & new
        np.bitwise_and(a, b, out=a)
        np.bitwise_or(carry, a, out=carry)
        np.bitwise_xor(half, new, out=half)
        waiting.append(half)
        put(column + 1, carry)

    for d, planes in enumerate(sliced):
        own = [np.bitwise_xor(plane[None, :], flip[:, d : d + 1]) for plane in planes]
        for j in range(int(size[:, d].max()).bit_length() if planes else 0):
            chosen = np.where((size[:, d] >> j) & 1, ones, np.uint64(0)).astype(np.uint64)[:, None]
            for k, plane in enumerate(own):
                put(j + k, plane & chosen)
    sums: list[np.ndarray] = []
    column = 0
    while column <= max(columns, default=-1):
        waiting = columns.get(column, [])
        if len(waiting) == 2:
            a, b = waiting
            sums.append(a ^ b)
            put(column + 1, a & b)
        else:
            sums.append(waiting[0] if waiting else np.zeros(shape, np.uint64))
        column += 1
    return sums


def select_top(sums: list[np.ndarray], rows: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each query the row numbers of its k highest sums among ``rows`` (queries x words), ties to the lower number."""
    maybe, sure = rows.copy(), np.zeros_like(rows)
    taken = np.zeros(len(rows), np.int64)
    for plane in reversed(sums):
        high = maybe & plane
        n = np.bitwise_count(high).sum(1, dtype=np.int64)
        enough = taken + n >= k
        taken += np.where(enough, 0, n)
        enough = enough[:, None]
        sure |= np.where(enough, np.uint64(0), high)
        maybe = np.where(enough, high, maybe & ~plane)
    for q in range(len(rows)):
        certain = np.flatnonzero(np.unpackbits(sure[q].view(np.uint8), bitorder="little"))
        boundary = np.flatnonzero(np.unpackbits(maybe[q].view(np.uint8), bitorder="little"))
        yield np.concatenate((certain, boundary[: k - len(certain)]))


def block_top(values: np.ndarray, sliced, own_rows: list[int], weights: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Row numbers of the k best rows of a block for each query; own_rows: the query's own row in the block, or -1."""
    words = -(-len(values) // 64)
    all_rows = bitmap(np.ones(len(values), bool))
    batch = max(1, BATCH_WORDS // words)
    for at in range(0, len(weights), batch):
        some = weights[at : at + batch]
        rows = np.repeat(all_rows[None, :], len(some), 0)
        for q, own in enumerate(own_rows[at : at + batch]):
            if own >= 0:
                rows[q, own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        yield from select_top(add_slices(sliced, some, words), rows, k)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, vector) of the vectors that take part; the row number is frozen in a stored table."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fine)
    return stored(
        kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), x.alias("vector")),
        "vectors",
    )


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(dims, block, rows, ids, vectors): up to ``size`` vectors of one length, in id order within a block."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dims: int) -> pd.DataFrame:
            own = sorted(held.pop(dims), key=lambda r: (r[1], r[0]))
            return pd.DataFrame(
                {
                    "dims": [dims],
                    "block": [own[0][0]],
                    "rows": [np.array([r[0] for r in own], "<i8").tobytes()],
                    "ids": [np.array([r[1] for r in own], "<i8").tobytes()],
                    "vectors": [np.array([r[2] for r in own], "<f8").tobytes()],
                }
            )

        for frame in frames:
            for r in zip(frame["row"], frame["id"], frame["vector"]):
                own = held.setdefault(len(r[2]), [])
                own.append(r)
                if len(own) == size:
                    yield block(len(r[2]))
        for dims in list(held):
            yield block(dims)

    return rows.mapInPandas(pack, "dims int, block long, rows binary, ids binary, vectors binary")


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every query row over all other rows."""
    rows = usable(vectors.select(id_col, vector_col), id_col, vector_col)
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = packed(rows, BLOCK_ROWS).withColumn("share", F.pmod(F.xxhash64("block"), F.lit(spread)))
    # Queries go to every share of the row blocks, in blocks of their own.
    queries = packed(rows.filter(is_query), QUERY_ROWS).select(
        "dims",
        F.col("rows").alias("q_rows"),
        F.col("ids").alias("q_ids"),
        F.col("vectors").alias("q_vectors"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))).alias("share"),
    )

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: tuple = (None, None, None)
        for frame in frames:
            for r in frame.itertuples(index=False):
                n, m = len(r.ids) // 8, len(r.q_ids) // 8
                if built[0] != r.block:
                    values = quantise(np.frombuffer(r.vectors, "<f8").reshape(n, r.dims))
                    built = (r.block, values, slices(values)[0])
                _, values, sliced = built
                weights = quantise(np.frombuffer(r.q_vectors, "<f8").reshape(m, r.dims))
                if values.dtype == object or weights.dtype == object:
                    values, weights = values.astype(object), weights.astype(object)
                ids, q_ids = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.q_ids, "<i8")
                own = np.frombuffer(r.rows, "<i8")
                at = {row: i for i, row in enumerate(own.tolist())}
                q_rows = np.frombuffer(r.q_rows, "<i8").tolist()
                out = []
                for q, found in enumerate(block_top(values, sliced, [at.get(x, -1) for x in q_rows], weights, k)):
                    scores = (values[found] * weights[q]).sum(1)
                    out += [
                        (q_rows[q], int(q_ids[q]), int(own[i]), int(ids[i]), max(-LONG, min(LONG - 1, int(s))))
                        for i, s in zip(found.tolist(), scores)
                    ]
                yield pd.DataFrame(out, columns=["q_row", "query_id", "row", "vec_id", "score"])

    met = blocks.join(queries, ["dims", "share"])
    found = met.mapInPandas(best, "q_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
