"""SimHash near-duplicates: fingerprints, and groups of documents whose fingerprints are linked.

A fingerprint is cut into 32 segments of two bits; the numbers of set bits per segment embed it in a grid, where the
Manhattan distance of two fingerprints never exceeds the number of bits in which they differ. The segments form six
groups. Within distance 3 at most three groups can differ, so at least three agree exactly: the range join meets every
pair in the grid cell of one of the twenty choices of three groups, and the exact distance is then taken.

Inside a cell no list of pairs is formed: a walk over the cell's fingerprints puts out a spanning forest of the true
links, at most one link per fingerprint. Cells beyond ``BLOCK`` fingerprints are cut into blocks, and blocks meet in
twos. Copies of a fingerprint are folded before any of this.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like others; a null doc_id is kept, and
a group of nulls alone has a null component; repeated rows come out as often as they come in; other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from orrery.llm.components import components
from orrery.llm.helpers import group_bounds, stored, whole_groups

SEED = 42
DISTANCE = 3
# Two-bit segments of each group.
GROUPS = [range(0, 6), range(6, 12), range(12, 17), range(17, 22), range(22, 27), range(27, 32)]
CHOICES = list(combinations(range(len(GROUPS)), len(GROUPS) - DISTANCE))
BLOCK = 4096


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of the word shingles of a text, in its order; a text with fewer words is one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))
    if len(found) >= words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    shingles = [joined[s:e] for s, e in zip(starts.tolist(), (ends - 1).tolist())]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over the word shingles of a text, as an unsigned integer."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp holds the 64 bits as a signed long."""

    def marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = np.array([fingerprint(t) for t in frame["text"]], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text_hash": frame["text_hash"], "fp": fps})

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return read.mapInPandas(marked, "doc_id long, text_hash long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: number of set bits in each of the 32 segments, one byte each."""
    pairs = (fp.astype(np.uint64)[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    return np.bitwise_count(pairs).astype(np.uint8)


def cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): the grid cells of every fingerprint, one for each choice of groups."""

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy(np.int64)
            counts = segment_counts(fp).astype(np.uint64)
            for number, choice in enumerate(CHOICES):
                cell = np.full(len(fp), number, np.uint64)
                for segment in (s for g in choice for s in GROUPS[g]):
                    cell = cell * np.uint64(3) + counts[:, segment]
                yield pd.DataFrame({"cell": cell.astype(np.int64), "fp": fp})

    return fps.mapInPandas(placed, "cell long, fp long")


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links within the distance that span the linked groups of one cell (fingerprints unsigned)."""
    links: list[tuple[int, int]] = []
    left = fp
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(left ^ node) <= DISTANCE
            if near.any():
                reached = left[near]
                links += zip(repeat(int(node)), reached.tolist())
                queue += list(reached)
                left = left[~near]
    return links


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links that span every group of distinct fingerprints within the distance of each other."""
    placed = cells(fps)
    crowded = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    met = (
        placed.join(crowded, "cell")
        .withColumn("_blocks", blocks)
        .withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int"))
        # With one block the pair is (0, 0); else a block meets every other one, and both bring all they have.
        .withColumn("_other", F.explode(F.when(F.col("_blocks") == 1, F.array(F.lit(0))).otherwise(
            F.filter(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda i: i != F.col("_own")))))
        .select("cell", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "fp")
    )

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["cell", "i", "j"]):
            fp = frame["fp"].to_numpy(np.int64).view(np.uint64)  # bitwise_count takes the magnitude of signed numbers
            bounds = group_bounds(frame, ["cell", "i", "j"])
            links: list[tuple[int, int]] = []
            sizes = np.diff(bounds)
            twos = bounds[:-1][sizes == 2]
            near = twos[np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= DISTANCE] if len(twos) else twos
            links += list(zip(fp[near].tolist(), fp[near + 1].tolist()))
            for at, n in zip(bounds[:-1][sizes > 2], sizes[sizes > 2]):
                links += forest(fp[at : at + n])
            if links:
                pairs = np.unique(np.array(links, np.uint64), axis=0).view(np.int64)
                yield pd.DataFrame(pairs, columns=["a", "b"])

    keys = ["cell", "i", "j"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): the group's root fingerprint, and the smallest doc_id in the group."""
    marked = stored(fingerprints(docs), "fingerprints")
    folded = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "folded")
    roots = components(fingerprint_links(folded.select("fp")), "a", "b")
    rooted = folded.join(roots, folded["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of every group: the one with the smallest doc_id (numbers before null, then the smaller hash of its text).

    The texts are dealt by (doc_id, hash) once, against a hash table of the documents to keep, and are not sorted.
    """
    found = near_duplicates(docs).select("doc_id", "text_hash", "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy("root").agg(F.min(order).alias("_first"))
    first = stored(first.select("_first.*"), "kept")
    slim = first.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    own = docs.withColumn("_own", F.xxhash64("text"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash"))
    kept = own.join(slim.hint("shuffle_hash"), same, "left_semi")
    # A repeated row of a document to keep passes the join as well; one look at the slim table tells if there is any.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_hash"))
    if rows.join(slim, (rows["_id"].eqNullSafe(slim["_id"])) & (rows["_hash"] == slim["_hash"]), "left_semi").count() > first.count():
        kept = kept.dropDuplicates(["doc_id", "_own"])
    return kept.select(*docs.columns)


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
