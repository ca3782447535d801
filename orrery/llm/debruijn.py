"""Removal of repeated passages over a De Bruijn graph of word windows.

Every window of 13 words is an edge (from its first twelve words to its last twelve). Documents are dealt into blocks by
ranges of doc_id, so a smaller block holds only smaller ids. Each block folds its edges and ships their sorted hashes,
with the place of their first occurrence, packed per range of hashes; so a window that a third of all documents
share is shipped once per block. Per range the occurrences of an edge meet and the later blocks learn the source: block
and place of the first one.

These answers are joined with the blocks. Edges that follow one another in a document, and whose sources follow one another
too, form a path without branches between the document and its source; it is compacted to one span with source
coordinates. A span of several edges is thereby verified by its source: each edge is there, and in sequence. Every word
that a repeated edge covers is removed.

Defined cases: a null text has no words; fewer words than a window are kept; a null doc_id comes after all numbers and is
no source; rows that repeat a doc_id are no sources for each other; other columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

WINDOW = 13
# A block holds some 8 MB of text; beyond 1024 blocks they grow up to 64 MB.
LEAST_BLOCK, MOST_BLOCK = 8 << 20, 64 << 20
FACTOR = 0x9E3779B97F4A7C15
KNOWN_WORDS = 400_000


class WordHashes(dict):
    """Word to its hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxh64_intdigest(word)
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def edge_hashes(words: list[bytes], known: WordHashes, window: int = WINDOW) -> np.ndarray:
    """64-bit hash of every window of consecutive words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if len(known) > KNOWN_WORDS:
        known.clear()
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    for j in range(window):
        total *= np.uint64(FACTOR)
        total += each[j : j + n]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return total


def planes(*columns: np.ndarray) -> bytes:
    """Integer columns, byte by byte and pressed: the zero bytes of small numbers cost next to nothing."""
    body = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(body)


def from_planes(data: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(body[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


class Block:
    """The documents of a block in id order, and their edges: hashes, distinct ones, and first places."""

    def __init__(self, frame: pd.DataFrame):
        order = np.argsort(frame["doc_id"].fillna(0).to_numpy(np.int64), kind="stable")
        self.frame = frame.iloc[order]
        known = WordHashes()
        parts, words = [], []
        for text in self.frame["text"]:
            own = words_of(text)
            words.append(len(own))
            parts.append(edge_hashes(own, known))
        self.words = np.array(words, np.int64)
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, the place of each one's first edge, and the number of each edge's hash."""
        return np.unique(self.hashes, return_index=True, return_inverse=True)


def bucket_bounds(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the hash ranges by the leading bits in the sorted hashes."""
    marks = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(distinct, marks), [len(distinct)]))


def block_count(text_bytes: int) -> int:
    return max(1, -(-text_bytes // min(MOST_BLOCK, max(LEAST_BLOCK, text_bytes // 1024))))


def deal(docs: DataFrame) -> tuple[DataFrame, int]:
    """(block, doc_id, text): ranges of doc_id with about the same number of rows, nulls in the last; and their number."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = block_count(docs.select(F.sum(F.octet_length("text"))).first()[0] or 0)
    shares = [i / blocks for i in range(1, blocks)]
    found = docs.select(F.percentile_approx("doc_id", shares or [0.5], max(10_000, 20 * blocks))).first()[0]
    marks = np.array(sorted(set(found or []))[: blocks - 1], np.int64)

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        numbers = np.searchsorted(marks, ids.fillna(0).to_numpy(np.int64), "left").astype(np.int32)
        return pd.Series(np.where(ids.isna(), len(marks) + 1, numbers))

    return docs.withColumn("block", block("doc_id")).select("block", "doc_id", "text"), blocks


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, block, first_place, n_words, n_removed, the kept words joined by spaces (kept), and paths.

    A path is (first word, edges, source block, source place): ``edges`` windows from ``first`` on repeat those from the
    source place on. ``first_place`` is the place of the document's first edge in its block.
    """
    dealt, blocks = deal(docs)
    bits = (blocks - 1).bit_length()

    def ship(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["block"].iloc[0])
        distinct, first, _ = Block(frame).distinct()
        bounds = bucket_bounds(distinct, bits)
        out = []
        for bucket, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if a < b:
                steps = np.diff(distinct[a:b], prepend=np.uint64(0))
                out.append((bucket, number, int(b - a), planes(steps, first[a:b].astype("<u4"))))
        return pd.DataFrame(out, columns=["bucket", "block", "n", "edges"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", kind="stable")
        hashes, places, own, inside = [], [], [], []
        for number, n, data in zip(frame["block"], frame["n"], frame["edges"]):
            steps, first = from_planes(data, n, ["<u8", "<u4"])
            hashes.append(np.cumsum(steps, dtype=np.uint64))
            places.append(first)
            own.append(np.full(n, number, np.int32))
            inside.append(np.arange(n, dtype=np.uint32))
        h, place, number, at = map(np.concatenate, (hashes, places, own, inside))
        order = np.argsort(h, kind="stable")  # the smallest block comes first among equals
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        source = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later, source = order[~new], source[~new]
        back = np.lexsort((at[later], number[later]))
        later, source = later[back], source[back]
        bounds = np.concatenate((np.flatnonzero(np.diff(number[later], prepend=-1)), [len(later)]))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            some, of = later[a:b], source[a:b]
            steps = np.diff(at[some].astype(np.int64), prepend=0).astype("<u4")
            data = planes(steps, number[of].astype("<u4"), place[of].astype("<u4"))
            out.append((int(number[some[0]]), int(frame["bucket"].iloc[0]), len(some), data))
        return pd.DataFrame(out, columns=["block", "bucket", "n", "answers"])

    def remove(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame([], columns=["block", "doc_id", "first_place", "n_words", "n_removed", "kept", "paths"])
        number = int(frame["block"].iloc[0])
        block = Block(frame)
        distinct, first, which = block.distinct()
        bounds = bucket_bounds(distinct, bits)
        source_block = np.full(len(distinct), -1, np.int64)
        source_place = np.zeros(len(distinct), np.int64)
        for bucket, n, data in zip(answers["bucket"], answers["n"], answers["answers"]):
            steps, of, place = from_planes(data, n, ["<u4", "<u4", "<u4"])
            at = bounds[bucket] + np.cumsum(steps, dtype=np.int64)
            source_block[at], source_place[at] = of, place
        # What no earlier block holds can still have its source in this one, in a document with a smaller id.
        ids = block.frame["doc_id"]
        id_of = np.repeat(ids.fillna(0).to_numpy(np.int64), block.sizes)
        here = source_block < 0
        smaller = here[which] & (id_of[first[which]] < id_of) & (not ids.isna().any())
        repeated = ~here[which] | smaller
        of = np.where(smaller, number, source_block[which])
        place = np.where(smaller, first[which], source_place[which])
        out = []
        for doc_id, text, start, size, n_words in zip(ids, block.frame["text"], block.starts, block.sizes, block.words):
            flags = repeated[start : start + size]
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            words = words_of(text)
            paths: list[dict] = []
            kept = words
            if flags.any():
                hit = np.flatnonzero(flags)
                b, p = of[start + hit], place[start + hit]
                breaks = np.flatnonzero((np.diff(hit) != 1) | (np.diff(b) != 0) | (np.diff(p) != 1)) + 1
                ends = np.concatenate((breaks, [len(hit)]))
                cover = np.zeros(n_words + 1, np.int64)
                for i, j in zip(np.concatenate(([0], breaks)), ends):
                    paths.append({"first": int(hit[i]), "edges": int(j - i), "source_block": int(b[i]), "source_place": int(p[i])})
                    cover[hit[i]] += 1
                    cover[hit[j - 1] + WINDOW] -= 1
                kept = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
            joined = b" ".join(kept).decode("utf-8", "surrogatepass")
            out.append((number, doc_id, int(start), int(n_words), int(n_words) - len(kept), joined, paths))
        made = pd.DataFrame(out, columns=["block", "doc_id", "first_place", "n_words", "n_removed", "kept", "paths"])
        return made.astype({"doc_id": "Int64"})

    shipped = dealt.groupBy("block").applyInPandas(ship, "bucket int, block int, n int, edges binary")
    answers = shipped.groupBy("bucket").applyInPandas(meet, "block int, bucket int, n int, answers binary")
    joined = dealt.groupBy("block").cogroup(answers.groupBy("block"))
    paths = "array<struct<first:long,edges:long,source_block:int,source_place:long>>"
    return joined.applyInPandas(
        remove, f"block int, doc_id long, first_place long, n_words long, n_removed long, kept string, paths {paths}"
    )


def repeated_spans(found: DataFrame) -> DataFrame:
    """(doc_id, first, n_words, source_id, source_first): the compacted paths of ``repeated_passages`` with the
    document and word at which their source starts.

    Paths meet the documents of their source block by place: both sides are cut into ranges of places and joined there.
    """
    width = 4096
    ends = F.lead("first_place").over(Window.partitionBy("block").orderBy("first_place"))
    holders = found.filter("n_words >= " + str(WINDOW)).select(
        F.col("block").alias("source_block"), F.col("doc_id").alias("source_id"), F.col("first_place"),
        F.coalesce(ends, F.col("first_place") + F.col("n_words")).alias("_end"),
    )
    cut = lambda c: F.floor(F.col(c) / width)
    spread = holders.withColumn("_range", F.explode(F.sequence(cut("first_place"), F.floor((F.col("_end") - 1) / width))))
    paths = found.select("doc_id", F.explode("paths").alias("_p")).select("doc_id", "_p.*").withColumn("_range", cut("source_place"))
    met = paths.join(spread, ["source_block", "_range"]).filter("source_place >= first_place and source_place < _end")
    return met.select(
        "doc_id", "first", (F.col("edges") + WINDOW - 1).alias("n_words"), "source_id",
        (F.col("source_place") - F.col("first_place")).alias("source_first"),
    )

