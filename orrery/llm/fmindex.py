"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a run of documents within a task. Its words become numbers: those of the benchmark vocabulary, and 0 for any
other word, which no phrase can contain. Stretches of vocabulary words shorter than the shortest phrase are left out;
the others, each closed by a separator, are indexed: suffix array by prefix doubling, last column, a wavelet matrix for
ranks over it, and the text positions of every eighth suffix. All phrases are searched backward at once; occurrences are
walked to the next sampled position; the words that they cover are merged to spans.

The benchmark is the query set. It is collected in blocks of at most ``BLOCK_PHRASES`` distinct phrases, each block is
shipped to the tasks in its own pass, and the spans of the passes are merged.

Defined cases: a null text has no words and no hits; items without words have no phrases; rows that repeat an item_id
are one item, a null item_id reads as the empty string; repeated documents each come out; other columns are ignored;
without documents the result is empty, without phrases nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.helpers import stored

PHRASE_WORDS = 10
BLOCK_PHRASES = 500_000
SHARD_WORDS = 1 << 20
SAMPLE_EVERY = 8

# Bytes of words: digits, lower-cased letters and everything beyond ASCII; other bytes part words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Numbers(dict):
    """Word to its number; 0 for a word outside the vocabulary."""

    def __missing__(self, word: bytes) -> int:
        return 0


def phrases(benchmark: DataFrame, size: int = PHRASE_WORDS) -> DataFrame:
    """(phrase, items): the distinct windows of the items, and the ids of the items that hold each."""

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for item, text in zip(frame["item"], frame["text"]):
                words = words_of(text)
                found = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else ()
                out += [(item, p) for p in found]
            yield pd.DataFrame(out, columns=["item", "phrase"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    found = items.mapInPandas(windows, "item string, phrase binary")
    return found.groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))


class PhraseSet:
    """One block of phrases as numbers: vocabulary, phrases padded with 0, lengths, and their items."""

    def __init__(self, rows: list):
        split = [bytes(r.phrase).split() for r in rows]
        self.vocabulary = Numbers((w, i + 1) for i, w in enumerate(sorted({w for p in split for w in p})))
        self.lengths = np.array([len(p) for p in split], np.int64)
        self.numbers = np.zeros((len(split), max(map(len, split), default=1)), np.int64)
        for i, p in enumerate(split):
            self.numbers[i, : len(p)] = [self.vocabulary[w] for w in p]
        self.items = [list(r["items"]) for r in rows]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; zeros are separators, each different from the others, in order of place, below all words."""
    n = len(text)
    cuts = text == 0
    rank = text + int(cuts.sum())
    rank[cuts] = np.arange(cuts.sum())
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if n == 0 or new[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = new[step:] + 1
        rank = new * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one row of bits per binary digit, with counts of ones before every place."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.ones, self.zeros = [], []
        for digit in reversed(range(digits)):
            bits = (symbols >> digit) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bits, dtype=np.int64))))
            self.zeros.append(len(bits) - int(self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        self.digits = digits

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low, high = np.zeros_like(places), places.copy()
        for level, digit in enumerate(reversed(range(self.digits))):
            one = ((symbols >> digit) & 1).astype(bool)
            ones = self.ones[level]
            low1, high1 = ones[low], ones[high]
            low = np.where(one, self.zeros[level] + low1, low - low1)
            high = np.where(one, self.zeros[level] + high1, high - high1)
        return high - low


class FMIndex:
    """Index of a shard's text of word numbers, with 0 after every stretch."""

    def __init__(self, text: np.ndarray, vocabulary: int):
        order = suffix_array(text)
        self.last = text[order - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=vocabulary + 1))))
        self.ranks = WaveletMatrix(self.last, max(1, int(vocabulary).bit_length()))
        # A stretch's first suffix is sampled too, so a walk never crosses a separator.
        self.sampled = (order % SAMPLE_EVERY == 0) | (self.last == 0)
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.size = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for back in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - back]
            low[live] = self.below[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.ranks.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to a sampled one."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            at = rows[walking]
            symbol = self.last[at]
            rows[walking] = self.below[symbol] + self.ranks.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.samples[self.sample_rank[rows]] + steps


def search_shard(numbers: np.ndarray, known: PhraseSet) -> tuple[np.ndarray, np.ndarray]:
    """(start in ``numbers``, phrase) of every occurrence; documents in ``numbers`` are parted by 0."""
    inside = np.concatenate(([False], numbers != 0, [False]))
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    long = ends - starts >= known.lengths.min()
    marks = np.zeros(len(numbers) + 2, np.int64)
    marks[starts[long]] += 1
    marks[ends[long] + 1] -= 1  # a stretch keeps the 0 behind it
    places = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = FMIndex(numbers[places], len(known.vocabulary))
    low, high = index.search(known.numbers, known.lengths)
    counts = high - low
    phrase = np.repeat(np.arange(len(counts)), counts)
    rows = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    return places[index.locate(rows)], phrase


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans, as few as possible."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(e))
        else:
            out.append([int(s), int(e)])
    return [(s, e) for s, e in out]


def find_phrases(docs: DataFrame, known: PhraseSet, carry: list[str]) -> DataFrame:
    """Per document: the ``carry`` columns, n_words, the merged spans (first word, word after the last) and the items."""

    def shard_rows(frames: list[pd.DataFrame], numbers: list[np.ndarray]) -> pd.DataFrame:
        out = pd.concat(frames, ignore_index=True)
        sizes = np.array([len(x) for x in numbers], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        zero = np.zeros(1, np.int64)
        whole = np.concatenate([part for x in numbers for part in (x, zero)])
        at, phrase = search_shard(whole, known)
        doc = np.searchsorted(begins, at, "right") - 1
        spans: list[list] = [[] for _ in numbers]
        items: list[list] = [[] for _ in numbers]
        order = np.argsort(doc, kind="stable")
        bounds = np.flatnonzero(np.diff(doc[order], prepend=-1))
        for i, j in zip(bounds, [*bounds[1:], len(order)]):
            own, d = order[i:j], int(doc[order[i]])
            first = at[own] - begins[d]
            spans[d] = [{"first": s, "after": e} for s, e in merge_spans(first, first + known.lengths[phrase[own]])]
            items[d] = sorted({x for p in np.unique(phrase[own]) for x in known.items[p]})
        return out.assign(n_words=sizes, spans=spans, items=items)

    def searched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        numbers: list[np.ndarray] = []
        size = 0
        for frame in frames:
            for at in range(0, len(frame), 1000):
                some = frame.iloc[at : at + 1000]
                for text in some["text"]:
                    words = words_of(text)
                    numbers.append(np.fromiter(map(known.vocabulary.__getitem__, words), np.int64, len(words)))
                    size += len(words)
                held.append(some[carry])
                if size >= SHARD_WORDS:
                    yield shard_rows(held, numbers)
                    held, numbers, size = [], [], 0
        if held:
            yield shard_rows(held, numbers)

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInPandas(
        searched, f"{schema}, n_words long, spans array<struct<first:long,after:long>>, items array<string>"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = PHRASE_WORDS) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items) of every document: where phrases of the benchmark occur in it."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sought = stored(phrases(benchmark, size), "phrases")
    blocks = max(1, -(-sought.count() // BLOCK_PHRASES))
    if blocks == 1:
        return find_phrases(docs, PhraseSet(sought.collect()), ["doc_id", "text_hash"]) if sought.count() else unhit(docs)
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = None
    for block in range(blocks):
        known = PhraseSet(sought.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block).collect())
        if known.items:
            part = find_phrases(docs, known, ["doc_id", "text_hash", "row"])
            found = part if found is None else found.unionAll(part)
    merged = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_hash").alias("text_hash"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spans = [merge_spans([s["first"] for s in x], [s["after"] for s in x]) for x in frame["spans"]]
            yield frame.assign(spans=[[{"first": s, "after": e} for s, e in x] for x in spans])

    merged = merged.drop("row")
    return merged.mapInPandas(joined, merged.schema)


def unhit(docs: DataFrame) -> DataFrame:
    """The result where the benchmark has no phrases."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            none: list[list] = [[] for _ in range(len(frame))]
            words = [len(words_of(t)) for t in frame["text"]]
            yield frame[["doc_id", "text_hash"]].assign(n_words=words, spans=none, items=none)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_words long"
    return docs.mapInPandas(counted, f"{schema}, spans array<struct<first:long,after:long>>, items array<string>")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and without what stands between two of them."""
    places = [m.span() for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text)]
    kept, at = [], 0
    for first, after in spans:
        kept.append(text[at : places[first][0]])
        at = places[after - 1][1]
    return "".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with every phrase of the benchmark cut out of their texts; n_chars, where present, follows."""
    hits = contamination(docs, benchmark).filter(F.size("spans") > 0)
    spans = hits.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    spans = spans.dropDuplicates(["_doc", "_hash"])
    marked = docs.join(spans, (F.col("doc_id").eqNullSafe(F.col("_doc"))) & (F.xxhash64("text") == F.col("_hash")), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        pairs = [None if s is None else [(x["first"], x["after"]) for x in s] for s in spans]
        return pd.Series([t if s is None else cut_words(t, s) for t, s in zip(text, pairs)], dtype=object)

    out = marked.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut("text", "_spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
