"""Token files: ids per document, compressed one by one with a shared dictionary, in shard files with an offset index.

A shard file holds the compressed documents back to back, then an index (doc_id, offset, length, number of ids), then a
fixed footer with the hash of the dictionary. One document is read with the index and one small decompression. The
dictionary lies beside the shards under its hash; a reader refuses shards that were written with another one.

Defined cases: a null or empty text has no ids but the end id; a null doc_id comes first and is kept as null; rows that
repeat a doc_id are all kept, ordered by a hash of their text; other columns are ignored; an empty table gives a
store without shards.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.helpers import WordCache, partitions_for, process_store, smallest_draws, spoonfuls

MAGIC = b"ORTOK001"
FOOTER = "<8sQQQI"  # magic, dictionary hash, start of the index, documents, bytes per id
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("length", "<u8"), ("ids", "<u8")])

# A shard is closed when its compressed documents reach this size.
SHARD_BYTES = 8 << 20
# Words that a worker remembers.
WORDS_KEPT = 1_200_000
# The dictionary is trained on at most this many documents (those with the smallest hashes), each with at most this many ids.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 1024, 4096, 64 << 10


def word_encoder(tokenizer_path: str):
    """Texts to ids, as little-endian bytes, by the tokenizers library, with a memo per word.

    The tokenizer drops white space and no rule of it looks across a space, so the ids of a text are the ids of its
    space-separated words in turn; each distinct word is encoded once and remembered by the worker.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    loaded = process_store("tokenizers")
    if tokenizer_path not in loaded:
        from tokenizers import Tokenizer

        loaded[tokenizer_path] = Tokenizer.from_file(tokenizer_path)
    tokenizer = loaded[tokenizer_path]

    def encoded(pieces: list[str]) -> list[bytes]:
        plain = [p for p in pieces if is_plain(p)]
        found = {p: array("I", [t.id for t in tokenizer.model.tokenize(byte_symbols(p))]).tobytes() for p in plain}
        other = [p for p in pieces if p not in found]
        for at in range(0, len(other), 5000):
            batch = tokenizer.encode_batch_fast(other[at : at + 5000], add_special_tokens=False)
            found.update((p, array("I", e.ids).tobytes()) for p, e in zip(other[at : at + 5000], batch))
        return [found[p] for p in pieces]

    cores = WordCache(f"core ids {tokenizer_path}", encoded)

    def many(words: list[str]) -> list[bytes]:
        parts = [core_and_tail(w) for w in words]
        known = cores.learn([x for p in parts for x in p])
        return [known[core] + known[tail] for core, tail in parts]

    cache = WordCache(f"ids {tokenizer_path}", many, WORDS_KEPT)

    def encode(texts: Iterable[str | None]) -> Iterator[bytes]:
        for some in spoonfuls(texts, 1_000_000):
            split = [lowered(t).replace("\n", " ").split(" ") for t in some]
            known = cache.learn(chain.from_iterable(split)).__getitem__
            yield from [b"".join(map(known, words)) for words in split]

    return encode


def lowered(text: str) -> str:
    """The text in lower case, where that is certain to be what the tokenizer makes of it; else as it is."""
    if "<|" in text or "Σ" in text:
        return text
    low = text.lower()
    return low if text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low) else text


def core_and_tail(word: str) -> tuple[str, str]:
    """A word of letters in lower case and the punctuation behind it, which the tokenizer parts as well; others as they are."""
    core = word.rstrip(".,;:!?|")
    if not core.isalpha():
        return word, ""
    if core.isascii():
        return core.lower(), word[len(core) :]
    if is_plain(core):
        return core, word[len(core) :]
    low = "".join([c.lower() for c in core])
    return low if is_plain(low) else core, word[len(core) :]


def is_plain(word: str) -> bool:
    """Lower-case Latin letters, composed: the tokenizer's rules for text leave such a word as it is."""
    return word.isalpha() and word.islower() and (word.isascii() or (max(word) < "\u0250" and is_normalized("NFC", word)))


# Byte-level vocabularies write a byte as a printable character: itself, or the next one from U+0100 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def byte_symbols(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(SYMBOLS)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int) -> bytes:
    """Dictionary from the id arrays of a bounded sample; empty where the sample is too small to train on."""
    drawn = docs.select("text", F.xxhash64(F.col("doc_id"), F.lit(7)).alias("_draw"))
    sample = smallest_draws(drawn, "_draw", SAMPLE_DOCS).filter(F.length("text") > 0).orderBy("_draw").limit(SAMPLE_DOCS).select("text")

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_encoder(tokenizer_path)
        for frame in frames:
            yield pd.DataFrame({"ids": [ids[: 4 * SAMPLE_IDS] for ids in encode(frame["text"])]})

    arrays = [bytes(r.ids) for r in sample.mapInPandas(encoded, "ids binary").collect()]
    arrays = [packed(a + struct.pack("<I", end_id), id_bytes(tokenizer_path, end_id)) for a in arrays]
    if sum(map(len, arrays)) < 8 * DICT_BYTES or len(arrays) < 64:
        return b""
    return zstandard.train_dictionary(DICT_BYTES, arrays, level=3).as_bytes()


def id_bytes(tokenizer_path: str, end_id: int) -> int:
    """Bytes per stored id: 2 while every id of the vocabulary fits, else 4."""
    loaded = process_store("tokenizers")
    if tokenizer_path not in loaded:
        from tokenizers import Tokenizer

        loaded[tokenizer_path] = Tokenizer.from_file(tokenizer_path)
    return 2 if max(loaded[tokenizer_path].get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4


def packed(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def unpacked(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def close_shard(frames: list[bytes], index: list[tuple], hashed: int, width: int) -> bytes:
    body = b"".join(frames)
    return body + np.array(index, INDEX).tobytes() + struct.pack(FOOTER, MAGIC, hashed, len(body), len(index), width)


def shard_index(content: bytes) -> tuple[np.ndarray, int, int]:
    """Index, dictionary hash and bytes per id of a shard file (the writer ends a file with a line feed)."""
    end = len(content) - 1
    magic, hashed, at, n, width = struct.unpack(FOOTER, content[end - struct.calcsize(FOOTER) : end])
    if magic != MAGIC:
        raise ValueError("not a token shard")
    return np.frombuffer(content, INDEX, n, at), hashed, width


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Write the documents' ids, in ascending doc_id order, as shards below ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    trained = train_dictionary(rows, tokenizer_path, end_id)
    hashed = xxhash.xxh64_intdigest(trained)
    width = id_bytes(tokenizer_path, end_id)
    spark.createDataFrame([(f"{hashed:016x}", bytearray(trained))], "hash string, dictionary binary").write.parquet(
        f"{path}/dictionary"
    )
    ordered = (
        rows.withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(partitions_for(rows), F.col("doc_id").asc_nulls_first(), "_tie")
        .withColumn("_part", F.spark_partition_id())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie", "text")
    )

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_encoder(tokenizer_path)
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        end = struct.pack("<I", end_id)
        frames: list[bytes] = []
        index: list[tuple] = []
        size = number = part = 0
        for batch in batches:
            for doc_id, part, ids in zip(batch["doc_id"], batch["_part"], encode(batch["text"])):
                ids += end
                frame = press.compress(packed(ids, width))
                has = not pd.isna(doc_id)
                index.append((int(doc_id) if has else 0, has, size, len(frame), len(ids) // 4))
                frames.append(frame)
                size += len(frame)
                if size >= SHARD_BYTES:
                    yield pd.DataFrame({"part": [part], "shard": [number], "data": [close_shard(frames, index, hashed, width)]})
                    frames, index, size, number = [], [], 0, number + 1
        if frames:
            yield pd.DataFrame({"part": [part], "shard": [number], "data": [close_shard(frames, index, hashed, width)]})

    made = ordered.mapInPandas(shards, "part int, shard int, data binary")
    # The text writer copies a string's bytes as they are: one row is one file, closed by a line feed.
    made.select("part", "shard", F.col("data").cast("string").alias("value")).write.partitionBy("part", "shard").text(f"{path}/shards")


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
    number = lambda name: F.regexp_extract("path", f"/{name}=([0-9]+)/", 1).cast("int").alias(name)
    return files.load(f"{path}/shards").select(number("part"), number("shard"), "content")


def read_dictionary(spark: SparkSession, path: str) -> tuple[int, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return int(row.hash, 16), bytes(row.dictionary)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, doc_id, first, n_tokens, ids): ``first`` counts the ids before the document in its shard, ``ids``
    are unsigned 32-bit little-endian integers."""
    hashed, trained = read_dictionary(spark, path)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for batch in batches:
            for part, shard, content in zip(batch["part"], batch["shard"], batch["content"]):
                index, written, width = shard_index(content)
                if written != hashed:
                    raise ValueError("the shard was written with another dictionary")
                first = np.cumsum(index["ids"]) - index["ids"]
                for at in range(0, len(index), 500):
                    some = index[at : at + 500]
                    yield pd.DataFrame(
                        {
                            "part": part,
                            "shard": shard,
                            "doc_id": pd.array(
                                [int(d) if h else None for d, h in zip(some["doc_id"], some["has_id"])], dtype="Int64"
                            ),
                            "first": first[at : at + 500].astype(np.int64),
                            "n_tokens": some["ids"].astype(np.int64),
                            "ids": [
                                unpacked(press.decompress(content[o : o + n]), width)
                                for o, n in zip(some["offset"].tolist(), some["length"].tolist())
                            ],
                        }
                    )

    files = shard_files(spark, path)
    return files.mapInPandas(documents, "part int, shard int, doc_id long, first long, n_tokens long, ids binary")


def fetch_documents(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of the asked documents only: the index leads to their bytes, nothing else is decompressed."""
    hashed, trained = read_dictionary(spark, path)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                index, written, width = shard_index(content)
                if written != hashed:
                    raise ValueError("the shard was written with another dictionary")
                known = index[index["has_id"] == 1]
                for at in range(0, len(known), 500):
                    some = known[at : at + 500]
                    yield pd.DataFrame(
                        {
                            "doc_id": some["doc_id"].astype(np.int64),
                            "width": width,
                            "frame": [content[o : o + n] for o, n in zip(some["offset"].tolist(), some["length"].tolist())],
                        }
                    )

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for batch in batches:
            ids = [unpacked(press.decompress(f), w) for f, w in zip(batch["frame"], batch["width"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    asked = doc_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    found = shard_files(spark, path).mapInPandas(entries, "doc_id long, width int, frame binary").join(asked, "doc_id", "left_semi")
    return found.mapInPandas(opened, "doc_id long, ids binary")


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before: offsets of the parts, then of the shards in a part, then in the shard."""
    shards = tokens.groupBy("part", "shard").agg(F.sum("n_tokens").alias("_ids"))
    parts = shards.groupBy("part").agg(F.sum("_ids").alias("_part_ids"))
    earlier_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier_shards = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        shards.join(parts.select("part", F.coalesce(F.sum("_part_ids").over(earlier_parts), F.lit(0)).alias("_before")), "part")
        .withColumn("_before", F.col("_before") + F.coalesce(F.sum("_ids").over(earlier_shards), F.lit(0)))
        .drop("_ids")
    )
    return tokens.join(offsets, ["part", "shard"]).withColumn("start", F.col("_before") + F.col("first")).drop("_before", "first")
