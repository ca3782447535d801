"""Alignment of two tokenizers over the same bytes, on Arrow arrays.

A text behind a blank is encoded by a byte-level vocabulary (A) and by a piece model (B). Inside a task, token lists of many
documents are flattened next to the indices of their documents; sums of token lengths, cumulated per document, give the
byte where each token ends; a hash join on (document, end) links the A token and the B token that end together. As no
token is empty, an end has at most one token of each side, so every link closes one group of tokens.

Links are coded against a dictionary of id pairs per block of texts, commonest first, with the block's partial counts. Spark
adds the partial counts up, finds the highest of every B id, and sends each block the figures of its own pairs: a pair
occurs once per block, so no pair is hot, however common. Blocks are bounded by characters; rows of documents stay small.

Words (A) and stretches between blanks (B) are encoded once per worker and remembered. Both are cut where neither
tokenizer can join: A's own pre-tokenizer cuts words, and no piece of B holds a blank behind another character.

Defined cases: null and empty texts, and texts that one side does not give back byte for byte (as with U+2581, which B reads as a
blank), have no tokens: zeros and an empty digest. A null doc_id is kept; repeated rows each come out and each count; other
columns are ignored; an empty table gives an empty one; a longer text than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.helpers import WordCache, process_store, stored

MARKER = "▁"
SPOON_CHARS, BLOCK_CHARS = 1_000_000, 12_000_000
MEMO = 300_000
# Characters for which the cutting pattern means the same in every Unicode version and library.
PLAIN = re.compile("[^\t-\r -~\xa0-ɏ]")
CODED = """block long, kind int, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string,
    codes binary, pairs array<long>, counts array<long>"""
FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: cuts a text, encodes the cuts, and knows the bytes of every token."""

    def __init__(self, name: str, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = pa.array([len(t) for t in tokens], pa.int64())
        self.decimals = pa.array([str(i) for i in range(len(tokens))], pa.large_string())
        self.memo = WordCache(name, self.encode, MEMO)
        # Cuts whose tokens don't give their bytes back.
        self.odd: set[str] = set()

    def encode(self, cuts: list[str]) -> Iterator[bytes]:
        for cut, ids in zip(cuts, self.ids_of(cuts)):
            if b"".join(map(self.tokens.__getitem__, ids)) != cut.encode():
                self.odd.add(cut)
            yield array("i", ids).tobytes()

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of every text (each starts with a blank), and whether their bytes are those of the text."""
        cuts = [self.cut(t) for t in texts]
        known = self.memo.learn(c for some in cuts for c in some)
        ids = [np.frombuffer(b"".join(map(known.__getitem__, some)), "<i4") for some in cuts]
        whole = [
            self.odd.isdisjoint(some) or b"".join(map(self.tokens.__getitem__, i)) == t.encode()
            for t, some, i in zip(texts, cuts, ids)
        ]
        return ids, whole


class ByteSide(Side):
    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.words = regex.compile(pattern)
        byte, vocabulary = byte_characters(), self.model.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(map(byte.__getitem__, token))
        super().__init__("alignment bytes", tokens)

    def cut(self, text: str) -> list[str]:
        if PLAIN.search(text) is None:
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in self.model.pre_tokenizer.pre_tokenize_str(text)]

    def ids_of(self, cuts: list[str]) -> Iterable[list[int]]:
        return (e.ids for e in self.model.encode_batch(cuts, add_special_tokens=False))


class PieceSide(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError("only models whose pieces hold blanks in front alone can be cut at blanks")
        self.blank = [self.model.piece_to_id(MARKER)]
        self.stretches = re.compile(" +[^ ]*")
        super().__init__(
            "alignment pieces",
            [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARKER, " ").encode() for i, p in enumerate(pieces)],
        )

    def cut(self, text: str) -> list[str]:
        return self.stretches.findall(text.replace(MARKER, " "))

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        ids, whole = super().encoded(texts)
        return ids, [w and MARKER not in t for w, t in zip(whole, texts)]

    def ids_of(self, cuts: list[str]) -> Iterable[list[int]]:
        # The model puts a blank in front of what it gets, except of nothing.
        return (ids or self.blank for ids in self.model.encode([c[1:] for c in cuts], num_threads=1))


def sides(path_a: str, pattern: str, path_b: str) -> tuple[Side, Side]:
    """Both tokenizers, loaded once per worker."""
    known = process_store("alignment sides")
    if (path_a, path_b) not in known:
        known[path_a, path_b] = (ByteSide(path_a, pattern), PieceSide(path_b))
    return known[path_a, path_b]


def lists_of(rows: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))
    return pa.LargeListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *rows]))


def token_table(lists: pa.LargeListArray, sizes: pa.Array, side: str) -> pa.Table:
    """(doc, end, place, id): for every token its document, the byte where it ends in it, its place and its id."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    upto = pc.cumulative_sum(pc.take(sizes, ids))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), upto]), lists.offsets)
    end = pc.subtract(upto, pc.take(before, doc))
    return pa.table({"doc": doc, "end": end, f"{side}_place": pa.array(np.arange(len(ids))), side: ids})


def group_texts(lists: pa.LargeListArray, last: np.ndarray, decimals: pa.Array) -> pa.Array:
    """Ids of every group, comma-joined; ``last`` holds the place of each group's last token, ascending."""
    offsets = np.concatenate(([0], last + 1))
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.take(decimals, pc.list_flatten(lists))), pa.scalar(",", pa.large_string()))


def aligned(texts: list[str], a: Side, b: Side) -> tuple[pa.Table, pa.Array, list[str]]:
    """Tokens and links per text (n_a, n_b, n_links), the id pair (a << 32 | b) of every link in order, and the digests."""
    spaced = [f" {t}" if t else "" for t in texts]
    (ids_a, whole_a), (ids_b, whole_b) = a.encoded(spaced), b.encoded(spaced)
    none = np.zeros(0, np.int32)
    usable = [x and y for x, y in zip(whole_a, whole_b)]
    lists_a = lists_of([i if u else none for i, u in zip(ids_a, usable)])
    lists_b = lists_of([i if u else none for i, u in zip(ids_b, usable)])
    links = token_table(lists_a, a.sizes, "a").join(token_table(lists_b, b.sizes, "b"), ["doc", "end"], join_type="inner", use_threads=False)
    links = links.sort_by("a_place")
    n_links = np.bincount(links["doc"].to_numpy(), minlength=len(texts))
    # Both sides of a text end together, so the groups cover all tokens.
    groups = pc.binary_join_element_wise(
        group_texts(lists_a, links["a_place"].to_numpy(), a.decimals), group_texts(lists_b, links["b_place"].to_numpy(), b.decimals), pa.scalar("|", pa.large_string())
    )
    of_text = pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(n_links))), groups), pa.scalar(";", pa.large_string()))
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in of_text.to_pylist()]
    pairs = pc.bit_wise_or(pc.shift_left(links["a"].cast(pa.int64()), 32), links["b"].cast(pa.int64())).combine_chunks()
    sizes = pa.table({"n_a": pc.list_value_length(lists_a), "n_b": pc.list_value_length(lists_b), "n_links": pa.array(n_links)})
    return sizes, pairs, digests


def code_width(n_pairs: int) -> int:
    """Bytes of a code in a block with so many pairs."""
    return 2 if n_pairs <= 1 << 16 else 4


def block_rows(number: int, doc_ids: list, sizes: list[pa.Table], pairs: list[pa.Array], digests: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a block: its dictionary of pairs with their counts, then its documents with coded links."""
    links = pa.chunked_array(pairs, pa.int64())
    counted = pa.table({"pair": links}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    counted = counted.sort_by([("count_all", "descending"), ("pair", "ascending")])
    table = pa.concat_tables(sizes)
    schema = pa.schema(
        [("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()),
         ("groups_sha256", pa.string()), ("codes", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
    )
    figures = {"pairs": [counted["pair"].to_pylist()], "counts": [counted["count_all"].to_pylist()]}
    yield pa.record_batch([pa.array([number] if f == "block" else [0] if f == "kind" else figures.get(f, [None]), schema.field(f).type) for f in schema.names], schema)
    width = code_width(len(counted))
    codes = pc.index_in(links, value_set=counted["pair"].combine_chunks()).combine_chunks().to_numpy(zero_copy_only=False)
    ends = np.cumsum(table["n_links"].to_numpy()) * width
    data = codes.astype(f"<u{width}").tobytes()
    held = {
        "block": pa.array([number] * len(doc_ids), pa.int64()),
        "kind": pa.array([1] * len(doc_ids), pa.int32()),
        "doc_id": pa.array(doc_ids, pa.int64()),
        "groups_sha256": pa.array(digests, pa.string()),
        "codes": pa.array([data[e - width * n : e] for e, n in zip(ends.tolist(), table["n_links"].to_pylist())], pa.binary()),
    } | {c: table[c].cast(pa.int64()).combine_chunks() for c in table.column_names}
    full = pa.record_batch([held.get(f, pa.nulls(len(doc_ids), schema.field(f).type)) for f in schema.names], schema)
    for at in range(0, len(doc_ids), 256):
        yield full.slice(at, 256)


def coded_links(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """Blocks of documents as ``CODED`` rows: kind 0 is a block's dictionary, kind 1 a document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, pattern, path_b)
        first = TaskContext.get().partitionId() << 32
        n_blocks, chars = 0, 0
        held: tuple[list, list, list, list] = ([], [], [], [])

        def spoon(ids: list, texts: list[str]) -> None:
            sizes, pairs, digests = aligned(texts, a, b)
            for store, new in zip(held, (ids, [sizes], [pairs], digests)):
                store.extend(new)

        ids, texts, spooned = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc_id)
                texts.append(text or "")
                spooned += len(texts[-1])
                if spooned >= SPOON_CHARS:
                    spoon(ids, texts)
                    chars += spooned
                    ids, texts, spooned = [], [], 0
                    if chars >= BLOCK_CHARS:
                        yield from block_rows(first + n_blocks, *held)
                        held = ([], [], [], [])
                        n_blocks, chars = n_blocks + 1, 0
        if ids:
            spoon(ids, texts)
        if held[0]:
            yield from block_rows(first + n_blocks, *held)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, CODED)


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """One row of ``FOUND`` per document."""
    coded = stored(coded_links(docs, path_a, pattern, path_b), "coded-links")
    listed = coded.filter("kind = 0").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("code", "_p"))
    listed = listed.select("block", "code", F.col("_p.pairs").alias("pair"), F.col("_p.counts").alias("n"))
    counts = stored(listed.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(b_id.alias("_b")).agg(F.max("total").alias("_most"))
    graded = counts.join(highest, b_id == F.col("_b")).select("pair", "total", (F.col("total") == F.col("_most")).alias("best"))
    answers = listed.select("block", "code", "pair").join(graded, "pair").groupBy("block").agg(
        F.collect_list(F.struct("code", "total", "best")).alias("_a")
    )
    answers = answers.select("block", *[F.col(f"_a.{c}").alias(f"_{c}") for c in ("code", "total", "best")])
    rows = coded.filter("kind = 1").drop("pairs", "counts").unionByName(answers.withColumn("kind", F.lit(0)), allowMissingColumns=True)

    def graded_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = best = np.zeros(0, np.int64)
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.kind == 0:
                    code = np.asarray(r[-3])
                    total, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
                    total[code], best[code] = r[-2], r[-1]
                    continue
                codes = np.frombuffer(r.codes, f"<u{code_width(len(total))}")
                out.append((r.doc_id, r.n_a, r.n_b, r.n_links, r.n_links, int(best[codes].sum()), int(total[codes].sum()), r.groups_sha256))
            found = pd.DataFrame(out, columns=[f.split()[0] for f in FOUND.split(", ")])
            yield found.astype({c: "Int64" for c in found.columns[:-1]})

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInPandas(graded_rows, FOUND)
