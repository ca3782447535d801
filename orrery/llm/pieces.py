"""SentencePiece encoding with a unigram model, and decoding.

The pieces of a model file stand in a double-array trie over their UTF-8 bytes. A text is normalised as the file says
(blanks become the marker, one marker in front), and Viterbi finds the segmentation with the highest sum of log
scores. A character that starts no piece of its own may be left unknown, at a penalty; unknown characters are written
as byte pieces. A merge-ranked file has no log scores: its r-th piece then gets the log of 1 / (r + 1), Zipf's law.

No piece has a marker behind another character, and none has a line feed, so the best segmentation of a text is that of
its stretches between these places; a worker remembers the pieces of the stretches that it has seen.

Decoding writes the pieces one after another, byte pieces as their bytes, markers as blanks, and drops the blank in front.

Defined cases: null and empty texts have no pieces and decode to the empty string; a marker character in a text
comes back as a blank, as the format has it; ids outside the vocabulary decode to nothing; repeated rows each come out;
other columns are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.helpers import WordCache, process_store, spoonfuls

MARKER = "▁"
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4
UNIGRAM = 1
UNKNOWN_PENALTY = 10.0
# Stretches that a worker remembers; the memo outlives the stage, so it is kept well below a worker's share of memory.
MEMO = 150_000
# Stretches that the search walks at once.
LOCKSTEP = 8192


class Trie:
    """Double array: the child of state s by byte b is base[s] + b, if check there names s; value holds the piece that
    ends in a state, or -1."""

    def __init__(self, words: dict[bytes, int]):
        self.base, self.check, self.value = [1], [0], [-1]
        ordered = sorted(words)
        waiting = [(0, 0, len(ordered), 0)]  # state, range of the words below it, depth
        # From here on a base can put every byte into a gap. Single children fill the first gap, families start at the last family.
        free = wide = 257
        while waiting:
            state, low, high, depth = waiting.pop()
            if len(ordered[low]) == depth:
                self.value[state] = words[ordered[low]]
                low += 1
            children: list[tuple[int, int, int]] = []
            while low < high:
                byte, start = ordered[low][depth], low
                while low < high and ordered[low][depth] == byte:
                    low += 1
                children.append((byte, start, low))
            if not children:
                continue
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            base = (free if len(children) == 1 else wide) - children[0][0] if state else 1
            while any(base + b < len(self.check) and self.check[base + b] >= 0 for b, _, _ in children):
                base += 1
            if len(children) > 1 and state:
                wide = base + children[0][0]
            self.base[state] = base
            top = base + children[-1][0] + 1
            if top > len(self.check):
                more = top - len(self.check)
                self.base += [0] * more
                self.check += [-1] * more
                self.value += [-1] * more
            for byte, start, end in children:
                self.check[base + byte] = state
                waiting.append((base + byte, start, end, depth + 1))
        # Look-ups may run past the last state by one byte.
        self.base += [0] * 256
        self.check += [-1] * 256
        self.value += [-1] * 256


class PieceModel:
    """Vocabulary, log scores and trie of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        plan = proto.normalizer_spec
        if plan.precompiled_charsmap or plan.remove_extra_whitespaces or not plan.escape_whitespaces:
            raise ValueError("only models with the identity normalisation are read")
        self.prefix = plan.add_dummy_prefix
        self.unknown_id = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        normal = [i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)]
        if proto.trainer_spec.model_type == UNIGRAM:
            scores = {i: proto.pieces[i].score for i in normal}
        else:
            scores = {i: -math.log(rank + 1) for rank, i in enumerate(normal)}
        self.scores = [scores.get(i, 0.0) for i in range(len(proto.pieces))]
        self.unknown_score = min(scores.values()) - UNKNOWN_PENALTY
        self.trie = Trie({proto.pieces[i].piece.encode(): i for i in normal})
        self.arrays: tuple[np.ndarray, ...] | None = None
        self.surface = [p.piece.replace(MARKER, " ").encode() if p.type in (NORMAL, USER) else b"" for p in proto.pieces]
        for byte, i in self.byte_ids.items():
            self.surface[i] = bytes([byte])
        whole = "".join(proto.pieces[i].piece for i in normal if len(proto.pieces[i].piece) > 1)
        inner = any(MARKER in proto.pieces[i].piece.lstrip(MARKER) for i in normal)
        # Where the best path can be cut: line feeds that no piece holds, and markers behind another character.
        cuts = [] if inner else [f"{MARKER}+[^{MARKER}\n]*", f"[^{MARKER}\n]+"]
        self.stretch = re.compile("|".join(["\n", *cuts]) if "\n" not in whole and not inner else "(?s).+")

    def stretches(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", MARKER)
        return self.stretch.findall(MARKER + text if self.prefix else text)

    def tables(self) -> tuple[np.ndarray, ...]:
        """The trie and the scores as arrays (base, check, value, score), for ``viterbi``."""
        if self.arrays is None:
            trie = [np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)]
            self.arrays = (*trie, np.array(self.scores))
        return self.arrays

    def viterbi(self, stretches: list[str]) -> Iterator[bytes]:
        """Ids of the best segmentation of each stretch; of equals, the one that was found first, from the left.

        Stretches of similar length go forward together: the search stands at the same byte of all of them.
        """
        data = [s.encode("utf-8", "replace") for s in stretches]
        order = sorted(range(len(data)), key=lambda i: len(data[i]))
        found: list[bytes] = [b""] * len(data)
        at = 0
        while at < len(order):
            # At most some 2^20 bytes a time, padding included: the last of a run is its longest.
            high = min(at + LOCKSTEP, len(order))
            while high > at + 1 and (high - at) * (len(data[order[high - 1]]) + 1) > 1 << 20:
                high = at + (high - at) // 2
            some = order[at:high]
            for i, ids in zip(some, self.best_paths([data[i] for i in some])):
                found[i] = ids
            at = high
        yield from found

    def best_paths(self, data: list[bytes]) -> Iterator[bytes]:
        base, check, value, score = self.tables()
        sizes = np.array([len(d) for d in data])
        longest = int(sizes.max(initial=0))
        # A row per place: byte, best score up to there, start of the last piece and its id. Bytes behind the end are -1.
        byte = np.full((longest + 1, len(data)), -1, np.int32)
        column = np.repeat(np.arange(len(data)), sizes)
        byte[np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes), column] = np.frombuffer(b"".join(data), np.uint8)
        best = np.full((longest + 1, len(data)), -np.inf)
        best[0] = 0.0
        start, last = np.zeros((longest + 1, len(data)), np.int32), np.zeros((longest + 1, len(data)), np.int32)
        for at in range(longest):
            # A character starts here: not a byte of the form 10xxxxxx.
            lead = byte[at]
            live = np.flatnonzero((lead >= 0) & (lead & 0xC0 != 0x80))
            lead = lead[live]
            width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            single = np.zeros(len(live), bool)
            row, walk, state = np.arange(len(live)), live, np.zeros(len(live), np.int32)
            end = at
            while len(walk):
                step = base[state] + byte[end, walk]
                going = (byte[end, walk] >= 0) & (step != 0)
                going[going] = check[step[going]] == state[going]
                row, walk, state = row[going], walk[going], step[going]
                end += 1
                piece = value[state]
                ends = piece >= 0
                if ends.any():
                    to, ids = walk[ends], piece[ends]
                    reached = best[at, to] + score[ids]
                    better = reached > best[end, to]
                    best[end, to[better]], start[end, to[better]], last[end, to[better]] = reached[better], at, ids[better]
                    single[row[ends]] |= width[row[ends]] == end - at
                if end > longest - 1:
                    break
            for own in range(1, 5):
                to = live[~single & (width == own)]
                if len(to):
                    reached = best[at, to] + self.unknown_score
                    better = to[reached > best[at + own, to]]
                    best[at + own, better] = best[at, better] + self.unknown_score
                    start[at + own, better], last[at + own, better] = at, self.unknown_id
        # Back from the ends, one piece of every stretch at a time.
        walk, end = np.flatnonzero(sizes), sizes[sizes > 0]
        owners, ids, spans = [], [], []
        while len(walk):
            before = start[end, walk]
            owners.append(walk)
            ids.append(last[end, walk])
            spans.append((before, end))
            on = before > 0
            walk, end = walk[on], before[on]
        if not owners:
            yield from [b""] * len(data)
            return
        owner, piece = np.concatenate(owners[::-1]), np.concatenate(ids[::-1])
        order = np.argsort(owner, kind="stable")
        owner, piece = owner[order], piece[order].astype("<u4")
        cuts = np.searchsorted(owner, np.arange(len(data) + 1)).tolist()
        unknown = np.zeros(len(data), bool)
        if self.byte_ids:
            unknown[owner[piece == self.unknown_id]] = True
            low = np.concatenate([x for x, _ in spans[::-1]])[order]
            high = np.concatenate([x for _, x in spans[::-1]])[order]
        for i, (a, b, odd) in enumerate(zip(cuts, cuts[1:], unknown.tolist())):
            if not odd:
                yield piece[a:b].tobytes()
                continue
            parts = [
                [self.byte_ids[x] for x in data[i][f:t]] if p == self.unknown_id else [p]
                for p, f, t in zip(piece[a:b].tolist(), low[a:b].tolist(), high[a:b].tolist())
            ]
            yield array("I", chain.from_iterable(parts)).tobytes()


def model_at(path: str) -> PieceModel:
    loaded = process_store("piece models")
    if path not in loaded:
        loaded[path] = PieceModel(path)
    return loaded[path]


def encode_texts(texts: Iterable[str | None], path: str) -> Iterator[bytes]:
    """Ids of each text as unsigned 32-bit little-endian integers."""
    model = model_at(path)
    cache = WordCache(f"pieces {path}", model.viterbi, MEMO)
    for some in spoonfuls(texts):
        split = [model.stretches(t) for t in some]
        known = cache.learn(chain.from_iterable(split)).__getitem__
        yield from [b"".join(map(known, s)) for s in split]


def decode_ids(ids: bytes, model: PieceModel) -> str:
    numbers = np.frombuffer(ids, "<u4")
    numbers = numbers[numbers < len(model.surface)].tolist()
    text = b"".join(map(model.surface.__getitem__, numbers)).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


def encoded(text: Column, path: str) -> Column:
    """Binary column of the ids of a text column."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode_texts(texts, path)), dtype=object)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of a binary column of ids."""

    @F.pandas_udf("string")
    def decode(some: pd.Series) -> pd.Series:
        model = model_at(path)
        return pd.Series([decode_ids(i or b"", model) for i in some], dtype=object)

    return decode(ids)


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """The documents with ids (binary), n_pieces, n_bytes (byte pieces among them) and decoded (columns of these names
    are replaced)."""

    @F.pandas_udf("ids binary, n_pieces long, n_bytes long, decoded string")
    def both(texts: pd.Series) -> pd.DataFrame:
        model = model_at(path)
        is_byte = np.zeros(len(model.surface), bool)
        is_byte[list(model.byte_ids.values())] = True
        ids = list(encode_texts(texts, path))
        return pd.DataFrame(
            {
                "ids": ids,
                "n_pieces": [len(i) // 4 for i in ids],
                "n_bytes": [int(is_byte[np.frombuffer(i, "<u4")].sum()) for i in ids],
                "decoded": [decode_ids(i, model) for i in ids],
            }
        )

    out = docs.withColumn("_both", both("text"))
    return out.withColumns({c: F.col(f"_both.{c}") for c in ("ids", "n_pieces", "n_bytes", "decoded")}).drop("_both")
