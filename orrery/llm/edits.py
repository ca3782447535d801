"""Token counts that follow edits.

A text is cut before every blank or line feed that follows a character other than white space. The tokenizer's own
cuts (its pre-tokens) never reach across such a place, so the count of a text is the sum over its segments. A segment
tree per document keeps characters and tokens of leaves of ``LEAF`` segments and their sums. An edit is found by
descent over the character sums; the segments that it touches and one on either side are cut and counted again, and
the sums above the leaves that changed are set anew. Nothing else of the document is encoded again.

Edits of a document apply one after another, each to the text that the one before left: ``remove`` characters from
``at`` on are replaced by ``insert``. Places beyond the text mean its end.

Defined cases: a null text is empty, a null list of edits or a null edit does nothing, null parts of an edit are 0 or
empty, negative numbers count as 0; repeated rows each come out; other columns are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.helpers import WordCache, process_store, spoonfuls

LEAF = 32
# Segments that a worker remembers.
MEMO = 300_000
SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
EDITS = "array<struct<at:long,remove:long,insert:string>>"


def encoding_at(path: str, pattern: str):
    """The tokenizer of a rank file."""
    loaded = process_store("rank files")
    if path not in loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        loaded[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return loaded[path]


def token_counter(path: str, pattern: str) -> WordCache:
    """Memo of the number of tokens of a segment."""
    encoding = encoding_at(path, pattern)
    return WordCache(f"counts {path}", lambda some: [len(encoding.encode_ordinary(s)) for s in some], MEMO)


class CountTree:
    """Segment tree over the segments of one text. Node 1 is the root, node n has the children 2n and 2n + 1."""

    def __init__(self, segments: list[str], counter: WordCache):
        self.counter = counter
        self.leaves = [segments[i : i + LEAF] for i in range(0, len(segments), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        known = counter.learn(segments).__getitem__
        self.counts = [list(map(known, leaf)) for leaf in self.leaves]
        for i, leaf in enumerate(self.leaves):
            self.chars[self.width + i] = sum(map(len, leaf))
            self.tokens[self.width + i] = sum(self.counts[i])
        for node in range(self.width - 1, 0, -1):
            self._sum(node)
        self.recounted = 0

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(chain.from_iterable(self.leaves))

    def find(self, at: int) -> tuple[int, int, int]:
        """Leaf and segment that hold the character at a place (the last ones for the end), and the segment's start."""
        node, left = 1, at
        while node < self.width:
            node *= 2
            if left >= self.chars[node] and self.chars[node + 1]:
                left -= self.chars[node]
                node += 1
        leaf = node - self.width
        start = at - left
        for i, segment in enumerate(self.leaves[leaf]):
            if left < len(segment):
                return leaf, i, start
            left -= len(segment)
            start += len(segment)
        return leaf, max(0, len(self.leaves[leaf]) - 1), start - (len(self.leaves[leaf][-1]) if self.leaves[leaf] else 0)

    def beside(self, leaf: int, segment: int, step: int) -> tuple[int, int]:
        """The neighbouring segment, over empty leaves; the same one at the end of the text."""
        if 0 <= segment + step < len(self.leaves[leaf]):
            return leaf, segment + step
        other = leaf + step
        while 0 <= other < len(self.leaves) and not self.leaves[other]:
            other += step
        if not 0 <= other < len(self.leaves):
            return leaf, segment
        return other, 0 if step > 0 else len(self.leaves[other]) - 1

    def edit(self, at: int, remove: int, insert: str) -> None:
        at = min(max(at, 0), self.chars[1])
        end = min(at + max(remove, 0), self.chars[1])
        first, last = self.find(at), self.find(max(at, end - 1))
        a_leaf, a = self.beside(*first[:2], -1)
        b_leaf, b = self.beside(*last[:2], 1)
        start = first[2] - (len(self.leaves[a_leaf][a]) if (a_leaf, a) != first[:2] else 0)
        if a_leaf == b_leaf:
            region = self.leaves[a_leaf][a : b + 1]
        else:
            region = self.leaves[a_leaf][a:]
            for leaf in range(a_leaf + 1, b_leaf):
                region += self.leaves[leaf]
            region += self.leaves[b_leaf][: b + 1]
        old = "".join(region)
        new = SEGMENT.findall(old[: at - start] + insert + old[end - start :])
        known = self.counter.learn(new)
        self.recounted += len(new)
        for lists, fresh in ((self.leaves, new), (self.counts, [known[s] for s in new])):
            if a_leaf == b_leaf:
                lists[a_leaf][a : b + 1] = fresh
            else:
                lists[a_leaf][a:] = fresh
                for leaf in range(a_leaf + 1, b_leaf):
                    lists[leaf] = []
                lists[b_leaf] = lists[b_leaf][b + 1 :]
        nodes = set()
        for leaf in range(a_leaf, b_leaf + 1):
            self.chars[self.width + leaf] = sum(map(len, self.leaves[leaf]))
            self.tokens[self.width + leaf] = sum(self.counts[leaf])
            nodes.add((self.width + leaf) // 2)
        while nodes and max(nodes):
            for node in nodes:
                self._sum(node)
            nodes = {node // 2 for node in nodes if node > 1}


def trees(texts: Iterable[str | None], counter: WordCache) -> Iterator[CountTree]:
    for some in spoonfuls(texts):
        split = [SEGMENT.findall(t) for t in some]
        counter.learn(chain.from_iterable(split))
        for segments in split:
            yield CountTree(segments, counter)


def count_edited(docs: DataFrame, edits: Column, path: str, pattern: str) -> DataFrame:
    """The documents with n_tokens, n_after (tokens after all edits), n_segments, n_recounted (segments counted again) and
    edited (the text after the edits); columns of these names are replaced."""

    @F.pandas_udf("n_tokens long, n_after long, n_segments long, n_recounted long, edited string")
    def counted(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for tree, wanted in zip(trees(texts, token_counter(path, pattern)), lists):
            before, segments = tree.total(), sum(map(len, tree.leaves))
            for e in wanted if wanted is not None else ():
                if e is not None:
                    tree.edit(*[0 if e[k] is None else int(e[k]) for k in ("at", "remove")], e["insert"] or "")
            out.append((before, tree.total(), segments, tree.recounted, tree.text()))
        return pd.DataFrame(out, columns=["n_tokens", "n_after", "n_segments", "n_recounted", "edited"])

    out = docs.withColumn("_counted", counted("text", edits.cast(EDITS)))
    names = ["n_tokens", "n_after", "n_segments", "n_recounted", "edited"]
    return out.withColumns({c: F.col(f"_counted.{c}") for c in names}).drop("_counted")


def apply_edits(docs: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``count_edited``, with the edits from a table (doc_id, seq, at, remove, insert), applied in the order of seq."""
    one = F.struct("seq", "at", "remove", "insert")
    lists = edits.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_list(one)).alias("_edits"))
    met = docs.join(lists, F.col("doc_id") == F.col("_doc"), "left")
    pure = F.transform("_edits", lambda e: F.struct(e["at"].alias("at"), e["remove"].alias("remove"), e["insert"].alias("insert")))
    return count_edited(met, pure, path, pattern).drop("_doc", "_edits")


def drawn_edits(key: Column, text: Column, number: int) -> Column:
    """Edits drawn from a hash of the key: short cuts, and insertions copied from elsewhere in the text."""
    size = F.greatest(F.char_length(text), F.lit(1))

    def one(i: int) -> Column:
        h = lambda k: F.xxhash64(key, F.lit(i), F.lit(k))
        return F.struct(
            F.pmod(h(0), size + 1).cast("long").alias("at"),
            F.pmod(h(1), F.lit(120)).cast("long").alias("remove"),
            F.substring(text, F.pmod(h(2), size).cast("int") + 1, F.pmod(h(3), F.lit(80)).cast("int")).alias("insert"),
        )

    return F.array(*[one(i) for i in range(number)])
