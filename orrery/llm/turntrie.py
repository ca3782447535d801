"""Prefix trie over rebuilt conversations, by collapsing whole sequences.

A conversation c is rebuilt from the first h turns of the conversation it branches from and its own turns after its
first h. A depth-d node of the trie is a distinct sequence of d turns. Its key is the exclusive or of one 128-bit hash
per turn, taken over the turn's place, role and text, so keys of all prefixes are running aggregates.

Whole sequences come first: equal rebuilt conversations are folded into one weighted sequence with the list of
conversations that end there, and only its smallest conversation, the representative, is opened into prefixes.
Sequences that are proper prefixes of others drop out by an anti-join; the rest are the leaves. The weighted prefixes
are then aggregated to nodes.

The nodes whose smallest member is q form the lower end of q's path, as a smaller member would be one of all nodes
above. So the trie falls into one path per representative: sums over subtrees are running sums from the end of a
path, plus the totals of the paths that hang below, and those are aggregated over the prefixes above each path.

No conversation, sequence or node is gathered in one task: turns are numbered over range partitions, running aggregates
work in blocks of ``BLOCK`` turns, lists of ends are packed in range partitions and hashed as a stream. Texts are read
once, and only their hashes and lengths travel.

Defined cases: rows without conv_id belong to no conversation; a null turn comes first, a null role or text is empty;
turns with equal numbers are ordered by role, then by the hash of role and text; repeated rows are repeated turns; the remainder
of a negative conv_id has its sign; other columns are ignored; an empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.helpers import group_bounds, stored
from orrery.operators.ordered import number_rows

FAMILY, HEADS = 5, 9
BLOCK = 1024
# Conversation numbers in one packed row of an end list.
PACKED = 4096
NODE = ["depth", "k1", "k2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def branch_of(conv_id: Column) -> Column:
    """The conversation whose turns a conversation starts with."""
    return conv_id - conv_id % FAMILY


def head_turns(conv_id: Column) -> Column:
    """How many turns it takes from there: crc32 of the decimal number, modulo 9."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, n_own, t1, t2, n_bytes): every turn with its place, its hash and the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), role, text).alias("t2"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    numbered = number_rows(slim, ["conv_id"], ["turn", "role", "t1", "t2"])
    return numbered.select("conv_id", "pos", F.col("pos_total").alias("n_own"), "t1", "t2", "n_bytes")


def running(df: DataFrame, keys: list[str], place: Column, columns: dict[str, str], xor: bool = False) -> DataFrame:
    """Add running sums, or exclusive ors (``columns``: new name to column), over each key's rows in the order of ``place``.

    Rows are cut into blocks; the blocks of a key bring one row each to the task that orders them.
    """
    combine = F.bit_xor if xor else F.sum
    cut = df.withColumns({"_place": place, "_block": F.floor(place / BLOCK)})
    blocks = cut.groupBy(*keys, "_block").agg(*[combine(c).alias(f"_{n}") for n, c in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*keys, "_block", *[F.coalesce(combine(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in columns])
    inside = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(offsets, [*keys, "_block"])
    for n, c in columns.items():
        own = combine(c).over(inside)
        out = out.withColumn(n, F.col(f"_{n}").bitwiseXOR(own) if xor else F.col(f"_{n}") + own)
    return out.drop("_place", "_block", *[f"_{n}" for n in columns])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, base, head, n_head, length), and their rebuilt turns (conv_id, depth, x1, x2, n_bytes)."""
    own = turns.filter("pos = 0").select("conv_id", "n_own", branch_of(F.col("conv_id")).alias("base"), head_turns(F.col("conv_id")).alias("head"))
    bases = own.filter("conv_id = base").select("base", F.col("n_own").alias("_n_base"))
    n_head = F.least("head", F.coalesce("_n_base", F.lit(0)))
    length = F.col("n_head") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))
    convs = stored(
        own.join(bases, "base", "left").withColumn("n_head", n_head).select("conv_id", "base", "head", "n_head", length.alias("length")), "conversations"
    )
    first = turns.filter((F.col("pos") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "t1", "t2", "n_bytes")
    heads = convs.filter("n_head > 0").select("conv_id", "base", "n_head").join(first, "base").filter("pos < n_head")
    tails = turns.filter(F.col("pos") >= head_turns(F.col("conv_id"))).join(convs.select("conv_id", "head", "n_head"), "conv_id")
    placed = heads.select("conv_id", (F.col("pos") + 1).alias("depth"), "t1", "t2", "n_bytes").unionAll(
        tails.select("conv_id", (F.col("pos") - F.col("head") + F.col("n_head") + 1).alias("depth"), "t1", "t2", "n_bytes")
    )
    hashes = [F.xxhash64(F.lit(seed), "depth", "t1", "t2").alias(f"x{seed}") for seed in (1, 2)]
    return convs, placed.select("conv_id", "depth", *hashes, "n_bytes")


def prefix_keys(placed: DataFrame) -> DataFrame:
    """Keys of the node (k1, k2) and of its parent (p1, p2) for every rebuilt turn."""
    keyed = running(placed, ["conv_id"], F.col("depth") - 1, {"k1": "x1", "k2": "x2"}, xor=True)
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    return keyed.select("conv_id", "depth", "k1", "k2", *parents, "n_bytes")


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the decimal numbers of the conversations that end in each node, ascending, comma-joined."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bounds = group_bounds(frame, NODE)
            rows = []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                for at in range(low, high, PACKED):
                    ids = frame["conv_id"].iloc[at : min(at + PACKED, high)]
                    rows.append((*frame[NODE].iloc[at].tolist(), int(ids.iloc[0]), ",".join(map(str, ids.tolist()))))
            if rows:
                yield pd.DataFrame(rows, columns=[*NODE, "first", "ids"])

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest, done = None, None, []
        for frame in frames:
            for *node, ids in frame[[*NODE, "ids"]].itertuples(index=False):
                if node != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
                done = []
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*NODE, "ends_sha256"])

    order = [*NODE, "conv_id"]
    node = "depth long, k1 long, k2 long"
    lists = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(packed, f"{node}, first long, ids string")
    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInPandas(hashed, f"{node}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = stored(numbered_turns(conversations), "turns")
    convs, placed = rebuilt(turns)
    keyed = stored(prefix_keys(placed), "prefixes")
    no_turns = [F.lit(0).cast("bigint").alias(k) for k in NODE]
    last = keyed.join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select("conv_id", *NODE)
    ends = stored(last.unionAll(convs.filter("length = 0").select("conv_id", *no_turns)), "ends")

    # Equal conversations fold into one sequence; its smallest conversation stands for it.
    sequences = ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))
    sequences = stored(sequences, "sequences")
    kept = sequences.select("conv_id", F.col("depth").alias("length"))
    root = kept.select("conv_id", *no_turns, *[F.lit(None).cast("bigint").alias(p) for p in ("p1", "p2")], F.lit(0).cast("bigint").alias("n_bytes"), "length")
    paths = stored(keyed.join(kept, "conv_id").select(*root.columns).unionAll(root), "paths")
    leaves = sequences.join(paths.filter("depth < length").select(*NODE).distinct(), NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    weights = sequences.select("conv_id", "weight").join(leaves, "conv_id", "left")

    nodes = paths.join(weights, "conv_id").groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum(F.coalesce("leaf", F.lit(0))).cast("bigint").alias("n_leaves"),
        F.max("n_bytes").alias("n_bytes"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
    )
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")).drop("n_bytes"), "nodes")

    # The path of a representative: from where it leaves smaller conversations to its end.
    own = nodes.groupBy("conv_id").agg(F.min("depth").alias("from_depth"), F.sum("saved").alias("total"))
    hanging = paths.select("conv_id", *NODE).join(own, "conv_id").filter("depth < from_depth").groupBy(*NODE).agg(F.sum("total").alias("_below"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    heads = own.join(nodes.select("conv_id", F.col("depth").alias("from_depth"), "p1", "p2"), ["conv_id", "from_depth"])
    above = nodes.select((F.col("depth") + 1).alias("from_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    hung = heads.join(above, ["from_depth", "p1", "p2"], "left").select("conv_id", "from_depth", "above")
    hung = stored(hung, "heads")

    summed = running(nodes, ["conv_id"], -F.col("depth"), {"subtree": "saved"})
    out = (
        summed.join(hung, "conv_id")
        .join(hanging, NODE, "left")
        .join(children, NODE, "left")
        .join(ends_digest(ends), NODE, "left")
    )
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("from_depth"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_leaves",
        (F.col("subtree") + F.coalesce("_below", F.lit(0))).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
