"""Joins, look-ups, de-duplication and incremental loads on objects, papers and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scalars import collapse_blanks, fill_band_gaps, first_present
from orrery.session import dealt


def fill_from_detail(objects: DataFrame, detail: DataFrame, id_col: str, bands: Sequence[str]) -> DataFrame:
    """Own band, else the upper-case flux, else the lower-case one, then gap filling; redshift is the detail's."""
    both = objects.join(detail, id_col, "left")
    merged = both.select(
        id_col,
        "redshift",
        *[first_present(F.col(b), F.col(f"{b}_hi"), F.col(f"{b}_lo")).alias(b) for b in bands],
    )
    filled = fill_band_gaps([F.col(b) for b in bands])
    return merged.select(id_col, "redshift", *[c.alias(b) for b, c in zip(bands, filled)])


# -- look-ups and joins ------------------------------------------------------------------------------------------------
def merge_rows(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Put two projections of the same rows side by side, on an explicit row key."""
    return left.join(right, key)


def paper_details(ids: DataFrame, papers: DataFrame, id_col: str, seq: str) -> DataFrame:
    """Details of each id, first record by ``seq``; null when the id is unknown."""
    payload = F.struct(*[c for c in papers.columns if c != id_col])
    first = papers.groupBy(id_col).agg(F.min_by(payload, seq).alias("_first"))
    return ids.join(first, id_col, "left").select(*ids.columns, "_first.*")


def known_edges(edges: DataFrame, papers: DataFrame, paper_col: str) -> DataFrame:
    return edges.join(papers.select(paper_col), paper_col, "left_semi")


def unseen(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return candidates.join(known.select(key), key, "left_anti")


def pair_with_papers(
    papers: DataFrame, edges: DataFrame, object_ids: Sequence[str], paper_col: str = "refcode", id_col: str = "objid"
) -> DataFrame:
    """Every paper next to each requested object, flagged 1 when the pair is an edge. The id list is a parameter."""
    asked = F.explode(F.array(*[F.lit(i) for i in object_ids]))
    pairs = papers.withColumn(id_col, asked)
    linked = edges.filter(F.col(id_col).isin(list(object_ids))).select(id_col, paper_col).distinct()
    flagged = pairs.join(linked.withColumn("_linked", F.lit(1)), [id_col, paper_col], "left")
    return flagged.withColumn("associated", F.coalesce("_linked", F.lit(0))).drop("_linked")


def first_containing(objects: DataFrame, names: Sequence[str], id_col: str, seq: str) -> DataFrame:
    """First object, in input order, whose blank-collapsed id contains the collapsed name (case-sensitive)."""
    asked = objects.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    hits = asked.filter(F.contains(collapse_blanks(F.col(id_col)), collapse_blanks(F.col("name"))))
    return hits.groupBy("name").agg(F.min_by(id_col, seq).alias(id_col))


def coordinates_of(objects: DataFrame, names: DataFrame, id_col: str, ra: str, dec: str) -> DataFrame:
    """Positions of the objects whose id equals the name, ignoring case and runs of blanks."""
    keyed = objects.select(collapse_blanks(F.lower(F.col(id_col))).alias("_key"), id_col, ra, dec)
    asked = names.withColumn("_key", collapse_blanks(F.lower(F.col("name"))))
    return asked.join(keyed, "_key").drop("_key")


def papers_of_group(groups: DataFrame, edges: DataFrame, group_col: str, id_col: str = "objid") -> DataFrame:
    """Distinct (group, paper) over the members of each group."""
    return edges.join(groups.select(id_col, group_col), id_col).select(group_col, "refcode").distinct()


# -- de-duplication and renames ----------------------------------------------------------------------------------------
def keep_last(records: DataFrame, id_col: str, seq: str) -> DataFrame:
    """The newest record of each id. An aggregate, so copies of a hot id are folded before the shuffle."""
    rest = F.struct(*[c for c in records.columns if c != id_col])
    return records.groupBy(id_col).agg(F.max_by(rest, seq).alias("_last")).select(id_col, "_last.*")


def drop_copies(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def transfer_edges(edges: DataFrame, moves: DataFrame, objects: DataFrame, id_col: str = "objid") -> DataFrame:
    """Give the papers of ``from_id`` to ``to_id`` as well, where both objects exist; distinct edges."""
    ids = objects.select(id_col)
    valid = moves.join(ids.withColumnRenamed(id_col, "from_id"), "from_id", "left_semi").join(
        ids.withColumnRenamed(id_col, "to_id"), "to_id", "left_semi"
    )
    moved = edges.join(valid, edges[id_col] == valid["from_id"]).select(F.col("to_id").alias(id_col), "refcode")
    return dealt(edges.select(id_col, "refcode").unionByName(moved), id_col, "refcode").distinct()


def rename_objects(df: DataFrame, renames: DataFrame, id_col: str = "objid") -> DataFrame:
    """Apply (old_id, new_id) to the id column; other rows stay as they are."""
    hit = df.join(renames, df[id_col] == renames["old_id"], "left")
    return hit.withColumn(id_col, F.coalesce("new_id", id_col)).drop("old_id", "new_id")


def remove_objects(df: DataFrame, gone: DataFrame, id_col: str = "objid") -> DataFrame:
    return df.join(gone.select(id_col), id_col, "left_anti")


def category_mapping(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """key -> value over the distinct pairs, in the order the pairs first appear; the last pair wins."""
    pairs = df.groupBy(key, value).agg(F.min(seq).alias("_seen"))
    return pairs.groupBy(key).agg(F.max_by(value, "_seen").alias(value))


def null_share(objects: DataFrame, bands: Sequence[str], name: str = "pnan") -> DataFrame:
    missing = sum((F.col(b).isNull().cast("int") for b in bands[1:]), F.col(bands[0]).isNull().cast("int"))
    return objects.withColumn(name, missing / len(bands))


def merge_empty_objects(
    objects: DataFrame, edges: DataFrame, bands: Sequence[str], position: Sequence[Column], seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Objects without any band hand their papers to the nearest kept object and go away.

    An object without a receiver (it has no position, or no object with a band has one) stays, and keeps its papers.
    The receiver takes over the old name when that starts with M, HD or NGC; of several such senders the first by
    input order names it.
    """
    from orrery.operators.nearest import nearest_other

    shares = null_share(objects, bands)
    empty, kept = shares.filter("pnan = 1"), shares.filter("pnan < 1")
    moves = nearest_other(empty, kept, "objid", position, seq).select(
        F.col("objid").alias("from_id"), F.col("nearest").alias("to_id"), F.col(seq).alias("_from_seq")
    )
    moves = moves.filter("to_id is not null")
    catalogue = F.col("from_id").rlike("^(M|HD|NGC)")
    renames = (
        moves.filter(catalogue)
        .groupBy(F.col("to_id").alias("old_id"))
        .agg(F.min_by("from_id", "_from_seq").alias("new_id"))
    )
    gone = moves.select(F.col("from_id").alias("objid"))
    edges_out = remove_objects(transfer_edges(edges, moves.select("from_id", "to_id"), objects), gone)
    objects_out = remove_objects(objects, gone)
    return rename_objects(objects_out, renames), rename_objects(edges_out, renames).distinct()


# -- incremental load --------------------------------------------------------------------------------------------------
def ingest_papers(known: DataFrame, batch: DataFrame, key: str = "refcode") -> DataFrame:
    """Known papers plus the batch's new ones; a paper repeated inside the batch is added once."""
    return known.unionByName(unseen(batch, known, key).dropDuplicates([key]))


def ingest_objects(known: DataFrame, batch: DataFrame, id_col: str, seq: str, refresh: bool = True) -> DataFrame:
    """Append a batch and keep the last record per object; without ``refresh`` known objects stay untouched."""
    arriving = batch if refresh else unseen(batch, known, id_col)
    return keep_last(known.unionByName(arriving), id_col, seq)


# -- top-k -------------------------------------------------------------------------------------------------------------
def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key. Spark cuts to k rows per key and task before the shuffle, so a hot key stays small."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def latest_papers(edges: DataFrame, k: int = 10, id_col: str = "objid", paper_col: str = "refcode") -> DataFrame:
    return first_k(edges, [id_col], [F.col(paper_col).desc()], k)


def append_latest(recommended: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Recommendations followed by the object's latest k papers, those with zero scores and flagged associated."""
    latest = latest_papers(edges, k).select(
        "objid",
        "refcode",
        F.lit(0.0).alias("mlp_proba"),
        F.lit(1).alias("associated"),
        F.lit(0.0).alias("cf_score"),
        F.lit(0.0).alias("recommend"),
    )
    return recommended.select(latest.columns).unionByName(latest)
