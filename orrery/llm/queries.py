"""Registered queries of the text operators, with their SQL twins where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import alignment, bitslice, debruijn, edits, fmindex, langid, pagediff, pieces, secrets_forest, simhash, token_files, toxicity, turntrie
from orrery.llm.helpers import stored, table
from orrery.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a token file and read back."""
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    tokens = token_files.read_tokens(spark, path)
    digest = stored(tokens.select("part", "shard", "doc_id", "first", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-digest")
    return token_files.with_starts(digest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_near_duplicates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


@query(
    "op4_top_k",
    """with v as (
      select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
      where vec_id is not null and embedding is not null
        and list_bool_and(list_transform(embedding, lambda x: x is not null and coalesce(isfinite(x), false)))),
    scored as (
      select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
    ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
    select query_id, rank, vec_id, score from ranked where rank <= 5""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    return bitslice.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a phrase of the benchmark."""
    found = fmindex.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["after"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query("op6_repeated_passages")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a passage of a document with a smaller id."""
    found = debruijn.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op2_pieces")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether decoding gives its text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.tokenise(docs, public_tokenizers.path("piece_bpe_32k.model"))
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.MARKER), F.lit(" "))
    return found.select("doc_id", "n_pieces", "n_bytes", F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == plain).alias("round_trip"))


@query("op8_edited_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits drawn from its id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = edits.drawn_edits(F.col("doc_id"), F.col("text"), 3)
    found = edits.count_edited(docs, drawn, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "n_after", "n_segments", "n_recounted", F.crc32(F.col("edited").cast("binary")).alias("edited_crc32"))


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = pagediff.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets_forest.find_secrets(docs, secrets_forest.train(docs))
    places = F.transform("secrets", lambda s: F.concat_ws("-", s["first"].cast("string"), s["after"].cast("string")))
    return found.select(
        "doc_id",
        "n_candidates",
        F.size("secrets").cast("bigint").alias("n_secrets"),
        F.array_join(places, ",").alias("places"),
        F.crc32(F.col("redacted").cast("binary")).alias("redacted_crc32"),
    )


@query("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two vocabularies, and how common the links are."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths)


@query(
    "op13_conversation_trie",
    """with recursive own as (
      select conv_id, coalesce(role, '') as r, coalesce(text, '') as x,
        row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as p
      from conversations where conv_id is not null),
    bits as (select conv_id, list_transform(list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)), lambda b: b::bigint) as bytes
      from own group by conv_id),
    crc as (select conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, b: list_reduce(
        list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 9 as h from bits),
    conv as (select conv_id, h, conv_id - conv_id % 5 as base from crc),
    turn as (
      select c.conv_id, 0 as part, o.p, o.r, o.x from conv c join own o on o.conv_id = c.base where o.p < c.h
      union all select c.conv_id, 1, o.p, o.r, o.x from conv c join own o on o.conv_id = c.conv_id where o.p >= c.h),
    seq as (
      select c.conv_id, coalesce(list(struct_pack(r := t.r, x := t.x) order by t.part, t.p) filter (where t.p is not null), []) as s
      from conv c left join turn t on t.conv_id = c.conv_id group by c.conv_id),
    prefix as (select conv_id, s[1:d] as k, d, len(s) = d as last from (select conv_id, s, unnest(range(0, len(s) + 1)) as d from seq)),
    node as (
      select k, d, min(conv_id) as conv_id, count(*) as n,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '')) as ends_sha256
      from prefix group by k, d),
    child as (select k[1:d - 1] as k, d - 1 as d, count(*) as n from node where d > 0 group by 1, 2),
    under as (
      select k[1:e] as k, e as d, sum(leaf) as n_leaves, sum(case when d = 0 then 0 else (n - 1) * strlen(k[d].x) end) as saved
      from (select a.k, a.d, a.n, (b.n is null)::int as leaf, unnest(range(0, a.d + 1)) as e from node a left join child b on b.k = a.k and b.d = a.d)
      group by 1, 2)
    select a.conv_id, a.d::bigint as depth, p.conv_id as parent_conv_id, a.n as n_convs, coalesce(c.n, 0)::bigint as n_children,
      u.n_leaves::bigint as n_leaves, u.saved::bigint as saved_tokens, a.ends_sha256
    from node a left join node p on p.k = a.k[1:a.d - 1] and p.d = a.d - 1
      left join child c on c.k = a.k and c.d = a.d join under u on u.k = a.k and u.d = a.d""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie over all rebuilt conversations."""
    return turntrie.prefix_trie(table(spark, sf_dir, "conversations"))
