"""Tokens, counts, TF-IDF and the text features of papers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scalars import PUNCTUATION_MARKS
from orrery.functions.wordlists import ENGLISH_STOP_WORDS, SPLIT_WORDS
from orrery.session import broadcast_if_small, rewritten

# Fixed value: what counts as an address. One character class, so long addresses need no regex recursion.
URL_PATTERN = r"http[s+]?:[s+]?//[!$-_a-z]+"
URL_PLACEHOLDER = "placeholderurl"
# Punctuation, digits and white space part words; runs of them are one gap.
GAPS = "".join("\\" + m for m in PUNCTUATION_MARKS) + r"0-9\t\n\x0B\f\r \x1c-\x1f\x{85}\p{Z}"
# The first part of a word of two, where that word stands alone.
FIRST_PARTS = rf"(?i)(?<![^{GAPS}])({'|'.join(f'{w[:cut]}(?={w[cut:]}(?![^{GAPS}]))' for w, cut in SPLIT_WORDS.items())})"


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0))


def hide_urls(text: Column) -> Column:
    """Replace each found address everywhere in the text, in the order found."""
    return F.aggregate(F.array_distinct(urls(text)), text, lambda t, u: F.replace(t, u, F.lit(URL_PLACEHOLDER)))


def _split(text: Column, lower: bool) -> Column:
    """Words of a text, with empty ones at its ends. Plain expressions only: a lambda per word is interpreted and slow."""
    if lower:
        text = F.lower(text)
    return F.split(F.regexp_replace(hide_urls(text), FIRST_PARTS, "$1 "), f"[{GAPS}]+")


def tokens(text: Column, lower: bool = False) -> Column:
    """Words of a text: addresses hidden, split at punctuation, digits and white space."""
    return F.filter(_split(text, lower), lambda w: w != "")


def without_stop_words(words: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Drop exact matches; the comparison is case-sensitive."""
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def token_rows(docs: DataFrame, id_col: str, text: str, lower: bool = True) -> DataFrame:
    """(id, token) rows without stop words."""
    words = docs.select(id_col, F.explode(_split(F.col(text), lower)).alias("token"))
    return words.filter((F.col("token") != "") & ~F.col("token").isin(list(ENGLISH_STOP_WORDS)))


def lemmatise(rows: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace the token by its lemma from (token, lemma); unknown ones stay. Lower case unless all upper case."""
    known = broadcast_if_small(lemmas.select("token", "lemma"))
    lemma = F.coalesce("lemma", "token")
    out = F.when(F.upper(lemma) == lemma, lemma).otherwise(F.trim(F.lower(lemma)))
    return rows.join(known, "token", "left").withColumn("token", out).drop("lemma")


def token_counts(rows: DataFrame, id_col: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(id, token, n). With a fitted vocabulary other tokens are left out."""
    counts = rows.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))
    if vocabulary is None:
        return counts
    return counts.join(broadcast_if_small(vocabulary.select("token")), "token", "left_semi")


def inverse_frequencies(counts: DataFrame, documents: int) -> DataFrame:
    """(token, idf) with idf = ln(documents / frequency) + 1."""
    frequency = counts.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    return frequency.select("token", (F.log(F.lit(float(documents)) / F.col("_df")) + 1).alias("idf"))


def tf_idf(counts: DataFrame, id_col: str, idf: DataFrame) -> DataFrame:
    """(id, token, weight), rows scaled to unit length. Tokens outside the fitted table are left out."""
    weighted = counts.join(broadcast_if_small(idf), "token").withColumn("weight", F.col("n") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "token", (F.col("weight") / length).alias("weight"))


def text_features(docs: DataFrame, id_col: str, text: str, k: int = 20, lemmas: DataFrame | None = None, seed: int = 17):
    """Tokens, TF-IDF and the first k principal components; returns the fitted projection and (id, pc0..)."""
    from orrery.operators.projection import sparse_pca

    rows = token_rows(docs, id_col, text)
    if lemmas is not None:
        rows = lemmatise(rows, lemmas)
    # Read twice below; tokenising is the costly part.
    counts = rewritten(token_counts(rows, id_col))
    weights = tf_idf(counts, id_col, inverse_frequencies(counts, docs.count()))
    return sparse_pca(weights, docs.select(id_col), id_col, "token", "weight", k, seed=seed)


def starts_with_verb(text: Column, verbs: Sequence[str]) -> Column:
    """True when a sentence starts with one of the verbs or with RT."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    wanted = [v.lower() for v in verbs]

    def opens(sentence: Column) -> Column:
        word = F.regexp_extract(sentence, r"^[\s\p{Punct}]*([\p{L}]+)", 1)
        return (word == "RT") | F.lower(word).isin(wanted)

    return F.exists(sentences, opens)
