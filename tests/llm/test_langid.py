"""Language identification: held-out accuracy, the kernel against plain sets, and odd input."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from orrery.llm import langid, queries

DATA = Path("/root/testdata/sf0.01")


def test_held_out_accuracy(spark):
    if not DATA.exists():
        pytest.skip("driver tables are not here")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op7_language"](spark, str(DATA)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.97 * len(tested)


def ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = " " + " ".join(words) + " "
    return {line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)} if words else set()


def test_kernel_is_the_shared_share():
    texts = ["The cat, the dog!", "ein Hund und eine Katze", "日本 語", "Ünder 12 été", "a", "the cat sat on the dog " * 50]
    grams = langid.Grams()
    for a in texts:
        assert len(grams(a)) == len(ngrams(a))
        found = grams(a)
        place = np.full(langid.BUCKETS, -1, np.int32)
        place[found] = np.arange(len(found))
        presence = np.full((len(found), 1), 1 / np.sqrt(len(found)))
        rows = np.concatenate([r for r, _ in langid.products(texts, grams, place, presence)])[:, 0]
        plain = [len(ngrams(a) & ngrams(b)) / np.sqrt(len(ngrams(a)) * len(ngrams(b))) for b in texts]
        assert np.allclose(rows, plain)


def test_odd_input(spark):
    known = [(i, f"{w} " * (1 + i % 7), lang) for i, (w, lang) in enumerate([("hello there", "en"), ("guten tag", "de")] * 40)]
    odd = [(900, None, "en"), (901, "", None), (902, "12 -- !", "de"), (903, "guten", None), (903, "guten", None), (None, "hello", None), (904, "hello " * 20_000, None)]
    docs = spark.createDataFrame([(d, t, x, "en", 0.5) for d, t, x in known + odd], "doc_id long, text string, lang string, lang_pred string, source double")
    found = {}
    for r in langid.identify(docs, langid.train(docs)).collect():
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.source))
        assert (r.lang_pred == "und") == (r.lang_score == 0.0)
    assert [found[d][0][0] for d in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "de", "en", "en"]
    assert len(found[903]) == 2
    unlabelled = docs.withColumn("lang", docs["lang"].substr(1, 0)).filter("false")
    assert langid.train(unlabelled) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.train(docs)).count() == 0


def test_recognised_does_not_depend_on_the_number_of_languages(spark):
    rng = random.Random(8)
    shared = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(12)]
    for count in (1, 2, 24):
        own = [["".join(rng.choices("abcdefgh", k=4)) for _ in range(12)] for _ in range(count)]
        say = lambda i, k=4: " ".join(rng.choices(own[i], k=k) + rng.choices(shared, k=7 - k))
        rows = [(n, say(n % count), f"l{n % count:02d}") for n in range(count * 40)]
        rows += [(100_000 + n, say(n % count, 2), None) for n in range(count * 4)]
        rows += [(200_000, "12 --", None), (200_001, None, "l00")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = langid.train(docs)
        scores = {r.doc_id: r.lang_score for r in langid.identify(docs, model).collect()}
        kept = {r.doc_id for r in langid.recognised(docs, model).collect()}
        assert not kept & {200_000, 200_001}
        assert len(kept) >= 0.98 * (len(rows) - 2)
        if count == 24:
            assert len({d for d in kept if scores[d] < 0.3}) > 0.1 * count * 4


def test_without_labels_documents_with_letters_stay(spark):
    rows = [(1, "some text", None), (2, "ünder", None), (3, "12 --", None), (4, None, None), (5, "", None), (None, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs) is None
    assert sorted(r.text for r in langid.recognised(docs, None).collect()) == ["some text", "ünder", "日本"]
