"""Decontamination against plain searches."""

import hashlib
import random
import re

import numpy as np
import pytest

from orrery.llm import fmindex, queries

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = re.findall(WORD, low(text))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = re.findall(WORD, low(text))
        hit, found = set(), set()
        for p, own in windows.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(8)
    vocabulary = ["the", "of", "a", "in", "B", "é", "日", "x1", "long", "Word", "z"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 40)))) for i in range(30)]
    items += [(30, "tiny two"), (31, ""), (32, None), (None, "no id"), (5, "Second, row of-five"), (33, "!!!")]
    docs = [(i, " ".join(rng.choices(vocabulary + ["other", "words"], k=rng.randrange(300)))) for i in range(60)]
    for i in range(60):
        start = items[rng.randrange(30)][1]
        docs.append((100 + i, f"{rng.choice(['', 'before. ', 'x1 '])}{start.upper() if i % 3 else start}{rng.choice(['', '\nafter', ' z z z'])}" * rng.randrange(1, 3)))
    docs += [(200, None), (201, ""), (202, "tiny-TWO tiny two"), (203, "no\x1cid"), (203, "no\x1cid"), (None, "tiny two"), (204, "a " * 20_000)]
    return docs, items


@pytest.mark.parametrize("block,shard", [(500_000, 1 << 20), (100, 500)])
def test_against_plain_search(spark, monkeypatch, tmp_path, block, shard):
    monkeypatch.setattr(fmindex, "BLOCK_PHRASES", block)
    monkeypatch.setattr(fmindex, "SHARD_WORDS", shard)
    docs, items = cases()
    spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, t, 1) for d, t in items], "item_id long, text string, phrase int").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.QUERIES["op5_decontamination"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items)


def test_cutting(spark):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, len(t or "")) for d, t in docs], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = fmindex.decontaminate(df, bench).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(d) for d, _ in docs)
    clean = {d for d, _, hit, *_ in brute(docs, items) if not hit}
    assert all(r.text == dict(docs)[r.doc_id] for r in kept if r.doc_id in clean)
    assert all(r.n_chars == len(r.text or "") for r in kept)
    words = {d: n - hit for d, n, hit, *_ in brute(docs, items)}
    assert all(len(re.findall(WORD, low(r.text))) == words[r.doc_id] for r in kept)
    assert fmindex.cut_words("Ab, cd; ef. gh", [(1, 3)]) == "Ab, . gh"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.spans, r["items"]) for r in fmindex.contamination(docs, bench).orderBy("doc_id").collect()] == [(2, [], []), (0, [], [])]
    full = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert fmindex.contamination(docs.limit(0), full).count() == 0


def test_index_parts():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 40)), 0) for _ in range(30)])
    index = fmindex.FMIndex(text, 3)
    for n in (1, 2, 5):
        for phrase in np.array(np.meshgrid(*[[1, 2, 3]] * n)).reshape(n, -1).T:
            (a,), (b,) = index.search(phrase[None, :], np.array([n]))
            expected = [i for i in range(len(text) - n) if (text[i : i + n] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected
