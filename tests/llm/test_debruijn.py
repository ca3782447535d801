"""Repeated passages against plain windows."""

import hashlib
import random
import re

import pytest

from orrery.llm import debruijn, queries

K = debruijn.WINDOW


def brute(rows):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - K + 1):
            key = tuple(w[i : i + K])
            least[key] = min(least.get(key, float("inf")), float("inf") if d is None else d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - K + 1):
            if least[tuple(w[i : i + K])] < (float("inf") if d is None else d):
                gone |= set(range(i, i + K))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    passages = [text(rng.randrange(12, 80)) for _ in range(12)]
    out = []
    for i in range(120):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a:], text(rng.randrange(5))]
        out.append((i * 3, rng.choice([" ", "\n", " \t"]).join(x for p in parts for x in p)))
    out += [(400, out[5][1]), (401, out[5][1]), (401, out[5][1]), (None, out[7][1]), (None, out[7][1]), (402, None), (403, " "), (404, "Ä b\x1cc")]
    out += [(405, "loop " * 5000), (2, "loop " * 14), (406, out[0][1].upper())]
    return out


@pytest.mark.parametrize("block", [debruijn.LEAST_BLOCK, 3000])
def test_against_plain_windows(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(debruijn, "LEAST_BLOCK", block)
    monkeypatch.setattr(debruijn, "MOST_BLOCK", 5 * block)
    cases = rows()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in cases], "doc_id long, text string, block int, kept string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op6_repeated_passages"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(cases)


def test_spans_name_their_source(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "LEAST_BLOCK", 3000)
    cases = [(d, t) for d, t in rows() if d is not None and d != 401]
    df = spark.createDataFrame(cases, "doc_id long, text string").repartition(3)
    spans = debruijn.repeated_spans(debruijn.repeated_passages(df)).collect()
    words = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in cases}
    covered = {}
    for s in spans:
        assert s.source_id < s.doc_id
        assert words[s.doc_id][s.first : s.first + s.n_words] == words[s.source_id][s.source_first : s.source_first + s.n_words]
        covered.setdefault(s.doc_id, set()).update(range(s.first, s.first + s.n_words))
    assert {d: n for d, _, n, _ in brute(cases) if n} == {d: len(c) for d, c in covered.items()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert debruijn.repeated_passages(docs).count() == 0
    nulls = spark.createDataFrame([(None, "a " * 20), (None, None)], "doc_id long, text string")
    assert [r.n_removed for r in debruijn.repeated_passages(nulls).collect()] == [0, 0]
