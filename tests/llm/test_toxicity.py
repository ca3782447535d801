"""The toxicity model: features and steps against plain versions, accuracy on held-out documents, defined cases."""

import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from orrery.llm import toxicity

DATA = Path("/root/testdata/sf0.01")
DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def plain_features(text):
    words = ["".join(c if c.isalnum() else " " for c in part) for part in (text or "").lower().split()]
    words = [xxh64_intdigest(w) for part in words for w in part.split()]
    mask = (1 << 64) - 1
    found = set(words)
    for gap in (1, 2):
        found |= {((a * 0x9E3779B97F4A7C15 & mask) ^ b) * (0xC2B2AE3D27D4EB4F + 2 * gap) & mask for a, b in zip(words, words[gap:])}
    return sorted({h >> (64 - toxicity.BITS) for h in found})


@pytest.mark.parametrize("window", [1, 2, 5, 100])
def test_features(monkeypatch, window):
    monkeypatch.setattr(toxicity, "WINDOW", window)
    for text in (None, "", "...", "One", "one two", "a b_c d'e ünï f g a b c", "x y z " * 30):
        assert toxicity.features(text).tolist() == plain_features(text)


def test_steps_against_plain_ftrl():
    rng = np.random.default_rng(3)
    state = toxicity.State(20)
    z, n = [0.0] * 21, [0.0] * 21

    def weight(i):
        l1 = 0.0 if i == 20 else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(200):
        at = np.flatnonzero(rng.random(20) < 0.4)
        label = int(3 in at or rng.random() < 0.1)
        state.learn(at, label)
        own = [*at.tolist(), 20]
        w = [weight(i) for i in own]
        g = 1 / (1 + math.exp(-sum(w))) - label
        for i, wi in zip(own, w):
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * wi
            n[i] += g * g
    assert np.allclose(state.z, z) and np.allclose(state.n, n)
    weights = toxicity.weights_of(state.z[:-1], state.n[:-1])
    assert weights.argmax() == 3 and (weights == 0).any()


def test_rounds_against_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "RUN", 16)
    rows = [(i, i % 3 == 0, f"w{i % 7} and {'bad' if i % 3 == 0 else 'good'} w{i % 5}") for i in range(60)]
    sample = spark.createDataFrame(rows, "doc_id long, label boolean, text string").selectExpr("doc_id", "int(label) label", "text")
    found = toxicity.fit(sample)
    order = sample.selectExpr("doc_id", "label", "text", f"int(pmod(xxhash64(doc_id, 17), {toxicity.SHARDS})) shard", "xxhash64(doc_id, 19) o").collect()
    often = Counter(b for r in order for b in plain_features(r.text))
    kept = sorted(b for b, n in often.items() if n > 2)
    state = toxicity.State(len(kept))
    for _ in range(toxicity.ROUNDS):
        z, n, times = (np.zeros(len(kept) + 1) for _ in range(3))
        for shard in {r.shard for r in order}:
            own = toxicity.State(len(kept))
            own.z[:], own.n[:] = state.z, state.n
            for r in sorted((r for r in order if r.shard == shard), key=lambda r: r.o):
                own.learn(np.searchsorted(kept, [b for b in plain_features(r.text) if often[b] > 2]), r.label)
            times += own.n != state.n
            z += own.z - state.z
            n += own.n - state.n
        state.z += z / np.maximum(times, 1)
        state.n += n / np.maximum(times, 1)
    values = toxicity.weights_of(state.z[:-1], state.n[:-1])
    assert found.buckets.tolist() == [k for k, v in zip(kept, values) if v]
    assert np.allclose(found.values, values[values != 0])


def test_held_out_documents(spark):
    if not DATA.exists():
        pytest.skip("driver tables are not here")
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    ones = [r.score for r in rows if r.held_out and toxic.get(r.doc_id) == 1]
    zeros = [r.score for r in rows if r.held_out and toxic.get(r.doc_id) == 0]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.8


def test_defined_cases(spark):
    rows = [(i, f"calm words here {i}" if i % 2 else f"bad idiot here {i}") for i in range(80)]
    docs = spark.createDataFrame([*rows, (None, "idiot"), (200, None), (200, ""), (201, "idiot " * 3), (3, rows[3][1])], DOCS)
    marks = [(i, 0, 1 - i % 2) for i in range(80)] + [(None, 0, 1), (5, 0, None), (7, 0, 0), (7, 0, 0)]
    found = toxicity.toxicity(docs, spark.createDataFrame(marks, LABELS)).collect()
    assert len(found) == 85
    by_id = {r.doc_id: r for r in found}
    assert by_id[201].predicted == 1 and by_id[200].score < by_id[201].score and by_id[None].held_out is False
    assert len({r.score for r in found if r.doc_id == 200}) == 1
    assert all(by_id[i].predicted == 1 - i % 2 for i in range(80))
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), none).collect() == []
    clashing = docs.selectExpr("doc_id", "text", "1 label", "'x' score", "2 buckets", "3 toxic")
    assert sorted(toxicity.toxicity(clashing, spark.createDataFrame(marks, LABELS)).collect(), key=repr) == sorted(found, key=repr)
