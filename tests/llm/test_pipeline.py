"""The stages of the pipeline, each against a brute-force version on its own input."""

import re
import zlib
from pathlib import Path

import public_tokenizers
import pytest
from test_fmindex import brute as brute_hits
from test_secrets_forest import KNOWN
from test_simhash import brute_fingerprint, brute_groups

import corpus_pipeline
from orrery.llm import fmindex, pieces

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def results(spark):
    if not DATA.exists():
        pytest.skip("driver tables are not here")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = [(9000, None, "en"), (9001, "12 34 --", "de"), (9002, "", None), (None, "The and of the nation and it was", None)]
    docs = docs.unionByName(spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in extra], "doc_id long, text string, lang string, source string, n_chars long"))
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA)).cache()
        out.append(docs.collect())
    return out


def pairs(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=repr)


def test_language(results):
    gone = {9000, 9001, 9002}
    assert pairs(results[1]) == pairs([r for r in results[0] if r.doc_id not in gone])


def test_near_duplicates(results):
    rows = sorted(results[1], key=lambda r: (r.doc_id is None, r.doc_id or 0))
    fp = [brute_fingerprint(r.text) for r in rows]
    groups = brute_groups(range(len(rows)), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3)
    assert pairs(results[2]) == pairs([r for i, r in enumerate(rows) if groups[i] == i])
    assert len(results[2]) < len(results[1])


def test_benchmark(results, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hits = {d: (n, hit) for d, n, hit, *_ in brute_hits([(r.doc_id, r.text) for r in results[2]], items)}
    before = {r.doc_id: r.text for r in results[2]}
    assert sorted(before, key=repr) == sorted((r.doc_id for r in results[3]), key=repr)
    assert any(hit for _, hit in hits.values())
    for r in results[3]:
        n, hit = hits[r.doc_id]
        assert len(fmindex.words_of(r.text)) == n - hit
        assert hit or r.text == before[r.doc_id]


def test_secrets(results):
    before = {r.doc_id: r.text for r in results[3]}
    assert {r.doc_id: r.text for r in results[4]} == {d: KNOWN.sub("[SECRET]", t) for d, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in results[4] if re.search(r"\[SECRET\]", r.text))


def test_pieces(results):
    before = {r.doc_id: r.text for r in results[4]}
    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = dict(zip(before, pieces.encode_texts(before.values(), path)))
    assert {r.doc_id: (r.n_pieces, r.ids_crc32, r.round_trip) for r in results[5]} == {d: (len(i) // 4, zlib.crc32(i), True) for d, i in ids.items()}


def test_run(spark, results):
    found = corpus_pipeline.run(spark, str(DATA))
    numbered = {r.doc_id: r.n_pieces for r in results[5] if r.doc_id is not None}
    assert {r.doc_id: r.n_pieces for r in found.collect()} == numbered
