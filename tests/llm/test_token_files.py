"""Token files against a plain encoding of every text."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orrery.llm import token_files
from orrery.session import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Straße\tund  Ωμέγας ΟΔΟΣ İstanbul",
    "it's I'LL we'd''s ... ,,a.b--c\x1cd\x85e\xa0f g",
    " ́accent é ﬁ ½ ⅷ 12 345",
    "<|endoftext|> a<|startoftext|>b <|endof text|>",
    "日本語 テキスト 👩‍👩‍👧 🇩🇪",
    "Ça CÔTÉ, ªº ĳ ŉ ǆ ß ẞ ñandú. Ünß!? ÿ ſ e\u0301t\u00e9 \u0149 K \u212b word's. a., b.|, '.",
    "J\u030c ǰ H\u0331 T\u0308 W\u030a A\u02be \u212a\u0327 Ǆ ǅ",
    "<|ENDOFTEXT|> <|StartOfText|>",
    "\r\n\n\n leading and trailing \n",
    "x" * 20_000,
]


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    out, start = [], 0
    for d in sorted(ids):
        out.append((d, start, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes())))
        start += len(ids[d])
    return out


def digest(spark, docs):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, path, PATH, 1)
    tokens = token_files.with_starts(token_files.read_tokens(spark, path))
    found = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in tokens.collect()]
    return path, sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_every_text_round_trips(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(token_files, "DICT_BYTES", 4096)
    rows = [(3 * i, t) for i, t in enumerate(ODD * 3 + [None, ""])]
    rows += [(1000 + i, " ".join(f"word{i * j % 97} the" for j in range(400))) for i in range(90)]
    docs = spark.createDataFrame([(d, t, d, "x") for d, t in rows], "doc_id long, text string, shard long, part string")
    path, found = digest(spark, docs.repartition(5))
    assert found == brute(rows)
    assert token_files.read_dictionary(spark, path)[1]
    wanted = spark.createDataFrame([(0,), (1005,), (77_777,), (None,)], "doc_id long")
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_files.fetch_documents(spark, path, wanted).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    assert got == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in rows if d in (0, 1005)}


def test_repeats_nulls_and_empty_tables(spark):
    rows = [(5, "b"), (5, "b"), (None, "a a"), (5, None), (None, None)]
    _, found = digest(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r[0] for r in found] == [None, None, 5, 5, 5]
    assert [r[1] for r in found] == np.cumsum([0] + [r[2] for r in found])[:-1].tolist()
    assert sum(r[2] for r in found) == 5 + 4
    _, found = digest(spark, spark.createDataFrame([], "doc_id long, text string"))
    assert found == []


def test_refuses_another_dictionary(spark):
    path, _ = digest(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    with pytest.raises(ValueError):
        token_files.shard_index(b"x" * 100)
