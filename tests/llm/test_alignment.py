"""Alignment of two tokenizers against a plain walk over both token lists."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orrery.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DATA = Path("/root/testdata/sf0.001")


def brute(rows):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = alignment.byte_characters()
    groups, links = [], []
    for _, text in rows:
        groups.append([])
        links.append([])
        if not text:
            continue
        a = [(i, bytes(byte[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in second.encode(text):
            p = second.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()))
        if not b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
            continue
        ends_a, ends_b, at = {}, {}, 0
        for i, t in a:
            at += len(t)
            ends_a[at] = i
        at = 0
        for i, t in b:
            at += len(t)
            ends_b[at] = i
        start = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            links[-1].append((ends_a[end], ends_b[end]))
            inside = [[str(i) for e, i in ends.items() if start < e <= end] for ends in (ends_a, ends_b)]
            groups[-1].append((len(inside[0]), len(inside[1]), "|".join(map(",".join, inside))))
            start = end
    counts = Counter(p for some in links for p in some)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), g, some in zip(rows, groups, links):
        text = ";".join(x[2] for x in g)
        out.append((
            doc_id, sum(x[0] for x in g), sum(x[1] for x in g), len(g), len(some), sum(counts[p] == most[p[1]] for p in some),
            sum(counts[p] for p in some), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return sorted(out, key=repr)


def found(spark, rows, extra=""):
    docs = spark.createDataFrame(rows, "doc_id long, text string" + extra)
    return sorted((tuple(r) for r in alignment.align(docs, A, public_tokenizers.PATTERN, B).collect()), key=repr)


def test_given_table(spark, monkeypatch):
    if not DATA.exists():
        pytest.skip("driver tables are not here")
    monkeypatch.setattr(alignment, "SPOON_CHARS", 20_000)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 60_000)
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    assert found(spark, rows) == brute(rows)


def test_hostile_texts(spark):
    texts = [
        None, "", " ", "  ", "\n", " a  b ", "a b", "x▁y", "▁", "<|endoftext|> in <s> text</s>", "<0x41> A", "²½ 12a_b'll",
        "日本語 テキスト 한국어", "🙂🙃 é", "\x00\x1c\x85\x7f tab\t\t end\t", "word " * 400, "﻿bom \U0001f9ff", "a" * 300, "Ünïcödé" * 20,
    ]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(77, "the same"), (77, "the same")]
    assert found(spark, rows) == brute(rows)


def test_extra_columns_and_empty(spark):
    rows = [(1, "one text", 3, "b"), (2, "two texts", 4, "c")]
    assert found(spark, rows, ", block int, kind string") == brute([r[:2] for r in rows])
    assert found(spark, []) == []
