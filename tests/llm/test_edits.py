"""Counts after edits against encoding the whole text again."""

import random
import zlib

import public_tokenizers

from orrery.llm import edits, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BITS = ["word", " the", "  ", "\n", "\t", "\r\n", "'s", "'", " don't", "!?", "\x1c", "\x85", "\xa0", "　", "é", " 日本", "123", " x", "\n\n ", "👩", ".", ""]


def plain_edit(text, at, remove, insert):
    at = min(max(at, 0), len(text))
    return text[:at] + insert + text[at + max(remove, 0) :]


def test_segments_count_like_the_whole():
    encoding = edits.encoding_at(PATH, PATTERN)
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choices(BITS, k=rng.randrange(12)))
        parts = edits.SEGMENT.findall(text)
        assert "".join(parts) == text
        assert sum(len(encoding.encode_ordinary(p)) for p in parts) == len(encoding.encode_ordinary(text))


def test_edits_follow_the_text():
    encoding = edits.encoding_at(PATH, PATTERN)
    counter = edits.token_counter(PATH, PATTERN)
    rng = random.Random(6)
    for size in (0, 1, 5, 80, 1500):
        for _ in range(25):
            text = "".join(rng.choices(BITS, k=size))
            (tree,) = edits.trees([text], counter)
            for _ in range(8):
                edit = rng.randrange(-2, len(text) + 4), rng.choice([0, 1, 3, 40, len(text)]), "".join(rng.choices(BITS, k=rng.randrange(4)))
                text = plain_edit(text, *edit)
                tree.edit(*edit)
                assert tree.text() == text
                assert tree.total() == len(encoding.encode_ordinary(text))
                assert tree.chars[1] == len(text)


def test_only_the_neighbourhood_is_counted_again():
    counter = edits.token_counter(PATH, PATTERN)
    (tree,) = edits.trees(["some words here " * 5000], counter)
    tree.edit(40_000, 10, "new text")
    assert tree.recounted < 12


def test_query_and_tables(spark, tmp_path):
    encoding = edits.encoding_at(PATH, PATTERN)
    rows = [(i, " ".join(f"word{j * i % 50}," for j in range(i * 7))) for i in range(40)] + [(50, None), (51, ""), (52, "a"), (52, "a"), (None, "b c"), (53, "long " * 30_000)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n_tokens int, at int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op8_edited_counts"](spark, str(tmp_path)).collect()
    drawn = docs.select("doc_id", "text", edits.drawn_edits(docs["doc_id"], docs["text"], 3).alias("e")).collect()
    expected = []
    for r in drawn:
        text = r.text or ""
        before = len(encoding.encode_ordinary(text))
        for e in r.e:
            text = plain_edit(text, e["at"], e["remove"], e["insert"] or "")
        expected.append((r.doc_id, before, len(encoding.encode_ordinary(text)), zlib.crc32(text.encode())))
    assert sorted(((r.doc_id, r.n_tokens, r.n_after, r.edited_crc32) for r in found), key=repr) == sorted(expected, key=repr)
    made = spark.createDataFrame([(1, 2, 0, 3, "X "), (1, 1, 5, None, None), (52, 1, None, 1, "b"), (99, 1, 0, 0, "y")], "doc_id long, seq int, at long, remove long, insert string")
    after = {r.doc_id: (r.edited, r.n_after) for r in edits.apply_edits(docs.filter("doc_id in (1, 2, 52)"), made, PATH, PATTERN).collect()}
    texts = dict(rows)
    assert after[1][0] == plain_edit(texts[1], 0, 3, "X ") and after[2][0] == texts[2] and after[52][0] == "b"
    assert all(n == len(encoding.encode_ordinary(t)) for t, n in after.values())
    assert edits.apply_edits(docs.limit(0), made, PATH, PATTERN).count() == 0
