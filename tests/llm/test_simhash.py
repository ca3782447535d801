"""Near-duplicate groups against plain loops."""

import random
import re

import numpy as np
import xxhash

from orrery.llm import simhash
from orrery.llm.components import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(nodes, linked):
    nodes = list(nodes)
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


TEXTS = [None, "", " \t\n", "One", "one two", "ONE two", "É é À", "a\x1cb c\x85d e", "x " * 30_000, "a\x0bb\x0cc d"]


def test_fingerprints():
    rng = random.Random(3)
    words = ["Alpha", "beta", "Gamma,", "δέλτα", "e", "日本"]
    for text in TEXTS + [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(60)]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def families(rng, count):
    """Random fingerprints, chains of near ones, and one dense family."""
    out = [rng.getrandbits(64) for _ in range(count)]
    for start in out[:20]:
        now = start
        for _ in range(6):
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                now ^= 1 << bit
            out.append(now)
    centre = rng.getrandbits(64)
    for _ in range(150):
        out.append(centre ^ sum(1 << b for b in rng.sample(range(10), rng.randrange(4))))
    return out


def check_links(spark, values):
    signed = sorted(set(np.array(values, np.uint64).astype(np.int64).tolist()))
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = simhash.fingerprint_links(fps)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in pairs)
    expected = brute_groups(signed, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    roots = {r.node: r.root for r in components(found, "a", "b").collect()}
    assert {v: roots.get(v, v) for v in signed} == expected
    return pairs


def test_links_span_the_groups(spark, monkeypatch):
    values = families(random.Random(5), 300)
    pairs = check_links(spark, values)
    assert len(pairs) < 20 * len(values)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    check_links(spark, values)


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert roots == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}
    assert components(edges.limit(0), "a", "b").count() == 0


def test_documents(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(100 + i, t) for i, t in enumerate(TEXTS)]
    for i in range(30):
        own = list(base)
        own[rng.randrange(300)] = "changed"
        rows.append((500 - i, " ".join(own)))
    rows += [(600 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    rows += [(600, rows[-1][1]), (600, rows[-1][1]), (None, rows[-1][1])]
    docs = spark.createDataFrame([(d, t, 0, "n") for d, t in rows], "doc_id long, text string, fp int, root string")
    found = simhash.near_duplicates(docs)
    got = sorted(((r.doc_id or -1, r.fp, r.component_id) for r in found.collect()))
    fp = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(range(len(rows)), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[groups[i]] = min(smallest.get(groups[i], d), d)
    assert got == sorted((d or -1, int(np.uint64(fp[i]).astype(np.int64)), smallest[groups[i]]) for i, (d, _) in enumerate(rows))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(nulls).collect()] == [None, None]
