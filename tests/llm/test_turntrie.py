"""The prefix trie of conversations against one built from plain tuples."""

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orrery.llm import turntrie

SCHEMA = "conv_id long, turn long, role string, text string"
DATA = Path("/root/testdata/sf0.001")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        base = c - (c % 5 if c >= 0 else -((-c) % 5))
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest(),
        )
        for n in members
    )


def trie(spark, rows):
    return sorted(tuple(r) for r in turntrie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect())


def test_given_table(spark):
    if not DATA.exists():
        pytest.skip("driver tables are not here")
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie(spark, rows) == brute(rows)


def test_nulls_copies_and_empty(spark):
    rows = [(c, t, "user" if t % 2 else None, ["hi", "hé", None, ""][(c // 5 + t) % 3]) for c in range(40) for t in range(1 + c % 7)]
    rows += [(None, 0, "user", "lost"), (50, None, "user", "first"), (50, 0, None, None), (51, 3, "a", "late"), (-3, 0, "x", "y"), (-5, 0, "x", "z")]
    rows += [(60, 0, "u", "same")] * 3
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, []) == []


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "BLOCK", 4)
    monkeypatch.setattr(turntrie, "PACKED", 3)
    rows = [(c, t, "u", f"t{t}" if t < 17 or c % 3 else f"t{t}-{c}") for c in range(0, 100, 5) for t in range(9 + c % 20)]
    assert trie(spark, rows) == brute(rows)


def test_extra_and_clashing_columns(spark):
    rows = [(1, 0, "u", "a", 5, "n"), (6, 0, "u", "a", 7, "m")]
    given_ = spark.createDataFrame(rows, SCHEMA + ", depth int, n_convs string")
    found = sorted(tuple(r) for r in turntrie.prefix_trie(given_).collect())
    assert found == brute([r[:4] for r in rows])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-6, 12), st.integers(0, 4), st.sampled_from(["u", "a"]), st.sampled_from(["", "x", "yy"])), max_size=40, unique_by=lambda r: r[:2]))
def test_any(spark, rows):
    assert trie(spark, rows) == brute(rows)
