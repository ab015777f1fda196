import hashlib
import random
import zlib

import pytest

from foliant.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, node string"


def turns(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 207, 300, *range(1000, 1030)]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "hello", "go on", "é日本", "x" * 50])))
    rows += [(500, i, "user", "same text") for i in range(40)] + [(501, i, "user", "same text") for i in range(37)]  # one runs inside the other
    rows += [(600, None, None, None), (600, None, "user", None), (600, 1, None, "a"), (600, 1, "user", "b"), (600, 1, "user", "b"), (None, 0, "user", "lost"), (-7, 0, "user", "negative")]
    return [(*r, "d", "n") for r in rows]


def trie_by_hand(rows):
    convs = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, own in convs.items():
        h, family = zlib.crc32(str(c).encode()) % 6, c - int(c / 100) * 0 - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(convs.get(family, [])[:h] + own[h:])
    nodes = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = set()
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        children = lambda s: sum(len(x) == len(s) + 1 and x[: len(s)] == s for x in nodes)
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in below if s)
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(seq))))
        parent = min(nodes[seq[:-1]]) if seq else None
        out.add((min(members), len(seq), parent, len(members), children(seq), sum(children(s) == 0 for s in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chain", [1024, 3])
def test_trie_equals_brute_force(spark, monkeypatch, chain):
    monkeypatch.setattr(prefix_trie, "CHAIN", chain)
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    got = prefix_trie.prefix_trie(spark.createDataFrame(turns(), TURNS).repartition(5))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for c, t in got.dtypes if c != "ends_sha256")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == trie_by_hand(turns())


def test_odd_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    only = [r for r in turns() if r[0] in (None, 205)]
    assert {tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(only, TURNS)).collect()} == trie_by_hand(only)
    turnless = [(c, 0, "user", "a", "", "") for c in range(1001, 1030)]  # heads are absent, and all turns but some heads' fall away
    got = {tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(turnless, TURNS)).collect()}
    assert got == trie_by_hand(turnless)
