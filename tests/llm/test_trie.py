import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from memspark.llm import common, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def reference(rows, graft=True):
    """The contract in plain Python: nodes are tuples of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(abs(c) % 5 * (1 if c > 0 else -1))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:]) if graft else tuple(turns)
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, graft=True, parts=3):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(parts)
    turns = trie.numbered(df)
    got = trie.prefix_trie(trie.grafted(turns) if graft else turns)
    return sorted((tuple(r) for r in got.select(*RESULT).collect()), key=str)


def random_rows(rng, convs, words, longest):
    rows = []
    for c in rng.sample(range(-20, 400), convs):
        for k in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([k, k, k, None, 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["é", "a", "bc", None, ""][:words])))
    return rows


@pytest.mark.parametrize(("seed", "block", "heavy", "piece", "longest", "words"), [(1, 1 << 16, 1000, 8192, 6, 2), (2, 3, 2, 2, 12, 1), (3, 4, 5, 3, 30, 2), (4, 2, 1000, 1, 5, 5)])
def test_equals_plain_python(spark, monkeypatch, seed, block, heavy, piece, longest, words):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(common, "HEAVY", heavy)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = random_rows(random.Random(seed), 60, words, longest)
    assert nodes(spark, rows) == reference(rows)


def test_chains_that_hang_on_chains(spark, monkeypatch):
    """Conversation k shares its first k turns with k - 1: every chain hangs on the one before."""
    monkeypatch.setattr(common, "HEAVY", 3)
    n = 20
    rows = [(k, t, "user", f"{t}-{min(k, t)}") for k in range(n) for t in range(n)]
    assert nodes(spark, rows, graft=False) == reference(rows, graft=False)


def test_one_hot_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 64)
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(1500)]
    rows += [(c, t, "user", f"turn {t % 7}") for c in range(100, 300) for t in range(3)]
    rows += [(1, 0, "user", "turn 0")] * 40
    assert nodes(spark, rows, graft=False) == reference(rows, graft=False)


def test_odd_tables(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "user", "x")]) == []
    long = "long é" * 50_000
    rows = [(1, 0, "user", long), (1, 1, None, None), (2, 0, "user", long), (2, 0, "user", long), (3, None, "", ""), (None, 2, "a", "b"), (-4, 0, "user", "x")]
    assert nodes(spark, rows) == reference(rows)
    assert nodes(spark, rows, graft=False) == reference(rows, graft=False)
    turnless = next(c for c in range(1, 2000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    only = [(turnless, 0, "user", "x")]
    assert nodes(spark, only) == reference(only) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_prefix_digests_across_blocks_are_those_without_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(c, t, "r", str(t * (c % 2 + 1)), 0, "") for c in range(6) for t in range(50)], SCHEMA)
    got = []
    for block in (1 << 16, 7, 1):
        monkeypatch.setattr(trie, "BLOCK", block)
        got.append(sorted(tuple(r) for r in trie.prefixes(trie.numbered(df)).select("conv_id", "depth", "p1", "p2", "size", "level").collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 300
    assert all(r[5] == (r[1] & -r[1]).bit_length() - 1 for r in got[0])
