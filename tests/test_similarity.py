"""Exact similarity links against all pairs in numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.operators import similarity


def clustered(rng, n, dim=6, clusters=5):
    centres = rng.normal(size=(clusters, dim))
    v = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.3
    v[rng.random(n) < 0.3] = v[0]  # many copies of one row
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[rng.random(n) < 0.03] = 0
    return v


def all_pairs(v, threshold, k, groups=None):
    sim = np.round(v @ v.T + similarity.NUDGE, 6)
    out = []
    for a in range(len(v)):
        near = [(-sim[a, b], b) for b in range(len(v)) if b != a and sim[a, b] >= threshold and (groups is None or groups[a] == groups[b])]
        out += [(a, b, -s, r + 1) for r, (s, b) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("threshold", "k", "block"), [(0.72, 3, 40), (0.95, 2, 25), (-1.0, 4, 512), (0.5, 1, 7)])
def test_links_over_all_rows_equal_all_pairs(spark, threshold, k, block):
    v = clustered(np.random.default_rng(block), 200)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = sorted((r.a, r.b, r.score, r["rank"]) for r in similarity.semantic_links(df, threshold, k, block=block).collect())
    assert got == all_pairs(v, threshold, k)


def test_links_within_groups_equal_all_pairs(spark):
    v = clustered(np.random.default_rng(1), 120)
    groups = [None if i % 7 == 0 else f"g{i % 3}" for i in range(120)]
    df = spark.createDataFrame([(i, x.tolist(), g) for i, (x, g) in enumerate(zip(v, groups, strict=True))], "id long, v array<double>, g string")
    got = sorted((r.a, r.b, r.score, r["rank"]) for r in similarity.semantic_links(df, 0.6, 3, "g", block=11).collect())
    assert got == all_pairs(v, 0.6, 3, groups)


def test_cells_that_can_hold_a_pair_are_all_compared():
    rng = np.random.default_rng(3)
    v = clustered(rng, 400, clusters=12)
    v = v[np.linalg.norm(v, axis=1) > 0]
    pivots = similarity.learned_pivots(v[:200], 16)
    a = np.arccos(np.clip(v @ pivots.T, -1, 1))
    cell = a.argmin(axis=1)
    low = np.array([a[cell == c].min(axis=0) if (cell == c).any() else np.full(16, 9.0) for c in range(16)])
    high = np.array([a[cell == c].max(axis=0) if (cell == c).any() else np.full(16, -9.0) for c in range(16)])
    reach = similarity.reachable(low, high, 0.9)
    i, j = np.nonzero(v @ v.T >= 0.9)
    assert reach[cell[i], cell[j]].all()
    assert reach[np.unique(cell)][:, np.unique(cell)].mean() < 0.7  # clusters apart aren't compared


def test_empty_and_single_rows(spark):
    schema = "id long, v array<double>"
    for rows in ([], [(1, [1.0, 0.0])], [(1, [0.0, 0.0]), (2, [0.0, 0.0])]):
        assert similarity.semantic_links(spark.createDataFrame(rows, schema), 0.5, 3).collect() == []


def all_documents(v, names, threshold, k):
    sim = np.round(v @ v.T + similarity.NUDGE, 6)
    out = []
    for a in range(len(v)):
        near = []
        for b in range(len(v)):
            shared = len(names[a] & names[b])
            if a != b and sim[a, b] >= threshold:
                near.append((-sim[a, b], b, "semantic_neighbor", shared))
            elif a != b and shared:
                near.append((-round(min(0.48 + 0.04 * min(shared, 5), 0.68), 6), b, "entity_overlap", shared))
        out += [(a, b, kind, -s, shared, r + 1) for r, (s, b, kind, shared) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [9, 40, 500])
def test_document_links_equal_all_pairs(spark, block):
    rng = random.Random(block)
    v = clustered(np.random.default_rng(block), 150, dim=8, clusters=40)
    names = [set(rng.sample([f"n{x}" for x in range(30)], rng.randint(0, 6))) | ({"everywhere"} if rng.random() < 0.4 else set()) for _ in v]
    df = spark.createDataFrame([(i, x.tolist(), sorted(e)) for i, (x, e) in enumerate(zip(v, names, strict=True))], "id long, v array<double>, entities array<string>")
    got = sorted((r.a, r.b, r.kind, r.score, r.shared, r["rank"]) for r in similarity.document_links(df, 0.58, 3, block).collect())
    assert got == all_documents(v, names, 0.58, 3)
    assert {r[2] for r in got} == {"semantic_neighbor", "entity_overlap"}


def test_tiles_keep_the_first_of_equal_scores(monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 16)
    v = clustered(np.random.default_rng(8), 90)
    for p, q in ((v, None), (v[:37], v[37:])):
        forth, back = similarity.nearest_in(p, q, 3, 0.6)
        sim = np.round(p @ (p if q is None else q).T + similarity.NUDGE, 6)
        if q is None:
            np.fill_diagonal(sim, -9)
        for best, scores in ((forth, sim), (back, sim.T)):
            for row in range(len(scores) if best else 0):
                want = [c for c in np.lexsort((np.arange(len(scores[row])), -scores[row]))[:3] if scores[row, c] >= 0.6]
                assert [c for c in best.column[row] if c >= 0] == want


@pytest.mark.parametrize("dense", [0, 24])
def test_single_precision_loses_no_link(monkeypatch, dense):
    """Scores that lie closer together than single precision tells, and rows of copies."""
    monkeypatch.setattr(similarity, "TILE", 32)
    monkeypatch.setattr(similarity, "DENSE", dense)
    rng = np.random.default_rng(4)
    v = rng.normal(size=64) + rng.normal(size=(300, 64)) * 0.002
    v[rng.random(300) < 0.2] = v[0]
    v /= np.linalg.norm(v, axis=1)[:, None]
    forth, _ = similarity.nearest_in(v, None, 4, 0.5)
    assert sorted((a, b, s) for a, b, s in zip(*forth.links(np.arange(300), np.arange(300)), strict=True)) == sorted(r[:3] for r in all_pairs(v, 0.5, 4))


def test_blocks_are_packed(spark):
    """Vectors of counts over their norm are sent in a fifth of their bytes at most, and come back as they were."""
    import pyarrow as pa

    counts = np.random.default_rng(5).poisson(1.0, (3000, 64)) + 0.0
    v = counts / np.linalg.norm(counts, axis=1)[:, None]
    rows = spark.createDataFrame(pa.table({"id": np.arange(3000)[::-1].copy(), "v": list(v), "block": ["b"] * 3000}))
    got = similarity.packed(rows).toArrow()
    ids, back = similarity._unpacked(got, "part", "rows")
    assert (ids == np.arange(3000)).all() and (back == v[::-1]).all()
    assert sum(len(x) for x in got["rows"].to_pylist()) < v.nbytes / 5


def test_many_rows_are_few_blocks(spark):
    assert 512_820 / similarity.block_rows(512_820) <= 8  # each row is sent once for every block
    rows = spark.range(140_000).select("id", F.array(F.rand(1)).alias("v"), (F.col("id") % 2).alias("g"))
    blocks = similarity.dealt_blocks(rows, 0.5, "g")[1].select("i").distinct().count()
    assert blocks <= 40  # before: 70


def test_blocks_are_a_fixed_share_of_the_rows():
    assert 10_000_000 / similarity.block_rows(10_000_000) <= 8  # before: 77, so what was sent grew with rows squared


def test_rows_are_dealt_evenly_where_no_cells_are_left_out(spark):
    v = np.abs(clustered(np.random.default_rng(6), 400)) + 1
    df = spark.createDataFrame([(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    _, pairs = similarity.dealt_blocks(df, 0.1, None, 50)
    assert pairs.count() == 36  # before: a cell larger than a block was two, so more


def test_strips_of_packed_blocks_equal_whole_blocks(spark, monkeypatch):
    """Ids of a block's parts interleave, and each of its strips holds rows of all parts; equal scores go to the smaller id."""
    monkeypatch.setattr(similarity, "STRIP", 16)
    v = clustered(np.random.default_rng(9), 120)
    df = spark.createDataFrame([(i, x.tolist(), "p" if i % 3 else "q") for i, x in enumerate(v)], "id long, v array<double>, block string").repartition(5)
    t = similarity.packed(df).toArrow()
    assert len(t) > 5
    blocks = [similarity.Block(t.filter(np.array([b == name for b in t["block"].to_pylist()])), "part", "rows") for name in "pq"]
    for other in (None, blocks[1]):
        whole = [v[b.ids] for b in blocks]
        want = similarity.nearest_in(whole[0], None if other is None else whole[1], 3, 0.6)
        got = similarity.nearest_between(blocks[0], other, 3, 0.6)
        assert all((x.column == y.column).all() and (x.score == y.score).all() for x, y in zip(want, got, strict=True) if x is not None)


def test_names_are_only_compared_for_documents_without_near_neighbours(spark, monkeypatch):
    seen, overlaps = [], similarity.overlaps
    monkeypatch.setattr(similarity, "overlaps", lambda opened, *rest: (seen.append(opened.count()), overlaps(opened, *rest))[1])
    v = [[1.0, 0.0]] * 40 + [[0.0, 1.0], [0.0, -1.0]]
    df = spark.createDataFrame([(i, x, ["name"]) for i, x in enumerate(v)], "id long, v array<double>, entities array<string>")
    got = similarity.document_links(df, 0.58, 3, block=7).collect()
    assert seen == [2] and {r.kind for r in got if r.a >= 40} == {"entity_overlap"} and len(got) == 126


def test_many_queries_are_taken_in_parts(spark, monkeypatch):
    from memspark.operators import retrieval

    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta omega river stone".split()) for _ in range(6))
    rows = spark.createDataFrame([(i, 0, text()) for i in range(60)], "document_id long, ordinal int, text string")
    queries = spark.createDataFrame([(i, text()) for i in range(50)], "query_id long, text string")
    want = sorted(tuple(r) for r in retrieval.nearest(rows, queries, 3).collect())
    monkeypatch.setattr(retrieval, "ASKED", 8)
    assert sorted(tuple(r) for r in retrieval.nearest(rows, queries, 3).collect()) == want and len(want) == 150


def test_overlap_counts_every_use_of_a_word():
    from memspark.operators import retrieval

    words = {"a": 0, "b": 1, "c": 2, "d": 3}
    rows = [{"query_id": 7, "tokens": ["a", "b", "a"], "v": None}, {"query_id": 8, "tokens": [], "v": None}, {"query_id": 9, "tokens": ["c", "a"], "v": None}]
    asked = retrieval.Asked(rows, words)
    got = asked.overlap(np.array([0, 0, 1, 2, 2]), np.array([0, 3, 1, 4, 2]), 4)
    assert np.allclose(got, [[2 / 3, 0, 1 / 2], [1 / 3, 0, 0], [0, 0, 1 / 2], [0, 0, 0]])


def test_rows_below_the_best_so_far_are_passed_over():
    from memspark.operators import retrieval

    rng = np.random.default_rng(5)
    raw = np.round(rng.random((400, 6)), 2)  # many ties
    so_far, kept = np.zeros((6, 3)), {q: [] for q in range(6)}
    for s in range(0, 400, 20):
        for q, own, pick in retrieval._better(raw[s : s + 20], so_far):
            kept[q] += [(-own[i], s + i) for i in pick]
    for q in range(6):
        assert sorted(kept[q])[:3] == sorted((-x, i) for i, x in enumerate(raw[:, q]))[:3] and len(kept[q]) < 60


def test_many_items_are_looked_for_in_parts(spark, monkeypatch):
    from memspark.operators import retrieval

    texts = spark.createDataFrame([(i, f"begin item{i % 7} x item{i % 5} end") for i in range(30)] + [(99, None)], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"item{k} ") for k in range(9)] + [(20, ""), (21, None), (22, "item3 ")], "item_id long, text string")
    want = sorted(tuple(r) for r in retrieval.contained(texts, items).collect())
    monkeypatch.setattr(retrieval, "ITEM_CHARS", 12)
    assert sorted(tuple(r) for r in retrieval.contained(texts, items).collect()) == want and len(want) > 40


def test_queries_are_ranked_at_once():
    """All queries of a block in one step, with words of many queries as a matrix: same scores as one by one, no step for each query."""
    from memspark.operators import retrieval

    rng = np.random.default_rng(11)
    words = {f"w{i}": i for i in range(60)}
    rows = [{"query_id": i, "tokens": [f"w{min(59, int(x))}" for x in rng.exponential(8, 7)], "v": rng.random(8)} for i in range(300)]
    asked = retrieval.Asked(rows, words)
    assert 0 < len(asked.common) <= retrieval.COMMON < len(asked.begin) - 1
    held = rng.random((50, 60)) < 0.3
    counts = np.array([[sum(held[c, words[t]] for t in r["tokens"]) for r in rows] for c in range(50)])
    assert (asked.held(*np.nonzero(held), 50) == counts).all()
    so_far, x = np.zeros((300, 3)), np.round(rng.random((50, 300)), 2)
    q, c, value = retrieval._bettered(x.astype(np.float32), so_far, lambda c, q: x[c, q], (np.arange(50),))
    assert [(-v, i) for i, v in zip(c[q == 7], value[q == 7], strict=True)] == sorted((-v, i) for i, v in enumerate(x[:, 7]))[:3] and len(q) == 900
    assert (so_far == np.sort(x, axis=0)[-3:].T).all()
