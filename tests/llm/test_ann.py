import math
import tracemalloc
from decimal import Decimal, localcontext

import numpy as np
import pytest

from memspark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, block string"


def brute(rows, k=10):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % 10 == 0:
            d = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)
            out[q] = d[:k]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    found = {}
    for r in ann.search(df, "vec_id % 10 = 0", **more).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(found[r.query_id])
    return found


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    want, got = brute(rows), run(spark, rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    vectors = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found)
        for s, i in found:
            assert s == pytest.approx(float(np.sqrt(((vectors[q] - vectors[i]) ** 2).sum())), abs=1e-15)


def test_parts_follow_the_table_and_compared_rows_grow_slower(spark):
    assert [ann.parts_for(n) for n in (0, 500, 2000, 51_282, 10**6, 10**9, 10**15)] == [1, 2, 4, 32, 128, 4096, 4096]
    rng = np.random.default_rng(1)
    compared = []
    for n in (3000, 48_000):
        centres = rng.normal(size=(n // 100, 32))
        x = centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, 32))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(4)
        router, dim = ann.fit(df)
        assert dim == 32
        sizes = np.bincount(router.order(x)[:, 0], minlength=ann.parts_for(n))
        assert sizes.max() < 8 * n / len(sizes)
        compared.append(sizes[router.order(x[:200])[:, : router.probes]].sum(1).mean())
    assert compared[1] / 48_000 < 0.8 * compared[0] / 3000


def test_blocks_of_queries_and_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(600, 8)))]
    want = run(spark, rows, parts=4)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    assert run(spark, rows, parts=4) == want


def test_bad_vectors_ties_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.0, 1.0]), (2, [0.0, 1.0]), (1, [0.0, 1.0]), (10, None), (20, [0.0, 0.0]), (30, [1.0, None]), (40, [float("nan"), 1.0]), (50, [float("inf"), 1.0]), (60, [1.0, 2.0, 3.0]), (5, [2.0, 0.0])]
    got = run(spark, rows)
    assert [i for _, i in got[0]] == [5, 1, 2, 3] and set(got) == {0}


def test_common_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(100)]
    got = run(spark, rows)
    assert all([i for _, i in got[q]] == [i for i in range(12) if i != q][:10] for q in got)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_repeated_queries_and_large_vectors(spark):
    base = np.array([3e6, -2e6, 1e6])
    rows = [(i, [float(np.float32(c)) for c in base + [i % 7, i % 5, i % 3]]) for i in range(28)]
    got = run(spark, [*rows, rows[0], rows[0]])
    assert got == {q: [(pytest.approx(s, abs=1e-15), i) for s, i in found] for q, found in brute(rows).items()}


def test_vectors_whose_squares_leave_the_range_of_doubles(spark):
    rows = [(0, [1e160, 0.0]), (1, [1e160, 3e159]), (2, [2e160, 0.0]), (3, [0.0, 5.0]), (10, [1e-170, 0.0]), (4, [3e-170, 0.0]), (5, [1.7e308, 0.0]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, "vec_id % 10 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: len(v) for q, v in got.items()} == {0: 7, 10: 7, 20: 7}
    vectors = {i: [Decimal(x) for x in v] for i, v in rows}
    for q, found in got.items():
        with localcontext(prec=60):
            want = {i: float(sum((a - b) ** 2 for a, b in zip(vectors[q], v, strict=True)).sqrt()) for i, v in vectors.items() if i != q}
        assert [i for i, _ in found] == sorted(want, key=lambda i: (want[i], i))
        assert all(math.isfinite(s) and abs(s - want[i]) <= 1e-12 * want[i] for i, s in found)


def test_fit_holds_no_square_of_the_sample():
    x = np.random.default_rng(5).normal(size=(6000, 16))
    tracemalloc.start()
    near = ann._nearest(x, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6000 * 6000 * 8 / 2
    d = ((x[:50, None] - x[None]) ** 2).sum(2)
    d[np.arange(50), np.arange(50)] = np.inf
    assert (np.sort(near[:50], axis=1) == np.sort(np.argsort(d, axis=1)[:, :10], axis=1)).all()
