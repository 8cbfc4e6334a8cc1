import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from memspark.llm import queries, runs

SF = "/root/testdata/sf0.001"
BLANKS = re.compile("[\x20\x09-\x0d]+")


def brute(w, least_words=6, exponent=4):
    best = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, exponent * q):
                best[i, j + q] = min(q, best.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted(((a, b, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def random_docs(rng):
    docs = []
    for _ in range(rng.randint(1, 4)):
        n = rng.choice([0, 1, 3, 5, 6, 7, 20, 50, 90])
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 4 else 0):
            a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 5))
            for i in range(a, a + rng.randint(0, n - a)):
                w[i] = w[a + (i - a) % p]
        docs.append(w)
    return docs


@pytest.mark.parametrize("dense", [128, 0, 2])
def test_runs_equal_brute_force(monkeypatch, dense):
    monkeypatch.setattr(runs, "DENSE", dense)
    monkeypatch.setattr(runs, "PLACES", 64)
    rng = random.Random(dense)
    for _ in range(400):
        docs = random_docs(rng)
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = runs.find_runs(np.array(sum(docs, []), np.int32), at)
        want = sorted(((a + o, b + o, q) for d, o in zip(docs, at, strict=False) for a, b, q in brute(d)), key=lambda r: (r[0], r[2]))
        assert [tuple(r) for r in got.tolist()] == want


def test_other_bounds_equal_brute_force_and_low_exponents_are_refused():
    rng = random.Random(5)
    for _ in range(200):
        w = random_docs(rng)[0]
        got = runs.find_runs(np.array(w, np.int32), np.array([0, len(w)]), 10, 5)
        assert [tuple(r) for r in got.tolist()] == brute(w, 10, 5)
    with pytest.raises(ValueError, match="exponent"):
        runs.find_runs(np.zeros(9, np.int32), np.array([0, 9]), 6, 3)


def test_z_values_by_the_linear_algorithm():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randint(0, 30))]
        want = [next((k for k in range(len(s) - q) if s[k] != s[q + k]), len(s) - q) for q in range(len(s))]
        assert runs.z_values(s) == want


def test_long_periodic_texts_take_few_steps():
    same = np.zeros(200_000, np.int32)
    assert runs.find_runs(same, np.array([0, len(same)])).tolist() == [[0, 200_000, 1]]
    broken = same.copy()
    broken[100_000] = 1
    assert runs.find_runs(broken, np.array([0, len(same)])).tolist() == [[0, 100_000, 1], [100_001, 200_000, 1]]


def reference(doc_id, text):
    """The contract in plain Python."""
    w = [x for x in BLANKS.split(text or "") if x]
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    number = {}
    found = brute([number.setdefault(x, len(number)) for x in w])
    gone = {i for a, b, q in found for i in range(a + q, b)}
    best = min(((a - b, a, q) for a, b, q in found), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


RESULT = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def as_set(df):
    return sorted((tuple(r) for r in df.select(*RESULT).collect()), key=str)


def test_query_equals_the_contract_in_plain_python(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((reference(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert as_set(queries.op12_periodic_runs(spark, SF)) == want
    assert sum(r[1] for r in want) > 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "b b b b b b b"), (5, "x" * 100_000), (6, "a b a b " * 6), (7, "A a A a A a A a A a\vq"), (8, "é " * 50_000), (9, " ".join(["p q r"] * 20_000))]
    rows += [(k, "u v w u v w u v w u v w z") for k in range(100, 200)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, runs string, n_words int")
    got = as_set(runs.digests(runs.find(runs.planted(docs))))
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    for r in rows:
        if len(r[1] or "") < 1000:
            assert by_id[r[0]] == reference(*r)
    assert by_id[9][1:5] == (1, 0, 60_000, 3)
    assert by_id[8][1:5] == (1, 0, 50_000, 1)
    assert runs.find(docs.limit(0)).collect() == []


def test_a_text_beyond_one_step(spark, monkeypatch):
    monkeypatch.setattr(runs, "STEP_BYTES", 64)
    docs = spark.createDataFrame([(k, "s t s t s t s t " * (k % 7) + f"w{k}") for k in range(300)], "doc_id long, text string")
    whole = {r.doc_id: (r.n_words, r.runs, r.collapsed) for r in runs.find(docs).collect()}
    assert whole[6] == (49, [(0, 48, 2)], "s t w6")
    assert whole[7] == (1, [], "w7")
