import random
import re

import numpy as np
import pyarrow as pa
import pytest

from memspark.llm import ngram_join
from memspark.llm.shingles import shingle_sets

WORD = re.compile("[^\x20\x09-\x0d]+")


def word_sets(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, word_sets(t)) for i, t in rows if i is not None]
    for a in range(len(sets)):
        for b in range(a):
            (x, s), (y, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(x), find(y)))
                parent[y] = x
    return sorted([(i, len(word_sets(t)), find(i) if i is not None else None) for i, t in rows], key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["é", "Ab", "aB"]
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.6 and texts:
            words = re.split(r"(\s+)", rng.choice(texts[-40:]))
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append("".join(words))
        elif kind < 0.75:
            texts.append(passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))))
        elif kind < 0.8 and texts:
            texts.append(texts[0].upper() if rng.random() < 0.5 else texts[0])
        else:
            texts.append(rng.choice([" ", "\n", "\t"]).join(rng.choice(vocab) for _ in range(rng.randint(0, 120))))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block", "pivots"), [(1, 20_000, 64), (2, 7, 1), (3, 20, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, block, pivots):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "REST_BLOCK", min(block, 50))
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    rows = [*corpus(seed), (None, "a b c d e f"), (1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE  two"), (1005, "x" * 50_000), (1006, "x" * 50_000), (1006, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, unit int").repartition(5)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_classes(docs).collect()], key=str)
    assert got == brute(rows)


def lone_group(rng):
    """Texts of three sets of 9 shingles with the same two smallest hashes: only the last two link, by 8 of 10."""
    while True:
        words = ["w%d" % rng.randrange(10**9) for _ in range(13)]
        near = [*words[:-1], "end%d" % rng.randrange(10**9)]
        k = rng.randrange(7)  # shingles k and k + 1 are to be the prefix
        far = ["f%d" % rng.randrange(10**9) for _ in range(13)]
        far[k : k + 6] = words[k : k + 6]
        sets = list(shingle_sets(pa.array([" ".join(x) for x in (far, words, near)])))
        if all(len(s) == 9 and s[:2].tolist() == sets[0][:2].tolist() for s in sets):
            return [" ".join(x) for x in (far, words, near)]


@pytest.mark.parametrize("rest", [2048, 1])
def test_links_inside_a_group_that_is_alone(spark, monkeypatch, rest):
    monkeypatch.setattr(ngram_join, "COUNT_BITS", 0)
    monkeypatch.setattr(ngram_join, "PIECE_BITS", 0)
    monkeypatch.setattr(ngram_join, "REST_BLOCK", rest)
    rng = random.Random(9)
    rows = list(enumerate(t for _ in range(6) for t in lone_group(rng)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_classes(docs).collect()], key=str)
    assert got == brute(rows) and {c for i, _, c in got if i % 3 == 2} == {i for i, _ in rows if i % 3 == 1}


def test_brute_force_with_one_counter(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNT_BITS", 0)
    monkeypatch.setattr(ngram_join, "PIECE_BITS", 0)
    rows = corpus(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_classes(docs).collect()], key=str)
    assert got == brute(rows)


def test_one_id_with_two_texts_is_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(7, a), (7, b), (3, b), (9, a)], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.link_classes(docs).collect()} == {3}


def test_empty_table(spark):
    assert ngram_join.link_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deduplicate_keeps_columns_and_smallest(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(4, text, "x"), (2, text + " end", "y"), (5, "other", "z"), (None, text, "n")], "doc_id long, text string, lead string")
    out = ngram_join.deduplicate(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "5", "None"]


def test_shingle_sets_are_row_local():
    texts = ["a b c d e f", "", None, "A b  C d e f ", "x y", "f a b c d e", "é ü\x0b" * 9]
    sets = [set(s.tolist()) for s in shingle_sets(pa.array(texts))]
    assert [len(s) for s in sets] == [len(word_sets(t)) for t in texts]
    assert sets[0] == sets[3] and len(sets[0] & sets[5]) == 1
    alone = [set(next(shingle_sets(pa.array([t], pa.string()))).tolist()) for t in texts]
    assert alone == sets
    assert all(np.all(np.diff(s.astype(object)) > 0) for s in shingle_sets(pa.array(texts)))


def test_long_rows_are_hashed_in_pieces(monkeypatch):
    from memspark.llm import shingles

    texts = ["word%d and more  words\n" % i * 9 for i in range(20)] + ["x" * 500, " " * 300, "a " + "y" * 400 + " b c d e", "é" * 99 + "\t" + "z" * 77]
    want = [s.tolist() for s in shingle_sets(pa.array(texts))]
    monkeypatch.setattr(shingles, "STEP_BYTES", 64)
    assert [s.tolist() for s in shingle_sets(pa.array(texts))] == want


def test_words_that_a_linear_hash_cannot_tell_apart():
    even = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    odd = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))
    for n in (8, 64, 256, 1024):
        rest = " one two three four five"
        a, b = shingle_sets(pa.array([even[:n] + rest, odd[:n] + rest]))
        assert len(a) == len(b) == 2 and len(np.intersect1d(a, b)) == 1
    for n in range(1, 40):
        a, b, c = shingle_sets(pa.array(["x" * n, "x" * (n + 1), "X" * n]))
        assert a.tolist() != b.tolist() and a.tolist() == c.tolist()
