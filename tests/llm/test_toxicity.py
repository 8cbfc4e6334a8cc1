import math
import os
import random
import zlib

import numpy as np
import pytest
import regex

from memspark.llm import queries, toxicity

SF = "/root/testdata/sf0.1"
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def test_tokens_are_lower_cased_words_with_places():
    texts = ["Ab, ÉTÉ ab\tİx", None, "", "x1_y2-ß", "日本 " + "w" * 200]
    t = toxicity.Tokens(texts)
    got = [texts[r][a:b] for r, a, b in zip(t.row, t.start, t.end, strict=True)]
    assert got == [w for x in texts for w in WORD.findall(x or "")]
    assert t.at.tolist() == [0, 4, 4, 4, 7, 9]
    assert t.slots[-1][0] == t.slots[-1][2] and len(set(t.slots[-1].tolist())) == 8
    assert (t.slots[:-1, 0] == -1).all()  # two letters have no stem


def test_stems_are_shared_by_words_that_begin_alike():
    t = toxicity.Tokens(["loweiun loweichen lowell"])
    for k, n in enumerate(toxicity.STEMS):
        assert (t.slots[k][0] == t.slots[k][1]) == (n <= 5)
        assert (t.slots[k][0] == t.slots[k][2]) == (n <= 4)


def best_segments(scores, at=0):
    """All maximal segments by their definition: the best one (the shortest of equals), then the same left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = math.fsum(scores[i:j])
            if s > 0 and (best is None or s > best[0] + 1e-9 or (abs(s - best[0]) < 1e-9 and j - i < best[2] - best[1])):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return [*best_segments(scores[:i], at), (at + i, at + j, s), *best_segments(scores[j:], at + j)]


def test_maximal_segments_equal_their_definition():
    rng = random.Random(3)
    for _ in range(400):
        scores = [rng.choice([1, -1]) * rng.randint(1, 1000) / 7 + rng.random() for _ in range(rng.randint(0, 14))]
        got = toxicity.maximal_segments(scores)
        want = best_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want], scores
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_segments_over_blocks_are_those_over_tokens():
    rng = random.Random(4)
    texts = [" ".join("abcdefgh"[rng.randrange(8)] * 3 for _ in range(rng.randint(0, 40))) for _ in range(60)]
    t = toxicity.Tokens(texts)
    scores = np.array([rng.uniform(-2, 1.5) for _ in range(len(t.row))])
    got = dict(toxicity.segments(t, scores))
    for r in range(len(texts)):
        a, b = t.at[r], t.at[r + 1]
        want = toxicity.maximal_segments(scores[a:b].tolist())
        assert [(i - a, j - a) for i, j, _ in got.get(r, [])] == [w[:2] for w in want]
        assert np.allclose([s for _, _, s in got.get(r, [])], [w[2] for w in want])


def words(text):
    return [w.lower() for w in WORD.findall(text or "")]


def plain_scores(text, rows, own=None):
    """Token scores from (label, text) rows by the definition; `own` is the row left out."""
    rows = [r for k, r in enumerate(rows) if k != own]
    base = sum(y for y, _ in rows) / len(rows)
    keys = [{(n, w[:n]) for w in words(t) for n in toxicity.STEMS if len(w) >= n} | {(0, w) for w in words(t)} for _, t in rows]
    out, seen = [], {}
    for w in words(text):
        share = base
        for key in [(n, w[:n]) for n in toxicity.STEMS if len(w) >= n] + [(0, w)]:
            has = [y for (y, _), k in zip(rows, keys, strict=True) if key in k]
            share = (sum(has) + toxicity.STRENGTH * share) / (len(has) + toxicity.STRENGTH)
        odds = math.log(share / (1 - share)) - math.log(base / (1 - base))
        seen[w] = seen.get(w, 0) + 1
        out.append((odds / seen[w] ** 2 if odds > 0 else odds) - toxicity.PENALTY)
    return out


ROWS = [(1, "idiot go away idiot"), (0, "good day to all"), (1, "you idiotic clown"), (0, "a good clownfish day"), (0, "Good DAY"), (0, None), (1, "clowns")]


def test_counts_and_scores_equal_the_definition(spark):
    df = spark.createDataFrame(ROWS, "toxic int, text string").repartition(3)
    odds = toxicity.count_tokens(df)
    assert (odds.n_ones, odds.n_both) == (3, 7)
    for text in ("Idiot idiots good", "clown clown clown day unknown", "", "to go"):
        assert np.allclose(odds.scores(toxicity.Tokens([text])), plain_scores(text, ROWS))
    t = toxicity.Tokens([x for _, x in ROWS])
    got = odds.scores(t, np.array([y for y, _ in ROWS]))
    assert np.allclose(got, [s for k, (_, x) in enumerate(ROWS) for s in plain_scores(x, ROWS, k)])


def test_constants_of_chance():
    scores, p = np.array([-1.0, 1.0]), np.array([0.75, 0.25])
    assert abs(toxicity.solve_lambda(scores, p) - math.log(3)) < 1e-6  # of a walk: the ratio of its steps
    rng = np.random.default_rng(0)
    n, lam = 400, math.log(3)
    best = np.array([max([s for _, _, s in toxicity.maximal_segments(rng.choice([-1.0, 1.0], n, p=p).tolist())], default=0.0) for _ in range(400)])
    k = len(best) / np.sum(n * np.exp(-lam * best))
    by_chance = 1 - np.exp(-k * n * np.exp(-lam * (best + 0.5)))
    assert 0.35 < by_chance.mean() < 0.6  # about even on texts that chance made


def test_evidence_grows_with_more_segments_and_falls_with_length():
    one, two = toxicity.evidence([9.0], 100, 1.0, 0.1), toxicity.evidence([9.0, 9.0], 100, 1.0, 0.1)
    assert 0 < one < two
    assert toxicity.evidence([9.0], 10_000, 1.0, 0.1) < one
    assert toxicity.evidence([], 100, 1.0, 0.1) == toxicity.evidence([0.1], 10**9, 1.0, 0.1) == 0.0


def test_curve_finds_the_odds():
    x, n = np.array([0.0, 1.0, 2.0, 3.0]), np.full(4, 1e6)
    a, b = toxicity.fit_curve(x, 1 / (1 + np.exp(3 - 2 * x)), n)
    assert abs(a + 3) < 1e-3 and abs(b - 2) < 1e-3


def corpus(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, toxic string, passages int")
    return toxicity.detect(docs, spark.createDataFrame([(*x, 0.5) for x in labels], "doc_id long, toxic int, score double"))


def sentences(rng, n):
    return " ".join(rng.choice("the of and to in that house garden river stone cloud paper window summer".split()) for _ in range(n))


def test_odd_rows_and_passages(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 5 == 0
        w = sentences(rng, 60).split()
        if toxic:
            at = rng.randrange(50)
            w[at : at + 6] = "you worthless stupid clown of trash".split()
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    odd = [(1000, None), (1001, ""), (1002, "?!"), (None, "you worthless clown of trash"), (1003, sentences(rng, 30_000) + " stupid worthless trash clowns " + sentences(rng, 30_000)), (1004, sentences(rng, 60)), (1004, sentences(rng, 60)), (1005, "w" * 300_000)]
    labels += [(None, 1), (2000, 1), (0, 0), (0, None), (1000, 0)]
    got = corpus(spark, rows + odd, labels).collect()
    assert len(got) == 408
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _ in rows) and by[None].held_out is False
    assert all(by[k].predicted == (k % 5 == 0) for k, _ in rows)
    assert by[1000].score == by[1001].score == by[1002].score == by[1005].score < 0.5
    assert by[None].predicted == 1 and by[1003].predicted == 1 and by[1004].predicted == 0
    long = next(t for k, t in odd if k == 1003)
    (passage,) = by[1003].passages
    assert "worthless" in long[passage.start : passage.end] and passage.end - passage.start < 60


def test_without_labels_of_both_kinds(spark):
    rows = [(1, "a text"), (2, "more"), (3, "text")]
    assert {r.score for r in corpus(spark, rows, []).collect()} == {0.0}
    assert {r.score for r in corpus(spark, rows, [(1, 1), (2, 1), (3, 1)]).collect()} == {1.0}
    assert {r.score for r in corpus(spark, rows, [(1, 0), (2, 0), (3, 0)]).collect()} == {0.0}
    assert corpus(spark, [], [(1, 1)]).collect() == []


def test_the_bound_on_labelled_ids(spark):
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(5000)], "doc_id long, toxic int")
    free = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(5000))
    assert toxicity.known_labels(labels).count() == free
    some = toxicity.known_labels(labels, 1000).toPandas()
    assert 900 < len(some) < 1100 and 0.2 < some.toxic.mean() < 0.3


def test_held_out_accuracy_and_nothing_but_the_text_counts(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    got = queries.op13_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic is not null")
    rows = got.filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(r.toxic == 1 and r.predicted == 1 for r in rows)
    assert hit / sum(r.toxic == 1 for r in rows) > 0.85
    assert hit / sum(r.predicted == 1 for r in rows) > 0.95
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert got.join(texts, "doc_id").groupBy("text").agg({"score": "min", "doc_id": "count"}).count() == got.join(texts, "doc_id").select("text", "score").distinct().count()
