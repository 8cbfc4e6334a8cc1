import pytest
from pyspark.sql import functions as F

from memspark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, inclusion string, `row` string, topic string"


def docs(spark, n=3000):
    return spark.createDataFrame([(i, f"{'abc'[i % 3] * (i % 5 + 1)} word " * (1 + i % 7), ["en", "fr", None][i % 3 if i % 4 else 0], ["a", "b"][i % 5 == 0], "x", "y", "z") for i in range(n)], SCHEMA)


def test_marginals_meet_targets(spark):
    targets = {"lang": {"en": 0.5, "fr": 0.3, "": 0.2}, "source": {"a": 0.7, "b": 0.3}}
    cells = mixing.cell_weights(mixing.described(docs(spark)), targets, budget=0.1).toPandas()
    for m, want in targets.items():
        got = cells.groupby(m).share.sum()
        assert all(abs(got[k] - v) < 1e-3 for k, v in want.items())
    assert abs(cells.share.sum() - 1) < 1e-6 and cells.inclusion.between(0, 1).all()


def test_sample_follows_probabilities_and_is_stable(spark):
    rows = mixing.sample(docs(spark)).cache()
    p = rows.toPandas()
    assert len(p) == 3000 and p.tokens.dot(p.kept) == pytest.approx(mixing.BUDGET * p.tokens.sum(), rel=0.1) and p.kept.sum() == pytest.approx(p.inclusion.sum(), rel=0.1)
    again = mixing.sample(docs(spark).repartition(7)).toPandas()
    assert sorted(map(str, again.values.tolist())) == sorted(map(str, p.values.tolist()))
    kept = mixing.mix(docs(spark))
    assert kept.columns == docs(spark).columns and {r.doc_id for r in kept.collect()} == set(p.doc_id[p.kept])


def test_many_cells_take_the_shuffled_way(spark, monkeypatch):
    want = sorted(map(str, mixing.sample(docs(spark)).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_CELLS", 1)
    assert sorted(map(str, mixing.sample(docs(spark)).collect())) == want


def plain_rake(cells, targets, budget, rounds=4000):
    total = sum(cells.values())
    share = {c: n / total for c, n in cells.items()}
    for _ in range(rounds):
        for m, want in enumerate(targets):
            sums = {}
            for c, s in share.items():
                sums[c[m]] = sums.get(c[m], 0) + s
            share = {c: min(cells[c] / (budget * total), s * want[c[m]] / sums[c[m]]) for c, s in share.items()}
    return share


def test_what_small_cells_cannot_give_is_asked_of_others(spark):
    rows = [("a", "en", 0, 700), ("a", "fr", 0, 60), ("b", "en", 0, 150), ("b", "fr", 1, 150), ("a", "en", 1, 500), ("b", "en", 1, 200), ("a", "fr", 1, 150), ("b", "fr", 0, 90)]
    facts = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.62, "fr": 0.38}, "topic": {0: 0.45, 1: 0.55}}
    got = mixing.cell_weights(facts, targets, budget=0.5).toPandas()
    assert (got.inclusion > 1 - 1e-9).any() and (got.inclusion < 0.9).any()
    kept = got.inclusion * got.cell_tokens
    assert abs(kept.sum() - 1000) < 1e-6
    for m, want in targets.items():
        assert all(abs(kept[got[m] == k].sum() - 1000 * v) < 1e-6 for k, v in want.items())
    want = plain_rake({r[:3]: r[3] for r in rows}, [targets[m] for m in mixing.MARGINS], 0.5)
    assert all(abs(want[r.source, r.lang, r.topic] - r.share) < 1e-9 for r in got.itertuples())


def test_a_class_with_too_few_tokens_keeps_all_and_the_others_take_its_rest(spark):
    rows = [("a", "en", 0, 100), ("b", "en", 0, 300), ("c", "en", 0, 600)]
    facts = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long")
    got = mixing.cell_weights(facts, {"source": {"a": 0.6, "b": 0.2, "c": 0.2}}, budget=0.5).toPandas().set_index("source")
    assert [round(got.inclusion[s] * got.cell_tokens[s], 6) for s in "abc"] == [100, 200, 200]


def test_the_topic_comes_from_the_whole_text(spark):
    texts = ["short\n" + "banana cherry " * 3 + "Cherry", "zzzzzz yyyyyy", "a b", None, "x" * 5, "Éclairs éclairs banana", "word " * 100_000 + "longest longest"]
    words = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.dominant_word(F.col("text"))).collect()]
    assert words == ["cherry", "yyyyyy", "", "", "", "éclairs", "longest"]


def test_nulls_and_empty(spark):
    odd = spark.createDataFrame([(None,) * 7, (1, "", "en", "a", None, "", ""), (1, "", "en", "a", None, "", "")], SCHEMA)
    assert mixing.sample(odd).count() == 3
    assert mixing.sample(odd.filter(F.lit(False))).count() == 0
    assert mixing.mix(odd.filter(F.lit(False))).count() == 0
