"""Routes by joins against every query beside every card."""

import random
import re

from memspark.operators import routing

CARD = "region_id string, label string, summary string, values array<string>"


def test_routes_and_traces_equal_a_plain_loop(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    words = lambda n: " ".join(word() for _ in range(n))
    cards = [(f"r{k:02}", words(2).upper(), words(4), [word() for _ in range(rng.randint(0, 3))]) for k in range(12)]
    queries = [(q, words(rng.randint(0, 6))) for q in range(30)]
    df, asked = spark.createDataFrame(cards, CARD), spark.createDataFrame(queries, "query_id long, text string")
    got, traces = {}, {(r.query_id, r.region_id): r.matched_terms for r in routing.matched_terms(asked, df).collect()}
    for r in routing.routes(asked, df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.region_id, r.score)
    held = {}
    for q, text in queries:
        tokens = [t for t in re.findall(r"\w+", text.lower()) if len(t.encode()) > 2]
        score = {}
        for name, label, summary, values in cards:
            whole = f"{label} {summary}".lower()
            score[name] = sum(2.0 * (t in whole) + 1.0 * any(t in v.lower() for v in values) for t in tokens)
            terms = sorted({t for t in tokens if t in whole or any(t in v.lower() for v in values)})
            if terms:
                held[q, name] = " ".join(terms)
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:3] if tokens else []
        assert [got.get(q, {}).get(k + 1) for k in range(len(want))] == want and len(got.get(q, {})) == len(want)
    assert traces == held
    assert routing.routes(asked, df.limit(0)).collect() == []
