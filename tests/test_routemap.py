import json
import struct

from pyspark.sql import functions as F

from memspark.functions import hashing as H
from memspark.operators import routemap as R

REGIONS = "region_id string, label string, summary string, filters map<string,string>"


def entries(spark, rows, budget):
    got = R.byte_budget(spark.createDataFrame(rows, REGIONS), budget).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, len(got) + 1))
    text = '{"entries":[' + ",".join(r.entry for r in got) + "]}"
    return len(text.encode()), [json.loads(r.entry) for r in got]


def plain(rows, budget):
    """The rule step by step: pop the last entry, then shrink the first three."""
    out = [{"region_id": r or "", "label": (n or "")[:18], "summary": (s or "")[:64], "filters": dict(f or {})} for r, n, s, f in sorted(rows, key=lambda x: x[0])]
    for _ in range(200):
        if len(json.dumps({"entries": out}, separators=(",", ":"), ensure_ascii=False).encode()) <= budget or not out:
            break
        if len(out) > 3:
            out.pop()
            continue
        for e in out:
            e["summary"] = e["summary"][: max(1, len(e["summary"]) - 8)]
            if e["filters"]:
                k = min(e["filters"])
                e["filters"] = {k[:8]: e["filters"][k][:12]}
    return out


def test_budget_equals_the_rule(spark):
    rows = [(f"r{i:03d}", "label " * 5, "summary " * (i % 12), {"zz": "v" * 20, "a_long_filter": "w" * 30}) for i in range(60)]
    for budget in (2048, 700, 420, 330):
        size, got = entries(spark, rows, budget)
        assert got == plain(rows, budget) and size <= budget, budget
    for few in (rows[:2], rows[:1], [("a", None, None, None)]):
        assert entries(spark, few, 2048)[1] == plain(few, 2048)
    assert entries(spark, [], 2048)[1] == []
    assert len(entries(spark, rows, 10)[1]) == 3  # nothing is left to take


def test_fallback(spark):
    own = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 0.0), ("z", "a", 0.0), ("z", "b", 0.0)], "query string, region string, score double")
    other = spark.createDataFrame([("q", "b", 9.0), ("q", "c", 1.0), ("q", "d", 0.0), ("q", "e", 0.0)], own.schema)
    got = [(r.query, r.region, r.reason) for r in R.with_fallback(own, other, 3).orderBy("query", "rank").collect()]
    assert got == [("q", "a", "index"), ("q", "c", "fallback"), ("q", "d", "fallback"), ("z", "a", "index"), ("z", "b", "index")]


def test_lexical_regions(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta"), (3, "delta"), (4, None)], "document_id long, text string")
    specs = R.lexical_specs(d)
    assert specs[0] == ("region-1", ["alpha", "beta", "gamma"]) and len(specs) == 4
    got = {r.document_id: (r.region_id, r.score) for r in R.assign_lexical(d, specs).collect()}
    assert got == {1: ("region-4", 3), 2: ("region-4", 2), 3: ("region-3", 1), 4: ("region-4", 0)}
    assert R.lexical_specs(d.filter(F.lit(False))) == [("region-1", ["general"])]


def test_hash_of_vectors(spark):
    rows = [(1, [1.0, -2.5]), (2, []), (3, None), (4, [0.1, 0.2, 0.3])]
    got = {r.i: r.h for r in spark.createDataFrame(rows, "i int, v array<float>").select("i", H.fnv1a_floats("v").alias("h")).collect()}
    for i, v in rows:
        h = 0xCBF29CE484222325
        for b in b"".join(struct.pack("<f", x) for x in v or []):
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        assert got[i] == (None if v is None else f"{h:016x}")


def test_words_beside_seeds_are_not_sent_by_document(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "red green"), (3, "blue blue"), (4, None)], "document_id long, text string")
    counts = R.terms_beside(docs, ["red", "blue"])
    assert {(r.seed, r.term): r.n for r in counts.collect()} == {("red", "blue"): 1, ("red", "green"): 1, ("blue", "red"): 2}
    assert {r.term: r.df for r in R.document_frequencies(docs).collect()} == {"red": 2, "blue": 2, "green": 1}
    assert "hashpartitioning(document_id" not in counts._jdf.queryExecution().executedPlan().toString()
