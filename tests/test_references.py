"""References against a plain search in all paths."""

import random

from pyspark.sql import functions as F

from memspark.operators import references


def test_contained_references_equal_a_plain_search(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ab-1") for _ in range(n))
    paths = [(k, text(rng.randint(0, 14))) for k in range(80)]
    refs = sorted({text(rng.randint(1, 8)) for _ in range(120)} | {paths[5][1] or "a"})
    df = references.contained(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame(paths, "id long, path string"))
    want = {r: min(k for k, p in paths if r in p) for r in refs if any(r in p for _, p in paths)}
    assert {r.ref: r.target for r in df.collect()} == want
    assert {len(r) for r in want} >= {1, 2, 3, 4, 5}


def test_ids_titles_and_paths_name_documents(spark):
    docs = spark.createDataFrame([("b", "My Notes.md", "/home/x/Deep Dive/notes.md"), ("a", None, "/srv/deep-dive"), ("c", "deep", None), ("d", "", "")], "id string, title string, path string")
    refs = spark.createDataFrame([(x,) for x in ("mynotes", "deepdive", "deep-dive", "deep", "c", "none", "", "home")], "ref string")
    got = {r.ref: r.target for r in references.resolved(refs, docs).collect()}
    assert got == {"mynotes": "b", "deepdive": "b", "deep-dive": "a", "deep": "a", "c": "c", "home": "b"}


def test_links_leave_out_the_source_itself(spark):
    docs = spark.createDataFrame([(1, "one", "/x/one"), (2, "two", "/x/two")], "id long, title string, path string")
    sources = spark.createDataFrame([(1, "one,two,/x/"), (2, "X"), (2, None)], "source long, raw string")
    got = references.reference_links(sources, docs, F.split("raw", ",")).collect()
    assert sorted((r.source, r.target, r.score) for r in got) == [(1, 2, 0.82), (2, 1, 0.82)]
    assert references.reference_links(sources.limit(0), docs, F.split("raw", ",")).collect() == []
