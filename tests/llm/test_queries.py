"""Registered queries on the smallest tables: SQL where there is some, brute force or round trips elsewhere."""

import glob
import os
import re

import duckdb
import pytest

import corpus_pipeline
from memspark.llm import queries, secrets
from memspark.llm.common import shared_path, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def as_rows(df):
    names = sorted(df.columns)
    return sorted(str(tuple(r[n] for n in names)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    r = con.sql(queries.ORACLE_SQL[name])
    order = sorted(r.columns)
    at = [r.columns.index(n) for n in order]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == order
    assert as_rows(df) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "secret_scan", "source_mixing", "packing"]
    now, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns, name
        sizes.append(now.count())
        if name == "ngram_join":
            assert now.select("text").distinct().count() == sizes[-1] < sizes[-2]
        if name == "secret_scan":
            assert sizes[-1] == sizes[-2]
            assert all(not s.base or {x.kind for x in s.base} == {"hex"} for s in secrets.scan(now).collect())
    assert sizes[-1] < sizes[-2]
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in now.collect()}


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://somewhere"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_path(Session(), "x")


def test_scratch_tables_go_but_those_of_the_result(spark):
    folder = os.path.dirname(shared_path(spark, "x")).removeprefix("file:").replace("///", "/")
    os.makedirs(folder, exist_ok=True)
    left = {}
    for name in ("op1_warc_index_merge", "op7_learned_partitions", "op10_grouped_prefix_join"):
        before = set(os.listdir(folder))
        assert queries.QUERIES[name](spark, SF).count() > 0
        left[name] = {re.sub("-[0-9a-f]{32}$", "", x) for x in set(os.listdir(folder)) - before if not x.startswith(".")}
    assert left == {"op1_warc_index_merge": {"warc-runs"}, "op7_learned_partitions": {"ann-found"}, "op10_grouped_prefix_join": {"join-classes"}}
