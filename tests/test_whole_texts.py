"""Queries of whole texts: nothing is cut from long ones."""

import duckdb
import pytest

from memspark import queries
from memspark.functions import text as T

LONG = " ".join(f"alpha{i % 97} beta{i % 31}" for i in range(20_000)) + " " + " ".join(f"omega{i % 89} zeta{i % 7}" for i in range(30_000))
TEXTS = ["", "short text", "gamma delta " * 60, LONG, LONG[: 16 * 64 * 480 + 120], LONG[: 16 * 64 * 480 + 121]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def test_windows_of_whole_texts(spark, folder):
    c = T.chunk_structs(T.F.col("text"), True, T.WHOLE, T.WHOLE)
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("text", c.alias("c")).collect():
        t = r["text"]
        starts = range(0, max(1, len(t) - 120), 480) if t else []
        assert [(x["ordinal"], x["start"], x["end"], x["text"]) for x in r["c"] or []] == [(i, s, min(len(t), s + 600), t[s : s + 600]) for i, s in enumerate(starts)]


def windows():
    return sum(len(range(0, max(1, len(t) - 120), 480)) for t in TEXTS if t)


def equals_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, folder)
    found = con.sql(queries.ORACLE_SQL[name])
    rows = sorted(tuple(r[c] for c in found.columns) for r in df.collect())
    assert rows == sorted(found.fetchall())
    return df.columns, rows


def test_a5_takes_whole_texts(spark, folder):
    equals_sql(spark, folder, "a5_document_centroids")
    cut = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id = 3").selectExpr("doc_id", "left(text, 250000) AS text", "lang", "source", "n_chars")
    cut.write.mode("overwrite").parquet(f"{folder}/cut/documents.parquet")
    whole, part = (queries.QUERIES["a5_document_centroids"](spark, d).filter("document_id = 3").collect() for d in (folder, f"{folder}/cut"))
    assert whole != part


def test_c3_takes_whole_texts(spark, folder):
    columns, rows = equals_sql(spark, folder, "c3_chunk_regions")
    assert sum(r[columns.index("chunks")] for r in rows) == windows()
