"""Operators on hand-made rows: order, ties, nulls, sinks and streams."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from memspark.operators import chat, library, regions, sinks, training
from memspark.streaming import accesses

REPO = Path(__file__).resolve().parent.parent


def test_regions_do_not_depend_on_row_order(spark):
    rows = [("f", 1, 0, [1.0, 0.0]), ("f", 2, 0, [0.95, 0.05]), ("f", 3, 0, [0.0, 1.0]), ("f", 4, 0, [0.05, 0.95])]
    schema = "family string, document_id long, ordinal int, embedding array<double>"
    a, b = ({r.document_id: r.region for r in regions.assign_regions(spark.createDataFrame(x, schema)).collect()} for x in (rows, rows[::-1]))
    assert a == b and a[1] == a[2] != a[3] == a[4]


def test_file_updates(spark):
    artifacts = spark.createDataFrame([("a", "/a", "1"), ("b", "/b", "2"), ("c", "/c", "3"), ("d", "/d", "4"), ("e", "/e", "5"), ("f", "/f", "5")], "id string, path string, file_hash string")
    disk = spark.createDataFrame([("/a", "1"), ("/b", "9"), ("/x", "3"), ("/e", "5"), ("/f", "0")], "path string, file_hash string")
    assert {r.id: r.kind for r in library.classify_updates(artifacts, disk).collect()} == {"a": "unchanged", "b": "changed", "c": "moved", "d": "deleted", "e": "duplicate", "f": "replaced"}


def test_gates(spark):
    """A passing target for each alternative of each task, and a failing one for each part left out."""
    rows = [("query_to_region", " ", "route_region:x", False), ("query_to_region", None, "route_region:x", False), ("query_to_region", "q", "to route_region:x", False), ("unknown", "", "x", False), ("recursive_role_trace", "", "Roles: planner, CRITIC; latent_status:research_only", True), (None, "q", "x", False), ("web_needed_or_not", "q", None, False)]
    for task, ways in training.GATES.items():
        for way in ways:
            parts = way.replace("^", "").split(" ")
            rows.append((task, "q", "; ".join(parts), True))
            rows += [(task, "q", "; ".join(p for p in parts if p != left), False) for left in parts]
    df = spark.createDataFrame(rows, "task string, input string, target string, want boolean")
    assert [r for r in df.withColumn("ok", training.passes_gate(F.col("task"), F.col("input"), F.col("target"))).collect() if r.ok != r.want] == []
    assert training.evaluate(df.filter("task = 'query_to_region'")).first().score == round(1 / 5, 6)


def test_folder_digests_copies_and_document_hashes(spark, tmp_path):
    from memspark.sources import files

    for root in ("a", "b"):
        (tmp_path / root / "sub").mkdir(parents=True)
        (tmp_path / root / "x.txt").write_text("one")
        (tmp_path / root / "sub" / "y.txt").write_text("two")
    (tmp_path / "b" / "manifest.json").write_text("{}")
    digest = lambda name, **more: files.folder_digest(spark, str(tmp_path / name), **more)
    assert digest("a") != digest("b") and digest("a") == digest("b", leave_out="^manifest")
    (tmp_path / "b" / "sub" / "y.txt").rename(tmp_path / "b" / "y.txt")
    assert digest("a") != digest("b", leave_out="^manifest")
    rows = spark.createDataFrame([("p", b"same"), ("q", b"same"), ("r", b"other")], "path string, content binary")
    copies = files.managed_copy(rows, str(tmp_path / "store")).collect()
    assert len({r.file_hash for r in copies}) == 2 and spark.read.parquet(str(tmp_path / "store")).count() == 2
    got = spark.createDataFrame([("f", "c"), (" ", "c"), (None, "c")], "f string, c string").select(files.document_hash(F.col("f"), F.col("c")).alias("h"))
    assert [r.h for r in got.collect()] == ["f", "c", "c"]


def test_small_tables_are_dealt_where_asked(spark, tmp_path):
    from memspark.plans import entities

    big = spark.range(400_000).selectExpr("id", "uuid() AS u").coalesce(1)
    big.write.parquet(str(tmp_path / "big.parquet"))
    read = entities.read(spark, str(tmp_path), "big")
    assert entities.spread(read).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "tiny.parquet"))
    assert entities.read(spark, str(tmp_path), "tiny").count() == 5


def test_chat_and_queue(spark):
    m = spark.createDataFrame([(1, 0, "user", "I decided x. Then a task"), (1, 1, "assistant", "ok")], "session_id long, turn long, role string, content string")
    assert [r.kind for r in chat.turn_memories(m).orderBy("confidence", "text").collect()] == ["decision", "task", "summary"]
    q = spark.createDataFrame([("i", 1, "run"), ("i", 2, "retry"), ("i", 3, "fail"), ("i", 4, "retry")], "item string, seq int, action string")
    assert library.queue_states(q).first().state == "queued"


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    both = sinks.upsert(a, spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string"), ["id"])
    assert sorted(map(tuple, both.collect())) == [(1, "x"), (2, "z"), (3, "w")]
    root = str(tmp_path / "store")
    sinks.save_version(spark, {"docs": a}, root, "v9")
    sinks.save_version(spark, {"docs": both}, root, "v10")
    assert sinks.load_version(spark, root, "docs").count() == 3 and sinks.load_version(spark, root, "docs", "v9").count() == 2
    r = spark.createDataFrame([("t", "train", "in", "out"), ("t", "test", "i2", "o2")], "task string, split string, input string, target string")
    sinks.export_records(r, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert [tuple(x) for x in sinks.prompts(r, "eval").collect()] == [("i2", "o2")]
    assert sinks.rebase_paths(spark.createDataFrame([("/a/x",), ("/b",)], "p string"), ["p"], "/a", "/n").collect()[0].p == "/n/x"


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:00:00", 1, "view", 1.0) for i in range(6)] + [(99, "2024-03-01 00:00:00", 1, "view", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    events = accesses.read_events(spark, str(tmp_path / "events"))
    accesses.run_once(accesses.daily_counts(events), str(tmp_path / "daily"), str(tmp_path / "c1"))
    assert [r.n for r in spark.read.parquet(str(tmp_path / "daily")).collect()] == [6]  # the last day is still open
    accesses.run_once(accesses.sessions(events), str(tmp_path / "sessions"), str(tmp_path / "c2"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "sessions")).collect()) == [2, 2, 2]


def test_entry_works_without_the_extra_subpackage(tmp_path):
    for name in ("memspark", "__spark_entry__.py"):
        src = REPO / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "memspark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
