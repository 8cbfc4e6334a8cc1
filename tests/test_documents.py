"""Tables in texts, JSON rewriting and the stream of revisions on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from memspark.functions import json_text, tables
from memspark.functions import text as T
from memspark.streaming import accesses, revisions


def test_answers_are_markdown_and_read_back(spark):
    text = 'notes\n"First_Name","Last name",E-Mail,Dept\nAnn,Lee,a@x.org,"R|D"\nBo, Oz ,b@x.org,"Sales, EU"\nBo, Oz ,b@x.org,"Sales, EU"\nshort,row\n'
    df = spark.createDataFrame([(text,)], "text string").select(T.parse_table(F.col("text")).alias("t"))
    answer = df.select(tables.table_answer(F.lit("People"), F.lit("/p.csv"), F.col("t")).alias("a")).first().a
    assert answer == "Found 2 row(s) in `People`.\n\nSource: `/p.csv`\n\n| Name | Email | Department | Position |\n| --- | --- | --- | --- |\n| Ann Lee | a@x.org | R\\|D |  |\n| Bo Oz | b@x.org | Sales, EU |  |\n"
    back = spark.createDataFrame([(answer,)], "text string").select(tables.markdown_tables(F.col("text")).alias("t")).first().t
    assert back == [(["Name", "Email", "Department", "Position"], [["Ann Lee", "a@x.org", "R|D", ""], ["Bo Oz", "b@x.org", "Sales, EU", ""]])]


def test_long_listings_show_their_first_rows(spark):
    text = "A,B,C\n" + "\n".join(f"n{k},y,z" for k in range(tables.SHOWN_ROWS + 5))
    df = spark.createDataFrame([(text,)], "text string").select(T.parse_table(F.col("text")).alias("t"))
    answer = df.select(tables.table_answer(F.lit("t"), F.lit("p"), F.col("t")).alias("a")).first().a
    assert answer.endswith("| n199 |  |  |  |\n\nShowing the first 200 of 205 rows.\n") and answer.startswith("Found 205 row(s)")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a | b\n--|:-:\n1 | 2 | 3\n4\n\nx", [(["a", "b"], [["1", "2"]])]),
        ("|a|b|\n|---|---|\n|1|\n|\\||x|y|\nend\n|c|\n|-|\n|9|", [(["a", "b"], [["1", ""], ["|", "x"]]), (["c"], [["9"]])]),
        ("|a|b|\n|---|\n|1|2|", []),
        ("no table | here", []),
        ("", []),
        ("|a|\n|:--|", [(["a"], [])]),
    ],
)
def test_markdown_tables(spark, text, want):
    got = spark.createDataFrame([(text,)], "text string").select(tables.markdown_tables(F.col("text")).alias("t")).first().t
    assert [(h, r) for h, r in got] == want


def test_json_strings_move_and_all_else_stays(spark):
    deep = '{"a":' * 200 + '["/old/x"]' + "}" * 200
    rows = ['{"/old/k":"/old/v","n":1.50,"big":12345678901234567890,"l":["/old","/older",{"q":"\\"/old/z"}],"u":"é/old"}', "not json /old/", None, '"/old/top"', "[]", '{"e":"\\/old\\/esc"}', deep]
    got = [r.b for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", json_text.rebase_json(F.col("t"), "/old", "/new").alias("b")).orderBy("i").collect()]
    assert got[0] == '{"/old/k":"/new/v","n":1.5,"big":12345678901234567890,"l":["/new","/older",{"q":"\\"/old/z"}],"u":"é/old"}'
    assert got[1:6] == ["not json /old/", None, '"/new/top"', "[]", '{"e":"/new/esc"}']
    assert json.loads(got[6]) == json.loads(deep.replace("/old", "/new"))


def test_revisions_over_several_triggers(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, f"d{rng.randrange(3)}", f"h{rng.randrange(2)}", 1000 + k) for k in range(60)]
    schema = "page_id long, domain string, content_hash string, retrieved_at long"
    for part in range(6):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # a restart adds nothing
        accesses.run_once(revisions.revisions(accesses.read_events(spark, str(tmp_path / "in"), 1)), out, state)
    want, last = [], {}
    for page, domain, h, _ in rows:
        if last.get(domain, h) != h:
            want.append((page, domain, last[domain], h))
        last[domain] = h
    assert sorted(tuple(r) for r in spark.read.schema(revisions.SCHEMA).parquet(out).collect()) == want
    spark.createDataFrame([(100, "d0", "late", 5)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    accesses.run_once(revisions.revisions(accesses.read_events(spark, str(tmp_path / "in"), 1)), out, state)
    got = {r.page_id: r.previous_hash for r in spark.read.schema(revisions.SCHEMA).parquet(out).collect()}
    assert got[100] == last["d0"] and len(got) == len(want) + 1
