import hashlib
import random
import zlib

import pytest

from memspark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def expected(rows):
    firsts = {}
    for page, _, html, _ in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            firsts[body] = min(page, firsts.get(body, page))
    out = []
    for page, _, html, _ in rows:
        body = (html or "").encode()
        first = firsts.get(body)
        revisit = first is not None and page != first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def index(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return warc.capture_index(pages).collect()


def test_round_trip_and_revisits(spark):
    long, lines = "é" * 60, "a\r\n\r\nWARC/1.1\r\n" * 30
    rows = [(5, "http://a.org/x", long, "n"), (3, "http://b.org/", long, "n"), (9, None, long, None), (1, "http://a.org/x", "short", "n"), (2, "x\r\ny", "short", "n"), (4, "http://c.net", None, "n"), (6, "http://c.net", "", "n"), (7, "http://c.net?q", lines, "n"), (8, "http://C.net?q", lines, "n"), (8, "http://C.net?q", lines, "n"), (None, "http://n", long, "n")]
    got = index(spark, rows)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)
    keys = [(r.url_key, r.capture_ts) for r in got]
    assert keys == sorted(keys)


def test_ids_of_any_size_give_a_date(spark):
    rows = [(1 << 62, "http://a.org/", "x" * 200, ""), (-(1 << 62) - 5, "http://a.org/", "x" * 200, ""), (-1, "http://a.org/", None, "")]
    got = index(spark, rows)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)


def test_empty_table(spark):
    assert index(spark, []) == []


def test_global_order_of_many_runs(spark):
    rng = random.Random(3)
    rows = [(i, f"https://h{rng.randint(0, 3)}.example.com/{rng.randint(0, 9)}", "p" * rng.randint(0, 130), None) for i in range(400)]
    got = index(spark, rows)
    keys = [(r.url_key, r.capture_ts, r.page_id) for r in got]
    assert keys == sorted(keys) and len(set(keys)) == 400
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)


def test_loser_tree():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted([(str(rng.randint(0, 5)), rng.randint(0, 9), i, 0, "", "", None, f"r{j}", i) for i in range(rng.randint(0, 6))], key=warc._key) for j in range(k)]
        assert list(warc.LoserTree(runs)) == sorted([x for r in runs for x in r], key=warc._key)


@pytest.mark.parametrize("held, fan_in", [(1 << 30, 256), (0, 256), (2000, 3), (0, 2)])
def test_runs_in_memory_or_scratch_and_in_several_passes(held, fan_in):
    rng = random.Random(held + fan_in)
    schema = warc._schema(warc.INDEX)
    runs = warc.Runs(held, chunk=4)
    everything = []
    for j in range(17):
        rows = sorted([(f"k{rng.randint(0, 9)}", rng.randint(0, 3), i if i % 5 else None, 0, "", "", None, f"r{j:02}", i) for i in range(rng.randint(1, 30))], key=warc._key)
        everything += rows
        runs.open()
        runs.add(warc._rows(rows, schema))
    assert list(runs.merged(schema, fan_in)) == sorted(everything, key=warc._key)


def test_archives_are_bounded_and_seekable(spark, tmp_path):
    rows = [(i, f"http://a{i}.org/", f"page {i} " * 200 + "é" * 2_000_000 * (i == 3), None) for i in range(40)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = warc.capture_index(pages, str(tmp_path)).collect()
    assert len(got) == 40
    for r in got:
        with open(tmp_path / r.archive, "rb") as f:
            f.seek(r.record_offset)
            head, block = warc.parse_record(zlib.decompressobj(31).decompress(f.read()))
        assert head["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and block.endswith(rows[r.page_id][2].encode())


def test_most_pages_share_a_payload(spark):
    same = "s" * 150
    rows = [(i, f"http://a.org/{i}", same if i % 5 < 3 else f"own {i} " * 30, None) for i in range(500)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = index(spark, rows)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)
    own = pages.select("page_id", "url", "html")
    parts = warc.records(own, warc.revisits(own)).rdd.glom().map(len).collect()
    assert sum(parts) == 500


def test_url_key():
    assert warc.url_key("http://WWW.Example.com/a?b") == "com,example,www)/a?b"
    assert warc.url_key(None) == ""


def test_capture_times_hold_in_any_session_time_zone(spark):
    rows = [(n, f"http://a.org/{n}", "x", "") for n in (0, 1, 5_900_000, 6_100_000, 26_000_000, 2**31, -1)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert {r.page_id: r.capture_ts for r in index(spark, rows)} == {n: 1_704_067_200 + n % 2**32 for n, *_ in rows}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
