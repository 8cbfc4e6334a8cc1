"""Functions on small literals that the tables don't hold."""

import random
import time

import pytest
from pyspark.sql import functions as F

from memspark.functions import hashing as H
from memspark.functions import pages as P
from memspark.functions import privacy as S
from memspark.functions import text as T
from memspark.functions import timefx as D
from memspark.functions import vector as V
from memspark.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("f", "given", "want"), [
    (T.citations, "See cite:alpha-doc, cite(beta_doc) [@gamma-doc; @delta/doc] and @epsilon.", ["alpha-doc", "beta_doc", "delta/doc", "epsilon", "gamma-doc"]),
    (T.markdown_links, "a [[one]] b [t](two.md) [[ three ]]", ["one", "two.md", "three"]),
    (T.tokenize, "Ab abc É1 don't ABC", ["abc", "é1", "don", "abc"]),
    (T.slugify, "  Hello, World/É x ", "hello-world-x"),
    (T.normalize_segment, " a \r\n\n  b \n", "a\nb"),
    (T.collapse, " a  b\n\nc ", "a b c"),
    (T.chunk_label, "  «Title here» ", "Title here"),
    (T.normalize_ref, " /Some Doc.md ", "somedoc"),
    (T.csv_fields, 'a, "b, ""c""" ,,d', ["a", 'b, "c"', "", "d"]),
    (T.split_hierarchy, "A >  > B", ["A", "B"]),
    (T.parent_folder, "/x/y/z.txt", "y"),
    (T.path_tail, "/x/y/z.txt", "z.txt"),
    (T.sentence_kind, "We decided on the task", "decision"),
    (T.trace_role, "memory_search: x", "retriever"),
    (T.file_uri, "/a/b", "file:///a/b"),
    (T.entity_terms, "Alice met bob and CAROL at Éire", ["Alice", "CAROL", "Éire"]),
    (T.representative_terms, "a b", ["memory"]),
    (P.page_text, "<style>x</style><p>a &amp;lt; b</p><SCRIPT>y</script>c<i", "a < b c"),
    (P.url_domain, "https://me@WWW.Example.com:80/x", "www.example.com"),
    (S.redact, "use sk-123, and  password=x ok", "use [REDACTED] and [REDACTED] ok"),
    (S.privacy_level, " Project ", "shared_project_memory"),
])
def test_text(spark, f, given, want):
    assert lit(spark, given, f) == want


def test_headings_and_sections(spark):
    assert tuple(lit(spark, " ## Deep  label ", T.heading)) == (2, "Deep  label")
    assert tuple(lit(spark, "def run(x):", T.heading)) == (1, "def run")
    assert lit(spark, "#nospace", T.heading) is None
    spans = lit(spark, "# A\ntext\n## B\n# C", T.section_spans)
    assert [tuple(s) for s in spans] == [(0, 9, "A", "A"), (9, 14, "B", "A > B"), (14, 17, "C", "C")]
    assert [tuple(s) for s in lit(spark, "no head", T.section_spans)] == [(0, 7, "document", "document")]
    assert [tuple(s) for s in lit(spark, "a\n\n b ", T.paragraph_spans)] == [(0, 1, "1"), (3, 6, "2")]
    assert value(spark, T.span_at(T.section_spans(F.lit("# A\nx\n# B")), F.lit(7))) == "B"


def test_chunks_cover_the_text(spark):
    for n in (0, 1, 599, 600, 601, 1080, 1081, 5000):
        got = lit(spark, "é" * n, T.chunk_structs)
        if n == 0:
            assert got is None
            continue
        assert got[0]["start"] == 0 and got[-1]["end"] == n
        assert all(b["start"] == a["start"] + 480 and b["start"] <= a["end"] for a, b in zip(got, got[1:]))
        assert all(c["end"] - c["start"] == len(c["text"]) for c in got)


def seconds(df):
    df.write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_windows_of_long_texts_are_cut_in_segments(spark):
    text = "".join(chr(97 + i % 23) + "é" for i in range(20_000))
    got = lit(spark, text, T.chunk_structs)
    assert [(c["ordinal"], c["start"], c["end"], c["text"]) for c in got] == [(i, i * 480, min(len(text), i * 480 + 600), text[i * 480 : i * 480 + 600]) for i in range(len(got))]
    bounded = lit(spark, text, lambda c: T.chunk_structs(c, True, 7900, 17))
    assert len(bounded) == 17 and bounded[-1]["text"] == text[7680:7900]
    texts = lambda rows, chars: spark.range(rows).coalesce(1).select(F.explode(T.chunk_structs(F.repeat(F.concat(F.lit("é"), F.col("id") % 10), F.lit(chars // 2)))))
    assert seconds(texts(30, 240_000)) < 8 * seconds(texts(900, 8_000))  # before: 30 times as long for the same characters


def test_only_suspicious_texts_are_looked_at_word_by_word(spark):
    for text in ("a sk-1 b", "x ('sk-1", "ask-1", "API_Key", "my (token=x)", "tok en=", "risk-1 'sk-", "", "password=", "Secret=1"):
        got = spark.createDataFrame([(text,)], "t string").select(S.has_secret(F.col("t")).alias("s"), S.redact(F.col("t")).alias("r"), F.exists(T.words(F.col("t")), S.secret_word).alias("w")).first()
        assert got["s"] == got["w"] == ("[REDACTED]" in got["r"]), text
    assert value(spark, S.has_secret(F.lit(None).cast("string"))) is None
    df = spark.range(3000).coalesce(1).select(F.repeat(F.concat(F.lit("word"), "id", F.lit(" ")), F.lit(300)).alias("t"))
    assert seconds(df.select(S.has_secret(F.col("t")))) < seconds(df.select(F.exists(T.words(F.col("t")), S.secret_word))) / 2


def test_cosines_of_batches_equal_those_of_rows(spark):
    rng = random.Random(1)
    vector = lambda n: [float(rng.randint(0, 5)) / 3 for _ in range(n)]
    rows = [(vector(8), [vector(8) for _ in range(i % 4)]) for i in range(40)]
    rows += [([0.0] * 8, [vector(8)]), (None, [vector(8)]), (vector(8), None), (vector(8), [None, vector(7), [], [0.0] * 8]), ([], [[]]), ([1.0, None], [[1.0, 2.0]]), ([1.0, 2.0], [[None, 1.0], [2.0, 1.0]])]
    df = spark.createDataFrame(rows, "a array<double>, b array<array<double>>").coalesce(1)
    for r in df.select(V.cosines(F.col("a"), F.col("b")).alias("got"), F.transform("b", lambda s: V.cosine(F.col("a"), s)).alias("want")).collect():
        assert r["got"] == (r["want"] or [])


def test_baselines_read_the_records_once(spark):
    import __spark_entry__

    df = __spark_entry__.queries()["a15_baselines"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2  # before: 8


def test_records_make_only_what_is_asked_for(spark):
    from memspark.operators import training

    chunks = spark.createDataFrame([("c", 1, "r", "f", "x  y")], "chunk_id string, document_id long, region string, family string, text string")
    plan = training.chunk_records(chunks).select("task", "target")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "sha2" not in plan


def test_grep_and_excerpt(spark):
    df = spark.createDataFrame([("xAbcabcABx", "ab")], "t string, n string")
    assert df.select(T.grep_starts(F.col("t"), F.col("n")).alias("s")).first()["s"] == [1, 4, 7]
    assert value(spark, T.excerpt(F.lit("0123456789"), F.lit(4), F.lit(5), 2)) == "23456"
    assert value(spark, T.excerpt(F.lit("abc"), F.lit(9), F.lit(10), 2)) == ""


def test_hashes_and_vectors(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    texts = ["", "a", "é😀", "word " * 40, None]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(H.fnv1a("t").alias("h")).collect()]
    assert got == [fnv(t.encode()) if t is not None else None for t in texts]
    assert V.token_slot("abc") == int(fnv(b"abc"), 16) % 64
    e = lit(spark, "Alpha beta alpha", V.embed)
    assert len(e) == 64 and abs(sum(x * x for x in e) - 1) < 1e-12
    assert value(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert value(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0)))) == 0


def test_time(spark):
    day = D.DAY
    now = 1_706_745_600_000
    for age, want in ((1, "fresh"), (20, "aging"), (90, "stale")):
        assert value(spark, D.freshness_status(F.lit(now - age * day), F.lit(now + 1), now)) == want
    assert value(spark, D.freshness_status(F.lit(now - day), F.lit(now - 1), now)) == "refresh_needed"
    assert value(spark, D.freshness_status(F.lit(None).cast("long"), F.lit(None).cast("long"), now)) == "unknown"
    assert value(spark, D.norm_ms(F.lit(1_700_000_000))) == 1_700_000_000_000
    assert value(spark, D.recency_weight(F.lit(1.0), F.lit(now - 8 * day), now)) == 0.25


def test_page_parsing_and_files(spark, tmp_path):
    assert lit(spark, "a \n\n b\f\fc\n", files.parse_pages) == "a\nb\n\nc"
    assert [tuple(s) for s in lit(spark, "a \n\n b\f\fc\n", files.page_spans)] == [(0, 3, "1"), (5, 6, "3")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("hello")
    (tmp_path / "b.txt").write_bytes(b"x\0y")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "d.exe").write_text("no")
    (tmp_path / ".hidden.txt").write_text("no")
    got = {r.path.rpartition("/")[2]: (r.skip_reason, r.text) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": (None, "hello"), "b.txt": ("binary", None), "c.txt": ("not utf-8", None)}


def test_metadata_predicates(spark):
    m = F.create_map(F.lit("a"), F.lit("1"))
    assert value(spark, S.matches_filters(m, {"a": "1"})) and not value(spark, S.matches_filters(m, {"a": "1", "b": "2"}))
    assert value(spark, S.deleted(F.create_map(F.lit("deleted_at"), F.lit("5")), m)) and not value(spark, S.deleted(m, m))
    assert value(spark, S.node_ref(F.lit("chunk:a:b")))["id"] == "a:b" and value(spark, S.node_ref(F.lit("x:1"))) is None
    assert value(spark, S.has_secret(F.lit("bearer x"))) is False


def test_tables_are_parsed_and_scored(spark):
    text = 'Staff list\n\nName, Mail,Team\nAda,a@x,"R, D"\nAda,a@x,"R, D"\nshort,row\n\nBo,b@x,Ops,extra\n'
    t = T.parse_table(F.col("text"))
    got = spark.createDataFrame([(text,), ("no table, here",), ("a,b,c",), ("",), (None,)], "text string").select(t.alias("t"), F.when(t.isNotNull(), T.table_score(F.lit("People"), t, F.array(*map(F.lit, ("people", "mail", "ops", "zzz"))))).alias("n")).collect()
    assert [list(got[0].t.headers), [list(r) for r in got[0].t.rows], got[0].n] == [["Name", "Mail", "Team"], [["Ada", "a@x", "R, D"], ["Bo", "b@x", "Ops"]], 3]
    assert all(r.t is None and r.n is None for r in got[1:])


def test_hash_embedding_equals_token_by_token(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    texts = [None, "", " ", "ab", "abc", "é日本 xyz  xyz a", "x" * 5000] + [" ".join("".join(rng.choice("abcé1 -") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = {r.i: r.v for r in df.select("i", V.normal_tokens(F.col("t")).alias("t")).select("i", "t", V.hash_embed("t").alias("v")).collect()}
    plain = {r.i: r.t for r in df.select("i", V.normal_tokens(F.col("t")).alias("t")).collect()}
    for i, t in plain.items():
        v = np.zeros(64)
        for w in (t or "").split(" "):
            if V.token_slot(w) >= 0:
                v[V.token_slot(w)] += 1
        n = np.sqrt((v * v).sum())
        assert got[i] == (v / n if n else v).tolist(), texts[i]


def test_texts_are_embedded_in_slices(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from memspark.functions import vector

    words = np.array([f"word{i}" for i in range(997)])
    texts = pa.array([None, "", "ab", "alpha beta alpha", *(" ".join(words[np.arange(i, i + 80) % 997]) for i in range(9000))], pa.string())
    tracemalloc.start()
    found = vector.embedded(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6  # before: the tokens of all texts of a batch at once, whatever their length
    assert vector.embedded(texts.slice(0, 0)).to_pylist() == []
    monkeypatch.setattr(vector, "EMBED_BYTES", 1)
    assert vector.embedded(texts.slice(2, 300)).equals(found.slice(2, 300)) and vector.embedded(texts.slice(0, 2)).equals(found.slice(0, 2))


def test_texts_are_embedded_once(spark):
    import __spark_entry__

    def steps(name):
        return __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")

    assert steps("a5_document_centroids") == 1  # before: 2, as a filter on vectors has them made again
    assert steps("r9_session_boost") == 0  # before: 1 beside the comparison, so two Python workers a task


def test_snapshot_keeps_places_instead_of_vectors(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from memspark import queries, queries_documents
    from memspark.operators import knowledge as K
    from memspark.plans.scratch import written

    axes = K.projection_basis(V.DIM)
    texts = [None, "", "ab", "Alpha, beta ALPHA", "éÉ œuvre 東京都 naïve", *(" ".join(f"word{i % 97}" for i in range(k, k + k % 90)) for k in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(V.projected(F.col("text"), axes).alias("p"), V.embed(F.col("text")).alias("v"))
    for r in df.select("p", F.array(*[V.dot(F.col("v"), F.array(*map(F.lit, map(float, b)))) for b in axes]).alias("q")).collect():
        assert r.p == r.q
    batch = pa.array([" ".join(f"word{i % 97}" for i in range(k, k + 80)) for k in range(10_000)])
    tracemalloc.start()
    V._by_slices(batch, 3, lambda v: v[:, :3])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6  # before: 11 MB, the tokens of 1 MB of text at once

    kept = {}
    monkeypatch.setattr(queries_documents, "written", lambda df, tag: kept.setdefault(tag, written(df, tag)))
    queries.QUERIES["g12_snapshot_nodes"](spark, "/root/testdata/sf0.001")
    rows = kept["snapshot"]
    assert "embedding" not in rows.columns  # before: 64 numbers a chunk left Python and were written
    assert rows.agg(F.max(F.size("p"))).first()[0] == len(axes)
