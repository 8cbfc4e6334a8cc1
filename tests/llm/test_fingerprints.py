import hashlib
import random
import unicodedata

import pytest

from memspark.llm import fingerprints as fp


def plain(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def brute(rows):
    """Rows of distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), float(plain(e) == plain(t)), float(plain(n) == plain(t)), plain(t), plain(e))
    return out


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    words = ["Straße", "STRASSE", "ﬁn", "fin", "é", "é", "A", "a", " ", "  ", "\n", " ", "😀", "x" * 50]
    rows = [(i * 7 - 100, None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, canon string, r int").repartition(4)
    got = {r.doc_id: r for r in fp.compare_with_next(docs, parts).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    prints = {}
    for i, (n, sha, near, nxt, own, changed) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, near, nxt)
        prints.setdefault(own, set()).add(r.fingerprint)
        prints.setdefault(changed, set()).add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)


def test_small_tables_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert fp.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    one = fp.compare_with_next(spark.createDataFrame([(5, "abcd")], schema)).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(4, hashlib.sha256(b"abab").hexdigest(), 1.0)]
    rows = [(5, "same"), (5, "same"), (5, "other"), (None, "same"), (None, None), (1, "SAME ")]
    got = fp.compare_with_next(spark.createDataFrame(rows, schema), 4).collect()
    assert len(got) == 6 and len({r.fingerprint for r in got}) == 3
    assert fp.compare_with_next(spark.createDataFrame([(None, "a"), (None, "a")], schema), 3).count() == 2


@pytest.mark.parametrize("digits", [0, 1])
def test_clashing_digests_are_told_apart_in_both_columns(spark, digits):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abC") for _ in range(rng.randint(0, 3)))) for i in range(70)]
    got = {r.doc_id: r for r in fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), 3, digits).collect()}
    prints, owns = {}, set()
    for i, (n, sha, near, nxt, own, changed) in brute(rows).items():
        assert (got[i].n_chars, got[i].edited_sha256, got[i].near_edited, got[i].near_next) == (n, sha, near, nxt)
        owns.add(own)
        prints.setdefault(own, set()).add(got[i].fingerprint)
        prints.setdefault(changed, set()).add(got[i].edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(prints[t])) for t in owns}) == len(owns)


def test_a_common_id_and_a_long_text(spark):
    rows = [(3, "x" * 400_000), *[(5, f"t{i % 3}") for i in range(200)], (9, None)]
    got = fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows) and {r.n_chars for r in got} == {0, 2, 400_000}


def test_ascii_shortcut_agrees():
    for t in ["A  b\tC", "", " x ", "İi", "ß", "\x1c\x1d a"]:
        assert fp.canonical(t) == plain(t).encode()
