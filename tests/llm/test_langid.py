import math
import random
import zlib

import numpy as np

from memspark.llm import langid

STEMS = {"aa": "ka lo mi tu re", "bb": "schen heit ung pf zu", "cc": "éa çou ñi ói è"}


def docs(spark, n=240, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        stems = STEMS[lang].split()
        text = " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, lang if rng.random() > 0.05 else None, "src"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_defined_cases(spark):
    rows, df = docs(spark)
    more = spark.createDataFrame([(1000, None, "aa", ""), (1001, "12 34 !", "aa", ""), (1002, "", None, ""), (1003, "ka" * 100_000, None, ""), (None, "kalo mitu", "aa", "")], df.schema)
    got = {r.doc_id: r for r in langid.identify(df.union(more)).collect()}
    assert len(got) == len(rows) + 5
    for i, r in got.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    test = [(r[0], r[2]) for r in rows if got[r[0]].held_out and r[2]]
    assert len(test) > 30 and sum(got[i].lang_pred == lang for i, lang in test) / len(test) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "aa"


def test_predictions_ignore_labels_of_held_out_rows(spark):
    rows, df = docs(spark, 120)
    swapped = spark.createDataFrame([(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows], df.schema)
    a = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    b = {r.doc_id: r.lang_pred for r in langid.identify(swapped).collect()}
    assert a == b


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(df).collect()] == [(1, False, "und", 0.0)]
    assert langid.identify(df.filter("doc_id > 1")).count() == 0


def test_keep_known_keeps_columns(spark):
    rows, df = docs(spark, 100)
    junk = spark.createDataFrame([(900, "## 12", "aa", "x"), (901, None, "aa", "x")], df.schema)
    out = langid.keep_known(df.union(junk))
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [r[0] for r in rows]
    assert all(r.lang in STEMS for r in out.collect())


def rows_of(text):
    """Presence rows of a text's windows, one by one."""
    plain = langid._plain(text)
    out = np.zeros((langid.window_count(plain), langid.DIM), np.uint8)
    for w in range(len(out)):
        langid.presence(plain, w, w + 1, out[w : w + 1])
    return out


def test_kernel_is_the_normalised_count_of_shared_ngrams():
    a, b = rows_of("kalo mi"), rows_of("KALO; mi")
    assert a.shape == (1, langid.DIM) and (a == b).all() and a.sum() <= 4 * len(" kalo mi ")


def test_long_texts_in_pieces_and_blocks(monkeypatch):
    texts = ["Kalo, mitu;  --  42 réka\n\nlo " * 9, "", "--", "a", "a" + "-" * 50 + "b"]
    want = [langid._plain(t).tolist() for t in texts]
    monkeypatch.setattr(langid, "PIECE", 7)
    assert [langid._plain(t).tolist() for t in texts] == want
    monkeypatch.setattr(langid, "WINDOW", 10)
    got = list(langid.window_rows(texts, 4))
    assert np.concatenate([o for _, o in got]).tolist() == [i for i, t in enumerate(texts) for _ in rows_of(t)]
    assert (np.concatenate([r for r, _ in got]) == np.concatenate([rows_of(t) for t in texts])).all()
    whole = langid._plain(texts[0])
    every = np.zeros((1, langid.DIM), np.uint8)
    monkeypatch.setattr(langid, "WINDOW", 10**6)
    langid.presence(whole, 0, 1, every)
    monkeypatch.setattr(langid, "WINDOW", 10)
    assert (rows_of(texts[0]).max(axis=0) == every[0]).all()  # windows cover all n-grams


def test_long_texts_of_rich_vocabulary_keep_their_language(spark):
    rows, df = docs(spark, 400)
    model = langid.fit(df)
    rng = random.Random(1)
    letters = "abcdefghijklmnoprstuvyzäéñ"
    texts, want = [], []
    for words in (2000, 20_000, 60_000):
        for lang, stems in STEMS.items():
            unseen = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(3, 9)))
            own = lambda s=stems.split(): "".join(rng.choice(s) for _ in range(rng.randint(1, 4)))
            texts.append(" ".join(unseen() if rng.random() < 0.3 else own() for _ in range(words)))
            want.append(lang)
    got, score = model.predict(texts)
    assert got == want and min(score) > 0.3


def test_ridge_equals_kernel_ridge_over_all_rows(spark):
    """With every row a landmark, the features span the kernel's space: an n x n solve gives the same outputs."""
    rows, _ = docs(spark, 60)
    data = [(lang, rows_of(t)[0]) for _, t, lang, _ in rows if lang]
    ridge = 0.5
    model = langid.fit_rows([(lang, np.packbits(p).tobytes()) for lang, p in data], landmarks=10**6, ridge=ridge)
    p = np.stack([x for _, x in data]).astype(float)
    p /= np.sqrt(p.sum(axis=1, keepdims=True))
    kernel, n = p @ p.T, len(p)
    y = np.where(np.array([x for x, _ in data])[:, None] == np.array(model.langs)[None], 1.0, -1.0)
    w = ((y > 0) / (y > 0).sum(axis=0)).sum(axis=1)
    w *= n / w.sum()
    # Weighted ridge with an intercept: (W K + lambda I) a + W 1 b = W y and 1' a = 0.
    system = np.block([[w[:, None] * kernel + ridge * n / 100 * np.eye(n), w[:, None]], [np.ones((1, n)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.concatenate([w[:, None] * y, np.zeros((1, y.shape[1]))]))
    want = kernel @ solved[:n] + solved[n]
    got = p @ model.weights + model.bias
    assert np.abs(want - got).max() < 0.02


def test_languages_under_one_id_and_many_languages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit_rows", lambda rows: seen.append(rows) or langid.Model([], None, None))
    free = [i for i in range(7_000_001, 7_000_040) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    for i in free:
        rows = [(k, "the house of rain", "en") for k in range(100)] + [(i, f"la casa {k}", "es") for k in range(3000)] + [(free[0], "la casa", "pt")] * 3000
        langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert {x for x, _ in seen[-1]} == {"en", "es", "pt"}
    many = spark.range(20_000).selectExpr("id AS doc_id", "'some words' AS text", "concat('l', id % 10000) AS lang")
    langid.fit(many, total=5000, most_langs=700)
    assert len({x for x, _ in seen[-1]}) == 700 and len(seen[-1]) <= 5000


def test_every_language_is_learned_up_to_its_bound(spark, monkeypatch):
    stems = {f"l{k:02}": [chr(0x4E00 + 40 * k + j) for j in range(40)] for k in range(30)}
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(4)) for _ in range(12)), lang, "") for i, lang in enumerate(rng.choice(sorted(stems)) for _ in range(1500))]
    seen = []
    monkeypatch.setattr(langid, "fit_rows", lambda rows: seen.append(rows) or langid.Model([], None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    langid.fit(df.union(df), per_lang=25)
    counts = {lang: sum(x == lang for x, _ in seen[0]) for lang in stems}
    assert set(counts.values()) == {25}
    langid.fit(df, per_lang=25, total=300)
    assert {x: sum(y == x for y, _ in seen[1]) for x in stems} == {x: 10 for x in stems}


def test_predictions_equal_single_products_and_ties_go_to_the_first(spark):
    rows, df = docs(spark, 150)
    model = langid.fit(df)
    texts = [r[1] for r in rows] + [None, "", "12", "ka", "x" * 50_000]
    lang, score = model.predict(texts)
    for t, a, s in zip(texts, lang, score, strict=True):
        if not t or not any(c.isalpha() for c in t):
            assert (a, s) == ("und", 0.0)
            continue
        each = [(np.flatnonzero(p), math.sqrt(p.sum())) for p in rows_of(t)]
        own = [sum(float(model.weights[at, c].sum()) / size for at, size in each) / len(each) + float(model.bias[c]) for c in range(len(model.langs))]
        assert a == model.langs[max(range(len(own)), key=own.__getitem__)] and abs(s - 1 / (1 + math.exp(-langid.SLOPE * max(own)))) < 1e-4
    tie = langid.Model(["a", "b"], np.zeros((langid.DIM, 2), "float32"), np.zeros(2, "float32"))
    assert tie.predict(["abc", "abc"]) == (["a", "a"], [0.5, 0.5])


def test_repeated_rows_agree(spark):
    rows, df = docs(spark, 60)
    got = langid.identify(df.union(df)).collect()
    assert len(got) == 120 and len({tuple(r) for r in got}) == 60


def test_keep_known_takes_an_empty_table(spark):
    _, df = docs(spark, 5)
    assert langid.keep_known(df.filter("doc_id < 0")).count() == 0
