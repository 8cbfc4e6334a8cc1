import os
import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from memspark.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, pieces, capacity):
    slow = Tokenizer.from_file(VOCABULARY)
    ids = {i: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[i])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and at & (at - 1) == 0  # no padding at all


@pytest.mark.parametrize("parts", [1, 3])
def test_every_id_in_one_piece_without_padding(spark, monkeypatch, parts):
    monkeypatch.setattr(packing, "POOL", 40)
    monkeypatch.setattr(packing, "KEEP", 10)
    rng = random.Random(parts)
    words = ["alpha", " beta", "é", "😀", "\n\n", "   ", "the", "<|endoftext|>", "12345", "'s", "x" * 30]
    rows = [(i, " ".join(rng.choice(words) for _ in range(int(rng.expovariate(1 / 120))))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " " * 9000 + "x"), (903, "word " * 20_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int").repartition(parts)
    check(rows, packing.pack(docs, VOCABULARY, 256).collect(), 256)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted(p.start for p in packing.pack(docs, VOCABULARY).collect()).count(0) == 2
    assert packing.pack(docs.filter("doc_id > 1"), VOCABULARY).count() == 0


def test_best_fill_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 60)
        counts = {x: items.count(x) for x in items}
        got = packing.best_fill(counts, room)
        assert all(0 < k <= counts[x] for x, k in got.items())
        best = max(sum(c) for r in range(len(items) + 1) for c in combinations(items, r) if sum(c) <= room)
        assert sum(x * k for x, k in got.items()) == best


def test_fast_ids_equal_the_tokenizer():
    e = packing.encoder(VOCABULARY)
    rng = random.Random(3)
    pieces = ["Ab", "é", "ñ", " ", "  ", "\n", "\t", "don't", "１２", "²", "中文", "😀", " ", "_", "--", "​", "ǅ", "٣"]
    for _ in range(400):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert e.ids(t).tolist() == e.slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_fast_ids_equal_the_tokenizer_on_the_tables_and_on_long_runs():
    e = packing.encoder(VOCABULARY)
    texts = ["1234567890" * 300, "٣" * 50, "\r\n" * 400, "a\r\n\r\n b\r", "!?!?" * 500, "-" * 3000, "'s't're" * 40, " " * 3999 + "x", "\t\n " * 900, "e\u0301" * 60, "\u00a0\u2003x", "<|endoftext|>a", "x" * 20_000]
    folder = "/root/testdata/sf0.01"
    if os.path.isdir(folder):
        texts += [t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    for t in texts:
        assert e.ids(t).tolist() == e.slow.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_null_and_text_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), ("k", "c"), ("k", "c")], "doc_id string, text string")
    assert sorted((p.doc_id or "", p.start) for p in packing.pack(docs, VOCABULARY, 4).collect() if p.start == 0) == [("", 0), ("k", 0), ("k", 0)]
