"""The whole pipeline against a plain-Python version of its stages."""

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
import regex

import corpus_pipeline
from memspark.llm import langid, mixing
from memspark.llm.common import table
from tests.llm.test_mixing import plain_rake
from tests.llm.test_ngram_join import brute as brute_classes
from tests.llm.test_langid import rows_of
from tests.llm.test_packing import check as check_packing
from tests.llm.test_secrets import plain as plain_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain_language(rows, model):
    """Kernel expansion by single products: a row at a time, no batches."""
    kept = []
    for r in rows:
        if r["text"] and any(c.isalpha() for c in r["text"]):
            each = [p.astype(float) for p in rows_of(r["text"])]
            out = [sum(float(np.dot(p, model.weights[:, c].astype(float))) / math.sqrt(p.sum()) for p in each) / len(each) + float(model.bias[c]) for c in range(len(model.langs))]
            if 1 / (1 + math.exp(-langid.SLOPE * max(out))) >= 0.15:
                kept.append({**r, "lang": model.langs[out.index(max(out))]})
    return kept


def plain_near(rows):
    lead = {i: c for i, _, c in brute_classes([(r["doc_id"], r["text"]) for r in rows])}
    return [r for r in rows if lead[r["doc_id"]] == r["doc_id"]]


def plain_redact(rows):
    out = []
    for r in rows:
        text, last, new = r["text"], 0, []
        for s, e, _ in sorted(x for x in plain_spans(text) if x[2] != "hex"):
            if s >= last:
                new += [text[last:s], "[SECRET]"]
            last = max(last, e)
        out.append({**r, "text": "".join(new) + text[last:]})
    return out


def plain_mix(rows):
    def topic(text):
        counts = Counter(regex.findall(r"\p{L}{6,}", text.lower()))
        best = min(counts, key=lambda w: (-counts[w], w.encode()), default="")
        return int(hashlib.md5(best.encode()).hexdigest()[:4], 16) % mixing.TOPICS

    cells = {}
    for r in rows:
        r["cell"] = (r["source"] or "", r["lang"] or "", topic(r["text"]))
        cells[r["cell"]] = cells.get(r["cell"], 0) + max(1, len(re.findall("[^ \t-\r]+", r["text"])))
    total = sum(cells.values())
    wants = []
    for m in range(3):
        sums = {}
        for c, n in cells.items():
            sums[c[m]] = sums.get(c[m], 0) + n
        w = {k: (v / total) ** mixing.TEMPER for k, v in sums.items()}
        wants.append({k: v / sum(w.values()) for k, v in w.items()})
    share = plain_rake(cells, wants, mixing.BUDGET, 100)
    keep = lambda r: int(hashlib.md5(f"mix{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32 < share[r["cell"]] * mixing.BUDGET * total / cells[r["cell"]]
    return [r for r in rows if keep(r)]


def test_pipeline_equals_plain_python(spark):
    docs = table(spark, SF, "documents")
    rows = [r.asDict() for r in docs.collect()]
    want = plain_mix(plain_redact(plain_near(plain_language(rows, langid.fit(docs)))))
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == {r["doc_id"] for r in want}
    check_packing([(r["doc_id"], r["text"]) for r in want], pieces, 2048)


def test_stages_with_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, `row` string, inclusion double, topic int, base string, unit long, grp long, component_id long, kind string"
    more = (0.5, "x", "r", 0.1, 3, "b", 1, 2, 3, "k")
    texts = ["alpha beta gamma delta words " * 3, "ein zwei drei vier wort " * 3, None, "", "alpha beta gamma delta words " * 3, "token = abcdefghijklmnop words " * 2]
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), *more) for i, t in enumerate(texts)] + [(None, "null id words here", "en", None, 0, *more)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert {r.score for r in out.collect()} <= {0.5}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
