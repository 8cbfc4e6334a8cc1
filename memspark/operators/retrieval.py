"""Routing and hybrid retrieval for batches of queries.

Query texts are a stated set: their vectors and tokens go to every task, chunks are read,
tokenized and embedded once, and the queries meet them in blocks as matrix products. Each
step returns only the best rows per query, so no query-by-chunk product is made as rows. A set of more than
`ASKED` queries is taken in parts by hash, each written out before the next, so the driver holds one part at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.functions import vector as V
from memspark.plans.scratch import written

#: Queries and chunks of one matrix product.
BLOCK, ROWS = 1024, 1000
#: The most words of a block of queries that are taken as a matrix, each used by more than one in so many queries.
COMMON, COMMON_SHARE = 32, 64
#: What a score of single precision may be off by, with its rounding, and less than any score above 0 that isn't rounded to 0.
SLACK, TINY = 3e-5, 1e-7
#: Scores that are computed in double at a time.
EXACT = 65536
#: Queries that are broadcast at a time.
ASKED = 4096
#: Characters of items that one automaton holds.
ITEM_CHARS = 64_000_000


class Asked:
    """A block of queries: ids, vectors, and how often each holds each word of the whole set's vocabulary."""

    def __init__(self, rows: list, words: dict[str, int]) -> None:
        self.ids = np.array([r["query_id"] for r in rows])
        self.sizes = np.array([max(1, len(r["tokens"])) for r in rows])
        self.vectors = np.array([r["v"] for r in rows]) if rows[0]["v"] is not None else None
        own = sorted({words[t] for r in rows for t in r["tokens"]})
        self.column = np.full(len(words) + 1, -1)
        self.column[own] = np.arange(len(own))
        # The queries of each word one after another, once for every use.
        at = np.array([self.column[words[t]] for r in rows for t in r["tokens"]], np.int64)
        self.users = np.repeat(np.arange(len(rows)), [len(r["tokens"]) for r in rows])[np.argsort(at, kind="stable")]
        self.begin = np.searchsorted(np.sort(at), np.arange(len(own) + 1))

        # Words of many queries meet all of them as a matrix product, the others one by one.
        uses = np.diff(self.begin)
        common = np.argsort(-uses, kind="stable")[:COMMON]
        common = common[uses[common] * COMMON_SHARE >= len(rows)]
        self.place = np.full(len(own), -1)
        self.place[common] = np.arange(len(common))
        self.common = np.zeros((len(common), len(rows)), np.float32)
        for i, w in enumerate(common):
            np.add.at(self.common[i], self.users[self.begin[w] : self.begin[w + 1]], 1)
        self.single = None if self.vectors is None else np.ascontiguousarray(self.vectors.T, np.float32)

    def held(self, row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """How many of each query's tokens each of n chunks holds; (row, word) are the chunks' distinct words."""
        at = self.column[word]
        row, at = row[at >= 0], at[at >= 0]
        place = self.place[at]
        has = np.zeros((n, len(self.common)), np.float32)
        has[row[place >= 0], place[place >= 0]] = 1
        out = has @ self.common
        row, at = row[place < 0], at[place < 0]
        uses = self.begin[at + 1] - self.begin[at]
        end = np.cumsum(uses)
        user = self.users[np.arange(end[-1] if len(end) else 0) - np.repeat(end - uses - self.begin[at], uses)]
        np.add.at(out.reshape(-1), np.repeat(row * len(self.ids), uses) + user, np.float32(1))
        return out

    def overlap(self, row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """The same as shares of each query's tokens."""
        return self.held(row, word, n) / self.sizes


def _candidates(rough: np.ndarray, so_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and queries (columns of rough, scores of single precision) that may be among the best so far.

    so_far holds the k best scores of each query in ascending order, 0 at first. A row that scores less than the least of them
    can't be among the k best; one that scores the same may, by its smaller id.
    """
    n, k = len(rough), so_far.shape[1]
    least = np.maximum(so_far[:, 0] - SLACK, TINY).astype(np.float32)
    at = np.flatnonzero(rough >= least)
    if len(at) > 4 * k * len(so_far) and n > k:
        least = np.maximum(least, np.partition(rough, n - k, axis=0)[n - k] - np.float32(2 * SLACK))
        at = np.flatnonzero(rough >= least)
    return np.divmod(at, len(so_far))


def _taken(q: np.ndarray, score: np.ndarray, so_far: np.ndarray) -> None:
    """Bring the best scores so far up to date."""
    k = so_far.shape[1]
    own = np.unique(q)
    every, value = np.concatenate([np.repeat(own, k), q]), np.concatenate([so_far[own].ravel(), score])
    order = np.lexsort((-value, every))
    first = np.flatnonzero(np.diff(every[order], prepend=-1))
    so_far[own] = value[order][first[:, None] + np.arange(k)][:, ::-1]


def _bettered(rough: np.ndarray, so_far: np.ndarray, exact: Callable, ties: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, rows and scores of what may be among the best so far, which are brought up to date; of equal scores the first by ties, the last of which counts most."""
    c, q = _candidates(rough, so_far)
    value = exact(c, q)
    fine = np.flatnonzero((value > 0) & (value >= so_far[q, 0]))
    fine = fine[np.lexsort((*(t[c[fine]] for t in ties), -value[fine], q[fine]))]
    fine = fine[np.arange(len(fine)) - np.searchsorted(q[fine], q[fine]) < so_far.shape[1]]
    if len(fine):
        _taken(q[fine], value[fine], so_far)
    return q[fine], c[fine], value[fine]


def _better(raw: np.ndarray, so_far: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same query by query, of scores in double: query, all its scores, and places of those rows."""
    q, c, _ = _bettered(raw, so_far, lambda c, q: np.round(raw[c, q], 6), (np.arange(len(raw)),))
    for own in np.unique(q):
        yield own, np.round(raw[:, own], 6), c[q == own]


def _best(rows: DataFrame, queries: DataFrame, k: int, score: Callable) -> DataFrame:
    """The k rows (document_id, ordinal, tokens, embedding) that score best per query (query_id, tokens, v); only scores above 0.

    score: of cosines (of vectors without negative numbers) and shares of tokens held, element by element. All are computed in single
    precision, and what may be among the best anew in double.

    embedding may also be a text as `V.normal_tokens` makes it, which is embedded where it is compared, so a task is one Python worker's.
    """
    asked = queries.limit(ASKED + 1).collect()
    if len(asked) <= ASKED:
        return _best_of(rows, asked, k, score)
    queries, rows = written(queries, "asked"), written(rows, "asked-rows")
    parts = -(-2 * queries.count() // ASKED)  # half of ASKED a part on average
    found = None
    for i in range(parts):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect()
        best = written(_best_of(rows, part, k, score), "asked-best")
        found = best if found is None else found.union(best)
    return found


def _best_of(rows: DataFrame, asked: list, k: int, score: Callable) -> DataFrame:
    spark = rows.sparkSession
    asked = sorted(asked, key=lambda r: r["query_id"])
    if not asked:
        return spark.createDataFrame([], "query_id long, document_id long, ordinal int, score double, rank int")
    words = {w: i for i, w in enumerate(sorted({t for r in asked for t in r["tokens"]}))}
    blocks = [Asked(asked[i : i + BLOCK], words) for i in range(0, len(asked), BLOCK)]
    shared = spark.sparkContext.broadcast((list(words), blocks))

    def exact(block: Asked, x: np.ndarray | None, held: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for s in range(0, len(r), EXACT):
            a, b = r[s : s + EXACT], q[s : s + EXACT]
            cos = None if x is None else np.einsum("ij,ij->i", x[a], block.vectors[b])
            out.append(np.round(score(cos, held[a, b] / block.sizes[b]), 6))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, blocks = shared.value
        known = pa.array(names, pa.string())
        so_far = [np.zeros((len(block.ids), k)) for block in blocks]
        for whole in batches:
            for begin in range(0, len(whole), ROWS):
                batch = whole.slice(begin, ROWS)
                n = len(batch)
                word = pc.fill_null(pc.index_in(batch.column(2).flatten(), value_set=known), len(names)).to_numpy()
                row = np.repeat(np.arange(n), batch.column(2).value_lengths().to_numpy())
                held = batch.column(3)
                held = V.embedded(held) if pa.types.is_string(held.type) else held
                x = held.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if held.null_count == 0 else None
                x32 = None if x is None else x.astype(np.float32)
                doc, ordinal = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for block, best in zip(blocks, so_far, strict=True):
                    held = block.held(row, word, n)
                    rough = score(None if x is None else x32 @ block.single, held / block.sizes.astype(np.float32))
                    q, c, value = _bettered(rough, best, partial(exact, block, x, held), (ordinal, doc))
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(block.ids[q], pa.int64()), pa.array(doc[c], pa.int64()), pa.array(ordinal[c], pa.int32()), pa.array(value)], ["query_id", "document_id", "ordinal", "score"])

    found = rows.mapInArrow(run, "query_id long, document_id long, ordinal int, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "ordinal")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _tokens() -> Column:
    return F.array_distinct(T.tokenize(F.col("text"))).alias("tokens")


def hybrid_scores(chunks: DataFrame, queries: DataFrame, k: int, floor: float = 0.05) -> DataFrame:
    """Best k chunks per query: max(0.7 cos + 0.3 lex, max(lex, floor) where lex > 0).

    chunks: document_id, ordinal, text, embedding; queries: query_id, text. Scores are
    rounded to six places; ties go to the smaller document, then ordinal.
    """
    asked = queries.select("query_id", T.tokenize(F.col("text")).alias("tokens"), V.embed(F.col("text")).alias("v"))
    rows = chunks.select("document_id", "ordinal", _tokens(), "embedding")

    def score(cos: np.ndarray, lex: np.ndarray) -> np.ndarray:
        out = 0.7 * cos
        out += 0.3 * lex
        np.maximum(out, lex, out=out)
        low = out < floor
        if low.any():
            out[low & (lex > 0)] = floor
        return out

    return _best(rows, asked, k, score)


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best k rows per query by cosine of hash embeddings alone; rows: document_id, ordinal, text."""
    asked = queries.select("query_id", F.array().cast("array<string>").alias("tokens"), V.embed(F.col("text")).alias("v"))
    rows = rows.select("document_id", "ordinal", F.array().cast("array<string>").alias("tokens"), V.normal_tokens(F.col("text")).alias("embedding"))
    return _best(rows, asked, k, lambda cos, lex: cos)


def lexical_hits(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best k chunks per query by lexical overlap alone, of those that share a word."""
    none = F.lit(None).cast("array<double>")
    asked = queries.select("query_id", T.tokenize(F.col("text")).alias("tokens"), none.alias("v"))
    return _best(chunks.select("document_id", "ordinal", _tokens(), none.alias("embedding")), asked, k, lambda cos, lex: lex)


def contained(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) where an item's text occurs verbatim in a document; empty items occur nowhere.

    The items are a stated set: they are one automaton, run once over every text. A set of more than `ITEM_CHARS`
    is taken in parts by hash, each written out before the next.
    """
    items = items.filter("text is not null and text <> ''").select("item_id", "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size <= ITEM_CHARS:
        return _contained(texts, items)
    parts, found = -(-2 * size // ITEM_CHARS), None
    for i in range(parts):
        part = written(_contained(texts, items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == i)), "contained")
        found = part if found is None else found.union(part)
    return found


def _contained(texts: DataFrame, items: DataFrame) -> DataFrame:
    import ahocorasick

    same: dict[str, list[int]] = {}
    for r in items.orderBy("item_id").collect():
        same.setdefault(r["text"], []).append(r["item_id"])
    shared = texts.sparkSession.sparkContext.broadcast(same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ahocorasick.Automaton()
        for text, ids in shared.value.items():
            words.add_word(text, ids)
        words.make_automaton()
        for batch in batches:
            found = {(i, doc) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, ids in words.iter(text or "") for i in ids} if shared.value else set()
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["item_id", "doc_id"])

    return texts.select("doc_id", "text").mapInArrow(run, "item_id long, doc_id long")


def route_score(tokens: Column, label: Column, summary: Column, filters: Column) -> Column:
    """Per query token 2 if it is part of label or summary, 1 if it is part of a filter value."""
    low = F.lower(F.concat_ws(" ", label, summary))
    values = F.transform(F.map_values(filters), F.lower)
    one = lambda t: F.when(low.contains(t), 2.0).otherwise(0.0) + F.when(F.exists(values, lambda v: v.contains(t)), 1.0).otherwise(0.0)
    return F.aggregate(F.transform(tokens, one), F.lit(0.0), lambda a, x: a + x)


def evaluate(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """top-1 accuracy and mean reciprocal rank over all labelled queries; misses count as 0.

    hits: query_id, document_id, rank; expected: query_id, document_id.
    """
    first = hits.join(expected.distinct(), ["query_id", "document_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    asked = expected.select("query_id").distinct()
    rows = asked.join(first, "query_id", "left")
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("first") == 1, 1.0).otherwise(0.0)), 6).alias("top1"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
