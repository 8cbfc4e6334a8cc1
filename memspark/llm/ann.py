"""Nearest neighbours by learned partitions.

The number of parts follows the table: about an eighth of the root of its rows, a power of
two of at most `MAX_PARTS`. A sample of `PER_PART` vectors a part, by hash of the id
(`LEAST_SAMPLE` at least, `MAX_SAMPLE` at most), gives a nearest-neighbour graph, which is
cut into parts of equal size by label propagation under a capacity. A softmax classifier
learns, from a vector, how its neighbours spread over the parts. All vectors go to their
most probable part; a query visits its most probable parts and is reranked there by exact
distances in double precision. How many parts it visits is the smallest number that finds `RECALL` of the true neighbours of `TESTS` sample vectors, which one scan of the
whole table gives: neighbours within a sample lie farther off and would ask for more visits.

Rows and visiting queries of a part are both split into blocks by hash of the id, so a part
that a common vector fills is many small tasks, and a task compares one block of queries
with one of rows. Each returns a query's best rows, of which the best are kept.

Vectors that are null, zero, of another length than most of the sample, or hold a null or
non-finite component take no part. Equal distances go to the smaller id; rows with the
query's own id aren't its candidates. Fewer candidates than asked for are all returned.
Repeated rows are candidates each; of several query rows under one id the one with the
smallest vector asks. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.llm.common import discard, materialize, slices

LEAST_SAMPLE, PER_PART, MAX_SAMPLE = 4096, 256, 1 << 17
MAX_PARTS = 4096
NEIGHBOURS = 10
RECALL = 0.96
#: Sample vectors whose neighbours in the whole table are looked up to choose the number of visits.
TESTS = 256
#: Rows and queries of one comparison.
BLOCK_ROWS = 4096
#: Bytes of distances within the sample that are held at a time.
NEAR_BYTES = 1 << 24
#: Sample vectors of one step of the classifier's fit, and steps.
BATCH, STEPS = 4096, 300


def parts_for(rows: int) -> int:
    """Parts of a table: a power of two near sqrt(rows) / 8."""
    return min(MAX_PARTS, 1 << max(0, round(math.log2(max(1.0, math.sqrt(rows) / 8)))))


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    out = vectors.filter(v.isNotNull() & F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    if dim is not None:
        out = out.filter(F.size(v) == dim)
    return out.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; not finite where squares leave the range of doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, in no order; a block of rows at a time, of which only these are kept."""
    out = np.empty((len(x), k), np.int64)
    size = max(1, NEAR_BYTES // (8 * len(x)))
    for s in range(0, len(x), size):
        d = _squared(x[s : s + size], x)
        d[np.arange(len(d)), s + np.arange(len(d))] = np.inf
        out[s : s + size] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Equal parts of a neighbour graph: start from cuts along main directions, then move nodes to where their neighbours are."""
    n = len(near)
    part = np.zeros(n, np.int64)
    count = 1
    while count < parts:  # halve every part at the median of its main direction
        new = part.copy()
        for p in range(count):
            own = np.flatnonzero(part == p)
            c = x[own] - x[own].mean(0)
            direction = np.linalg.svd(c.T @ c)[0][:, 0]
            new[own[np.argsort(c @ direction, kind="stable")[len(own) // 2 :]]] += count
        part, count = new, count * 2
    capacity = int(np.ceil(n / count * 1.05))
    # Both ends of every link: those of node i are other[first[i] : first[i + 1]].
    own, other = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    own, other = np.concatenate([own, other]), np.concatenate([other, own])
    other, first = other[np.argsort(own, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])
    size = np.bincount(part, minlength=count)
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            votes = np.bincount(part[other[first[i] : first[i + 1]]], minlength=count)
            votes[(size >= capacity) & (np.arange(count) != part[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Softmax over parts, linear in the vector."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, probes: int) -> None:
        self.weights, self.bias, self.probes = weights, bias, probes

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square leaves the range of doubles
        return x / np.linalg.norm(x, axis=1, keepdims=True) @ self.weights + self.bias

    def order(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def fit_router(x: np.ndarray, parts: int, neighbours: int = NEIGHBOURS) -> Router:
    """Router for the rows of x, which visits all parts; parts is a power of two."""
    n = len(x)
    parts = max(1, min(parts, 1 << max(0, (n // 16).bit_length() - 1)))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    k = min(neighbours, n - 1)
    near = _nearest(x, k)
    part = balanced_parts(near, x, parts)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for step in range(STEPS):  # gradient descent with momentum on the cross entropy
        pick = np.arange(step * BATCH, (step + 1) * BATCH) % len(u) if len(u) > BATCH else slice(None)
        target = np.zeros((len(u[pick]), parts))
        for j in np.concatenate([part[pick][:, None], part[near[pick]]], axis=1).T:
            target[np.arange(len(target)), j] += 1 / (k + 1)
        z = u[pick] @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        g = (z / z.sum(1, keepdims=True) - target) / len(target)
        speed_w = 0.9 * speed_w - 4.0 * (u[pick].T @ g + 1e-5 * w)
        speed_b = 0.9 * speed_b - 4.0 * g.sum(0)
        w, b = w + speed_w, b + speed_b
    return Router(w, b, parts)


def fit(vectors: DataFrame, parts: int | None = None, recall: float = RECALL) -> tuple[Router | None, int]:
    """Router and vector length from the sample, visits from the whole table."""
    parts = parts or parts_for(vectors.count())
    size = min(MAX_SAMPLE, max(LEAST_SAMPLE, PER_PART * parts))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(size).select("vec_id", "v").toArrow()
    if not len(rows):
        return None, 0
    v = rows.column("v").combine_chunks()
    sizes = v.value_lengths().to_pylist()
    dim = max(sorted(set(sizes)), key=sizes.count)
    alike = pa.array([n == dim for n in sizes])
    x, ids = _matrix(v.filter(alike)), rows.column("vec_id").filter(alike).to_numpy()
    # The vectors that choose the number of visits take no part in the fit, unless the table is small.
    router = fit_router(x[TESTS:] if len(x) >= 8 * TESTS else x, parts)
    router.probes = visits(vectors.filter(F.size("v") == dim), router, ids[:TESTS], x[:TESTS], recall)
    return router, dim


def visits(vectors: DataFrame, router: Router, ids: np.ndarray, tests: np.ndarray, recall: float, k: int = NEIGHBOURS) -> int:
    """The least number of parts to visit that holds this share of the tests' k nearest rows of the table."""
    shared = vectors.sparkSession.sparkContext.broadcast((router, ids, tests))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, ids, tests = shared.value
        for batch in slices(batches, BLOCK_ROWS):
            x = _matrix(batch.column(1))
            home = router.order(x)[:, 0]
            d = _squared(tests, x)
            d[ids[:, None] == batch.column(0).to_numpy()[None]] = np.inf
            pick = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k] if d.shape[1] > k else np.tile(np.arange(d.shape[1]), (len(d), 1))
            dist = np.take_along_axis(d, pick, axis=1).ravel()
            fine = np.isfinite(dist)
            test = np.repeat(np.arange(len(tests)), pick.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(test[fine]), pa.array(dist[fine]), pa.array(home[pick.ravel()][fine])], ["test", "dist", "home"])

    order = Window.partitionBy("test").orderBy("dist", "home")
    found = vectors.select("vec_id", "v").mapInArrow(near, "test long, dist double, home long")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("test", "home").toArrow()  # TESTS * k rows
    if not len(found):
        return 1
    when = np.argsort(router.order(tests), axis=1)[found.column("test").to_numpy(), found.column("home").to_numpy()]
    share = np.cumsum(np.bincount(when)) / len(when)
    return int(np.argmax(share >= recall - 1e-12)) + 1


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distance of q to each row of v where squares would leave the range of doubles: each pair is scaled by a power of two, which is exact."""
    top = np.maximum(np.abs(v).max(axis=1), np.abs(q).max())
    e = np.frexp(top)[1] + 2
    d = np.ldexp(v, -e[:, None]) - np.ldexp(q[None], -e[:, None])
    return np.ldexp(np.sqrt((d * d).sum(axis=1)), e)


def best_in_block(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[int, int, float]]:
    """Each query's k nearest rows (query, id, distance); distances from differences, in double."""
    (qid, q), (vid, v) = queries, rows
    out = []
    sizes = np.concatenate([np.abs(q).max(axis=1), np.abs(v).max(axis=1)])
    if sizes.max() > 1e150 or sizes.min() < 1e-150:
        with np.errstate(over="ignore"):
            for i in range(len(qid)):
                exact, own = _distances(q[i], v), np.flatnonzero(vid != qid[i])
                for o in own[np.lexsort((vid[own], exact[own]))[:k]]:
                    out.append((int(qid[i]), int(vid[o]), float(exact[o])))
        return out
    for s in range(0, len(qid), 256):
        part = q[s : s + 256]
        d = _squared(part, v)
        # What the expanded square may be off by, so that large vectors lose no near row.
        slack = 1e-12 * ((part * part).sum(1)[:, None] + (v * v).sum(1)[None])
        for i in range(len(d)):
            own = vid != qid[s + i]
            bound = np.partition((d[i] + slack[i])[own], k - 1)[k - 1] if own.sum() > k else np.inf
            pick = np.flatnonzero(own & (d[i] - slack[i] <= bound))
            exact = np.sqrt(((v[pick] - q[s + i]) ** 2).sum(1))
            for o in np.lexsort((vid[pick], exact))[:k]:
                out.append((int(qid[s + i]), int(vid[pick[o]]), float(exact[o])))
    return out


def search(vectors: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows found; is_query is SQL over vec_id."""
    spark = vectors.sparkSession
    router, dim = fit(usable(vectors, id_col, vec_col), parts)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK_ROWS):
            # Only a query needs all parts it visits.
            order = shared.value.order(_matrix(batch.column(1)))[:, : shared.value.probes].astype(np.int32)
            asks = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order[:, 0]), pa.array([list(o) if q else None for o, q in zip(order, asks, strict=True)], pa.list_(pa.int32()))], ["vec_id", "v", "part", "visits"])

    whole = usable(vectors, id_col, vec_col, dim)
    routed = whole.withColumn("asks", F.coalesce(F.expr(is_query), F.lit(False))).mapInArrow(route, "vec_id long, v array<double>, part int, visits array<int>")
    routed = materialize(routed, "ann-routed")
    # One vector a query id: a repeated query row would find every neighbour twice.
    queries = routed.filter("visits is not null").groupBy("vec_id").agg(F.min(F.struct("v", "visits")).alias("q"))
    queries = queries.select("vec_id", "q.v", F.explode("q.visits").alias("part"))
    blocks = lambda t, name: t.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias(name))
    sizes = materialize(blocks(routed, "row_blocks").join(blocks(queries, "query_blocks"), "part"), "ann-sizes")
    sizes = F.broadcast(sizes)  # a row a part, MAX_PARTS at most
    draw, every = F.xxhash64("vec_id"), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = routed.select("part", "vec_id", "v").join(sizes, "part").select(F.col("part").alias("part"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), F.pmod(draw, F.col("row_blocks")).alias("i"), every("query_blocks").alias("j"))
    queries = queries.join(sizes, "part").select("part", "vec_id", "v", F.pmod(draw, F.col("query_blocks")).alias("j"), every("row_blocks").alias("i"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            sides = [(t.column("vec_id").to_numpy(), _matrix(t.column("v"))) for t in (left, right)]
            found = best_in_block(*sides, k)
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    keys = ["part", "i", "j"]
    near = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    best = materialize(best, "ann-found")
    discard(routed, sizes)
    return best
