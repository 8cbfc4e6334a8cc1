"""Greedy walks over region neighbour graphs, for batches of queries, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import vector as V
from memspark.plans.scratch import written

#: Parts in which the starts of walks meet the queries.
SALTS = 64


def greedy_search(queries: DataFrame, rows: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Best k rows near each (query, region) walk: query_id, region, id, score.

    queries: query_id, q; rows: region, id, ordinal, v; edges: id, neighbour. A walk starts at
    the region's lowest ordinal and moves to the best neighbour while that improves the
    cosine, so it ends; then the last row and its neighbours are scored. Each hop is one join
    for all walks that still move, and is written out.
    """
    entry = rows.groupBy("region").agg(F.min_by("id", F.struct("ordinal", "id")).alias("id"))
    vectors = rows.select("id", "v")
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    starts = entry.join(vectors, "id").withColumn("salt", F.pmod(F.xxhash64("region"), F.lit(SALTS)).cast("int"))
    walks = asked.join(starts, "salt").select("query_id", "q", "region", "id", F.round(V.cosine("q", "v"), 6).alias("score"))
    near = written(edges.join(vectors.withColumnRenamed("id", "neighbour"), "neighbour").select("id", "neighbour", F.col("v").alias("nv")), "walk-edges")
    moving, ended = written(walks, "walks"), None
    while True:
        tried = moving.join(near, "id", "left").groupBy("query_id", "region").agg(F.first("q").alias("q"), F.first("id").alias("old"), F.first("score").alias("was"), F.max(F.struct(F.round(V.cosine("q", "nv"), 6).alias("s"), (-F.col("neighbour")).alias("m"))).alias("best"))
        better = F.coalesce(F.col("best.s") > F.col("was"), F.lit(False))
        moved = written(tried.select("query_id", "q", "region", F.when(better, -F.col("best.m")).otherwise(F.col("old")).alias("id"), F.when(better, F.col("best.s")).otherwise(F.col("was")).alias("score"), better.alias("moved")), "walks")
        still = moved.filter("not moved").drop("moved")
        ended = still if ended is None else ended.union(still)
        moving = moved.filter("moved").drop("moved")
        if moving.isEmpty():
            break
    around = ended.select("query_id", "region", "id", "score").union(ended.join(near, "id").select("query_id", "region", "neighbour", F.round(V.cosine("q", "nv"), 6)))
    order = Window.partitionBy("query_id", "region").orderBy(F.desc("score"), "id")
    return around.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
