"""Routing queries over any number of region cards: tokens meet the cards they stand in by equality joins, no query meets every card."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T

#: What a token in a card's label or summary counts, and one in a filter value; routes of a query.
IN_NAME, IN_VALUE, ROUTES = 2.0, 1.0, 3
#: Characters that a place in a card must share with a token before longer pieces are cut there.
HEAD = 3


def held_in(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """token, id of every token (distinct, not empty) that stands anywhere in a text; texts: id, text, both lower-case and the texts short."""
    heads = wanted.select(F.substring("token", 1, HEAD).alias("head"), F.length("token").alias("n")).groupBy("head").agg(F.collect_set("n").alias("sizes"))
    spots = texts.filter("text <> ''").select("id", "text", F.explode(F.expr("sequence(1, length(text))")).alias("spot"))
    spots = spots.select("id", "text", "spot", F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("text") - F.col("spot") + 1))).alias("k"))
    cut = spots.withColumn("head", F.expr("substring(text, spot, k)")).join(heads, "head").select("id", "text", "spot", F.explode("sizes").alias("n"))
    pieces = cut.filter(F.col("spot") + F.col("n") - 1 <= F.length("text")).select("id", F.expr("substring(text, spot, n)").alias("token")).distinct()
    return pieces.join(wanted.select("token"), "token")


def routes(queries: DataFrame, cards: DataFrame, k: int = ROUTES) -> DataFrame:
    """query_id, region_id, score, rank: each query's k best regions; ties, also of score 0, go to the smaller region id.

    queries: query_id, text; cards: region_id, label, summary, values (array of filter values). A query without a token has no route.
    """
    tokens = queries.select("query_id", F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("uses"))
    wanted = tokens.select("token").distinct()
    named = held_in(wanted, cards.select(F.col("region_id").alias("id"), F.lower(F.concat_ws(" ", "label", "summary")).alias("text"))).withColumn("weight", F.lit(IN_NAME))
    # A token counts once for a card's filter values, however many of them hold it.
    values = cards.select(F.col("region_id").alias("id"), F.explode(F.array_distinct("values")).alias("text")).select("id", F.lower("text").alias("text")).distinct()
    valued = held_in(wanted, values).withColumn("weight", F.lit(IN_VALUE))
    met = tokens.join(named.union(valued), "token").groupBy("query_id", F.col("id").alias("region_id")).agg(F.sum(F.col("uses") * F.col("weight")).alias("score"))
    # Regions of score 0 that can be among the first k are the smallest ids, at most k besides k that score.
    first = F.broadcast(cards.select("region_id").distinct().orderBy("region_id").limit(2 * k))
    none = tokens.select("query_id").distinct().join(first).withColumn("score", F.lit(0.0))
    every = met.unionByName(none).groupBy("query_id", "region_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "region_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def matched_terms(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """query_id, region_id, matched_terms: the distinct tokens of a query that a card's label, summary or values hold."""
    tokens = queries.select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("token"))
    text = cards.select(F.col("region_id").alias("id"), F.explode(F.concat(F.array(F.concat_ws(" ", "label", "summary")), "values")).alias("text")).select("id", F.lower("text").alias("text")).distinct()
    met = tokens.join(held_in(tokens.select("token").distinct(), text), "token").select("query_id", "id", "token").distinct()
    return met.groupBy("query_id", F.col("id").alias("region_id")).agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("matched_terms"))
