"""Source-aware vector regions: farthest-first seeds per family and one assignment pass.

Vectors are written out once. Every step is a grouped reduction over them (min_by with
map-side combining) that meets the few seeds of its family, so no family is gathered in one
task and no similarity is carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.functions import vector as V
from memspark.plans.scratch import written

MAX_REGIONS = 4


def _similarities(seeds: Column) -> Column:
    return F.transform(V.cosines(F.col("embedding"), seeds), lambda s: F.round(s, 6))


def assign_regions(chunks: DataFrame) -> DataFrame:
    """Adds region (0 to 3) within the family: the most similar seed, the first among equals.

    chunks: family, document_id, ordinal, embedding. Seeds: the lowest chunk, then the chunk
    whose largest similarity to the seeds is least. Similarities are rounded to six places.
    """
    chunks = written(chunks, "region-vectors")
    vectors = chunks.select("family", "document_id", "ordinal", "embedding")
    first = vectors.groupBy("family").agg(F.least(F.lit(MAX_REGIONS), F.ceil(F.sqrt(F.count("*")))).cast("int").alias("k"), F.min_by("embedding", F.struct("document_id", "ordinal")).alias("seed"))
    seeds = written(first.select("family", "k", F.array("seed").alias("seeds")), "region-seeds")  # a row a family
    for i in range(1, MAX_REGIONS):
        near = F.array_max(_similarities(F.col("seeds"))).alias("near")
        open_ = seeds.filter(F.col("k") > i)
        far = vectors.join(open_, "family").select("family", "document_id", "ordinal", "embedding", near).groupBy("family").agg(F.min_by("embedding", F.struct("near", "document_id", "ordinal")).alias("seed"))
        more = seeds.join(far, "family", "left")
        seeds = written(more.select("family", "k", F.when(F.col("seed").isNull(), F.col("seeds")).otherwise(F.concat("seeds", F.array("seed"))).alias("seeds")), "region-seeds")
    best = _similarities(F.col("seeds"))
    return chunks.join(seeds, "family").withColumn("near", best).withColumn("region", (F.array_position("near", F.array_max("near")) - 1).cast("int")).select(*chunks.columns, "region")


def top_terms(chunks: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The k most frequent words that aren't stop words, per group; ties by word."""
    words = chunks.select(*keys, F.explode(T.tokenize(F.col("text"))).alias("term")).filter(~F.col("term").isin(T.STOP_WORDS))
    counts = words.groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    order = Window.partitionBy(*keys).orderBy(F.desc("tf"), "term")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def region_cards(chunks: DataFrame) -> DataFrame:
    """family, region, size, centroid, label and summary of each region."""
    terms = top_terms(chunks, ["family", "region"]).groupBy("family", "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " / ").alias("terms"))
    base = chunks.groupBy("family", "region").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), V.mean_vector(F.col("embedding")).alias("centroid"))
    name = F.concat(F.upper(F.substring("family", 1, 1)), F.substring(F.col("family"), F.lit(2), F.length("family")))
    return base.join(terms, ["family", "region"], "left").withColumn("label", F.substring(F.concat(name, F.lit(": "), F.coalesce("terms", F.lit("memory"))), 1, 72)).withColumn("summary", F.concat(F.lit("Hierarchical source-aware region with semantic terms "), F.coalesce("terms", F.lit("memory")), F.lit("; source type "), F.col("family"))).drop("terms")


def neighbours(regions: DataFrame, k: int = 3) -> DataFrame:
    """Each region's k nearest regions of its family by centroid: at most four a family, so pairs are few."""
    other = regions.select("family", F.col("region").alias("neighbour"), F.col("centroid").alias("c2"))
    pairs = regions.select("family", "region", "centroid").join(other, "family").filter("region <> neighbour")
    scored = pairs.select("family", "region", "neighbour", F.round(V.cosine("centroid", "c2"), 4).alias("score"))
    order = Window.partitionBy("family", "region").orderBy(F.desc("score"), "neighbour")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
