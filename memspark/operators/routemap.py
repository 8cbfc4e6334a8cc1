"""The byte-budgeted route map, its use as a fallback route, and lexical regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T

#: Characters of a label and a summary, what a shrinking step takes off, parts of a kept filter.
LABEL, SUMMARY, STEP, FILTER_KEY, FILTER_VALUE = 18, 64, 8, 8, 12
#: The map's wrapper: {"entries":[ and ]}.
WRAPPER = 14
#: No entry is shorter than its field names, so no more entries than this many bytes each can fit.
LEAST_ENTRY = 40
#: Up to so many entries are shrunk instead of dropped.
CORE = 3


def _entry(summary, filters):
    empty, none = F.lit(""), F.create_map().cast("map<string,string>")  # nulls would be left out of the JSON
    return F.struct(F.coalesce("region_id", empty).alias("region_id"), F.coalesce(F.substring("label", 1, LABEL), empty).alias("label"), F.coalesce(summary, empty).alias("summary"), F.coalesce(filters, none).alias("filters"))


def byte_budget(regions: DataFrame, budget: int = 2048) -> DataFrame:
    """The entries (position, entry as JSON) of a map of at most `budget` bytes.

    regions: region_id, label, summary, filters (a map); entries go by region_id. Dropping
    the last entry until the map fits is the longest prefix that fits, so it is a running
    sum; only as many rows as could fit at all are ever ordered in one place. If the first
    three don't fit, their summaries lose eight characters a step and their filters all
    but the first until they do (or nothing is left to take).
    """
    head = regions.orderBy("region_id").limit(max(CORE, budget // LEAST_ENTRY))
    short = F.substring("summary", 1, SUMMARY)
    order = Window.orderBy("region_id")
    first = F.array_min(F.map_keys("filters"))
    kept = F.when(F.size("filters") > 0, F.map_from_arrays(F.array(F.substring(first, 1, FILTER_KEY)), F.array(F.substring(F.try_element_at("filters", first), 1, FILTER_VALUE)))).otherwise(F.col("filters"))
    rows = head.withColumn("position", F.row_number().over(order))
    whole = rows.withColumn("entry", F.to_json(_entry(short, F.col("filters"))))
    running = F.sum(F.octet_length("entry") + 1).over(order) + WRAPPER - 1
    prefix = whole.withColumn("fits", running <= budget)
    many = prefix.filter("fits").select("position", "entry")
    steps = rows.filter(F.col("position") <= CORE).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(SUMMARY // STEP))))
    left = F.greatest(F.lit(1), F.length(short) - F.col("step") * STEP)
    shrunk = steps.withColumn("entry", F.to_json(_entry(F.substring(short, F.lit(1), left), F.when(F.col("step") > 0, kept).otherwise(F.col("filters")))))
    sizes = shrunk.groupBy("step").agg((F.sum(F.octet_length("entry") + 1) + WRAPPER - 1).alias("bytes"))
    chosen = sizes.agg(F.coalesce(F.min(F.when(F.col("bytes") <= budget, F.col("step"))), F.max("step")).alias("step"))
    few = shrunk.join(F.broadcast(chosen), "step").select("position", "entry")  # one row
    # The core replaces the prefix's first entries: at step 0 they are the same.
    return few.unionByName(many.filter(F.col("position") > CORE))


def with_fallback(index: DataFrame, fallback: DataFrame, k: int) -> DataFrame:
    """query, region, score, reason, rank: positive candidates of the index, filled up to k from the map.

    A region of the index never comes from the map, even at score 0. Where neither gives a
    candidate, the index's best of any score stay.
    """
    order = Window.partitionBy("query").orderBy("tier", F.desc("score"), "region")
    own = index.select("query", "region", "score", F.lit("index").alias("reason"), F.when(F.col("score") > 0, 0).otherwise(2).alias("tier"))
    other = fallback.join(index.select("query", "region").distinct(), ["query", "region"], "left_anti").select("query", "region", "score", F.lit("fallback").alias("reason"), F.lit(1).alias("tier"))
    rows = own.unionByName(other).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best = Window.partitionBy("query")
    return rows.withColumn("least", F.min("tier").over(best)).filter((F.col("tier") < 2) | (F.col("least") == 2)).select("query", "region", "score", "reason", "rank")


def lexical_specs(documents: DataFrame, regions: int = 5, related: int = 3) -> list[tuple[str, list[str]]]:
    """(id, key terms) of each region: the terms in most documents, each with the words it occurs with most.

    Counts run over all documents; what reaches the driver are regions * (1 + related) words.
    """
    seeds = [r["term"] for r in document_frequencies(documents).orderBy(F.desc("df"), "term").limit(regions).collect()]
    if not seeds:
        return [("region-1", ["general"])]
    order = Window.partitionBy("seed").orderBy(F.desc("n"), "term")
    near: dict[str, list[str]] = {}
    for r in terms_beside(documents, seeds).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= related).orderBy("seed", "rank").collect():
        near.setdefault(r["seed"], []).append(r["term"])
    return [(f"region-{k}", [s, *near.get(s, [])]) for k, s in enumerate(seeds, 1)]


def _telling() -> Column:
    return F.filter(T.tokenize(F.col("text")), lambda w: ~w.isin(T.STOP_WORDS))


def document_frequencies(documents: DataFrame) -> DataFrame:
    """term and in how many documents it stands."""
    return documents.select(F.explode(F.array_distinct(_telling())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def terms_beside(documents: DataFrame, seeds: list[str]) -> DataFrame:
    """seed, term and how often the term stands in documents that hold the seed.

    Words are counted by the set of seeds that their document holds, so no word is sent by its document.
    """
    held = lambda own: F.filter(F.array(*map(F.lit, seeds)), lambda s: F.array_contains(own, s))
    rows = documents.select(_telling().alias("own")).select("own", held(F.col("own")).alias("held")).filter(F.size("held") > 0)
    counts = rows.select("held", F.explode("own").alias("term")).groupBy("held", "term").agg(F.count("*").alias("n"))
    return counts.select(F.explode("held").alias("seed"), "term", "n").filter("term <> seed").groupBy("seed", "term").agg(F.sum("n").alias("n"))


def assign_lexical(documents: DataFrame, specs: list[tuple[str, list[str]]]) -> DataFrame:
    """document_id, region_id, score: the region of most key terms, the largest id among equals."""
    own = F.array_distinct(T.tokenize(F.coalesce("text", F.lit(""))))
    choices = F.array(*[F.struct(F.size(F.array_intersect("own", F.array(*map(F.lit, terms)))).alias("score"), F.lit(name).alias("region_id")) for name, terms in specs])
    return documents.select("document_id", own.alias("own")).select("document_id", F.array_max(choices).alias("best")).select("document_id", "best.region_id", "best.score")
