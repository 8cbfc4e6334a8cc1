"""Connected classes of an undirected graph, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import discard, materialize


def connected_classes(edges: DataFrame) -> DataFrame:
    """(id, class_id) for every id of edges (a, b); class_id is the smallest id that edges reach.

    Each round takes the smallest label among a node's neighbours, then the label of that
    label; rounds are written out, so a lost executor costs no more than a round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("class_id")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("class_id").alias("seen")), "b").groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("seen"))
        step = labels.join(near, "id").select("id", F.col("class_id").alias("old"), F.least("class_id", "seen").alias("up"))
        jump = labels.select(F.col("id").alias("up"), F.col("class_id").alias("top"))
        new = materialize(step.join(jump, "up", "left").select("id", "old", F.least("up", F.coalesce("top", "up")).alias("class_id")), "cc-labels")
        changed = not new.filter("old <> class_id").isEmpty()
        discard(labels)
        labels = new.select("id", "class_id")
        if not changed:
            discard(both)
            return labels
