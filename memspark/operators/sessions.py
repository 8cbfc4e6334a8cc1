"""Replay of navigation sessions: which opened nodes are still on a session's stack, without folding a session in one task.

An open pushes its node; `back` pops the top unless it is the only node left. With steps of 1 and -1 after
a session's first open, the size of the stack is 1 plus the running sum less its least value so far (0 at most), and an open
stays if no later size is below its own. Running sums and least values over segments of a log (its rows in one range of
(session, seq)) need only a row per segment from the others, so a session may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.plans.scratch import written

_SEGMENT = ["session_id", "r"]


def _over(*order, last: int = 0) -> Window:
    """Frames that grow with the rows, which take one step a row."""
    return Window.partitionBy(*_SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def stacks(actions: DataFrame) -> DataFrame:
    """session_id, depth (1 is the first node), node, seq of the nodes on each session's stack after its last action.

    actions: session_id, seq, action, node. Actions of equal seq are taken in the order of action and node; an open without
    node and a `back` before the first open do nothing.
    """
    before = Window.partitionBy("session_id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("session_id").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("action") == "back", -1).when(F.col("node").isNotNull(), 1).otherwise(0)
    log = actions.select("session_id", "seq", "action", "node", step.alias("step")).repartitionByRange("session_id", "seq", "action", "node").withColumn("r", F.spark_partition_id())
    log = written(log.withColumn("k", F.row_number().over(Window.partitionBy(*_SEGMENT).orderBy("seq", "action", "node"))), "sessions-log")

    first = log.groupBy(*_SEGMENT).agg(F.min(F.when(F.col("step") == 1, F.col("k"))).alias("k0"))
    first = first.withColumn("r0", F.min(F.when(F.col("k0").isNotNull(), F.col("r"))).over(Window.partitionBy("session_id")))
    opened = (F.col("r") > F.col("r0")) | ((F.col("r") == F.col("r0")) & (F.col("k") > F.col("k0")))
    moves = log.join(first, _SEGMENT).withColumn("move", F.when(opened, F.col("step")).otherwise(0)).withColumn("w", F.sum("move").over(_over("k")))

    level = moves.groupBy(*_SEGMENT).agg(F.sum("move").alias("total"), F.min("w").alias("low"))
    level = level.withColumn("off", F.coalesce(F.sum("total").over(before), F.lit(0)))
    level = level.withColumn("least", F.least(F.lit(0), F.coalesce(F.min(F.col("off") + F.col("low")).over(before), F.lit(0))))
    walk = F.col("off") + F.col("w")
    sized = moves.join(level.select(*_SEGMENT, "off", "least"), _SEGMENT).withColumn("size", 1 + walk - F.least("least", F.min(walk).over(_over("k"))))
    is_first = (F.col("r") == F.col("r0")) & (F.col("k") == F.col("k0"))
    sized = written(sized.select(*_SEGMENT, "k", "seq", "node", "size", F.when(is_first, F.lit(True)).when(F.col("move") == 1, F.lit(False)).alias("first")), "sessions-sizes")

    later = sized.groupBy(*_SEGMENT).agg(F.min("size").alias("least")).withColumn("later", F.min("least").over(after)).select(*_SEGMENT, "later")
    rest = sized.withColumn("rest", F.min("size").over(_over(F.desc("k"), last=-1))).join(later, _SEGMENT)
    stays = F.col("first") | (F.col("size") <= F.coalesce(F.least("rest", "later"), F.col("size")))
    return rest.filter(F.col("first").isNotNull() & stays).select("session_id", F.col("size").cast("long").alias("depth"), "node", "seq")


def states(actions: DataFrame, stack: DataFrame) -> DataFrame:
    """Per session the current node (null: none was opened), the nodes before it, distinct nodes on the stack and distinct nodes ever opened."""
    top = stack.groupBy("session_id").agg(F.max_by("node", "depth").alias("current"), F.max("depth").alias("size"))
    trail = stack.select("session_id", "node").distinct().groupBy("session_id").agg(F.count("*").alias("trail"))
    opened = actions.filter("action <> 'back'").select("session_id", "node").distinct().groupBy("session_id").agg(F.count("node").alias("visited"))
    every = actions.select("session_id").distinct().join(top, "session_id", "left").join(trail, "session_id", "left").join(opened, "session_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return every.select("session_id", "current", (F.greatest(none("size"), F.lit(1)) - 1).cast("long").alias("before"), none("trail").alias("trail"), none("visited").alias("visited"))
