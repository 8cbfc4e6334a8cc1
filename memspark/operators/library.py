"""Library management: updates, duplicates, queue states, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T

#: Queue states and the states that actions lead to.
NEXT_STATE = {("queued", "run"): "running", ("running", "finish"): "completed", ("running", "fail"): "failed", ("failed", "retry"): "queued", ("cancelled", "retry"): "queued", ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelled"}


def classify_updates(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Fate of each artifact (id, path, file_hash) given the files on disk (path, file_hash).

    current hash at the recorded path equal: duplicate if several artifacts or files share it, else
    unchanged; other hash: replaced if the recorded hash exists elsewhere, else changed; no
    file: moved if the hash exists elsewhere, else deleted.
    """
    at = files.groupBy("path").agg(F.max("file_hash").alias("now"))
    has = files.groupBy(F.col("file_hash").alias("h")).agg(F.count("*").alias("copies"))
    shares = artifacts.groupBy(F.col("file_hash").alias("s")).agg(F.count("*").alias("owners"))
    rows = artifacts.join(at, "path", "left").join(has, F.col("file_hash") == F.col("h"), "left").join(shares, F.col("file_hash") == F.col("s"), "left")
    elsewhere = F.col("copies").isNotNull()
    kind = (
        F.when(F.col("now") == F.col("file_hash"), F.when((F.col("owners") > 1) | (F.col("copies") > 1), "duplicate").otherwise("unchanged"))
        .when(F.col("now").isNotNull(), F.when(elsewhere, "replaced").otherwise("changed"))
        .otherwise(F.when(elsewhere, "moved").otherwise("deleted"))
    )
    return rows.select("id", "path", kind.alias("kind"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(F.array_union(a, b))), F.lit(0.0))


def title_duplicates(documents: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Pairs (a, b, score) of documents whose title tokens have a Jaccard similarity of threshold or more.

    Equal token sets are one unit; the prefix filter (rarest tokens first) finds candidates by
    equi-join, and pairs between units of equal titles stay implicit: each further document of
    a unit is paired with the unit's first.
    """
    sets = documents.select("id", F.array_sort(F.array_distinct(T.tokenize(F.col("title")))).alias("t")).filter(F.size("t") > 0)
    units = sets.groupBy("t").agg(F.min("id").alias("unit"))
    same = sets.join(units, "t").filter("id <> unit").select(F.col("unit").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    tokens = units.select("unit", F.size("t").alias("n"), F.explode("t").alias("w"))
    df = tokens.groupBy("w").agg(F.count("*").alias("df"))
    w = Window.partitionBy("unit").orderBy("df", "w")
    prefix = tokens.join(df, "w").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("unit", "n", "w")
    other = prefix.select(F.col("unit").alias("b"), F.col("n").alias("m"), "w")
    near = prefix.select(F.col("unit").alias("a"), "n", "w").join(other, "w").filter((F.col("a") < F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * threshold)).select("a", "b").distinct()
    full = near.join(units.select(F.col("unit").alias("a"), F.col("t").alias("ta")), "a").join(units.select(F.col("unit").alias("b"), F.col("t").alias("tb")), "b")
    found = full.select("a", "b", F.round(jaccard(F.col("ta"), F.col("tb")), 6).alias("score")).filter(F.col("score") >= threshold)
    return same.unionByName(found)


STATES = ("queued", "running", "completed", "failed", "cancelled")
#: Actions of one item that one fold takes; longer logs are folded block by block.
LOG_BLOCK = 4096


def queue_states(actions: DataFrame, block: int = LOG_BLOCK) -> DataFrame:
    """Last state of each item after its ordered actions (item, seq, action); actions that a state doesn't know change nothing.

    A block of a log (a range of seq) becomes the map from each state before it to the state
    after it; the maps of an item's blocks are then applied in order. So an item with a
    large share of all actions is many small groups.
    """
    log = actions.groupBy("item", F.floor(F.col("seq") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("log"))
    step = lambda states, x: F.transform(states, lambda s: _after(s, x["action"]))
    moved = log.select("item", "block", F.aggregate("log", F.array(*map(F.lit, STATES)), step).alias("after"), F.size("log").alias("n"))
    names = F.array(*map(F.lit, STATES))
    maps = moved.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("block", "after"))).alias("maps"), F.sum("n").cast("int").alias("actions"))
    last = F.aggregate("maps", F.lit("queued"), lambda s, m: F.element_at(m["after"], F.array_position(names, s).cast("int")))
    return maps.select("item", last.alias("state"), "actions")


def _after(state: Column, action: Column) -> Column:
    out = state
    for (s, a), to in NEXT_STATE.items():
        out = F.when((state == s) & (action == a), F.lit(to)).otherwise(out)
    return out


def batch_progress(items: DataFrame) -> DataFrame:
    """Per batch counts by state and the capped sum of completed units."""
    return items.groupBy("batch").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "running", "completed", "failed", "cancelled")], F.sum(F.least("done", "total")).alias("done"), F.sum("total").alias("total"))


def catalogue(kind: str, rows: DataFrame, key: Column, body: Column) -> DataFrame:
    """Sync objects of one kind: key, content hash and bytes."""
    return rows.select(F.lit(kind).alias("kind"), key.alias("object_key"), F.sha2(body, 256).alias("content_hash"), F.octet_length(body).cast("long").alias("bytes"))


def reconcile(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming documents adopt the id that their file hash has already (the last existing one)."""
    known = existing.groupBy("file_hash").agg(F.max("id").alias("known_id"))
    return incoming.join(known, "file_hash", "left").withColumn("id", F.coalesce("known_id", "id")).drop("known_id")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, trained: Column) -> DataFrame:
    """Rows of each table (doc_id) before and after documents go, and whether a model was trained on one of them."""
    marked = gone.select("doc_id").distinct().withColumn("gone", F.lit(True))
    rows = None
    for kind, table in tables.items():
        part = table.select(F.lit(kind).alias("kind"), "doc_id")
        rows = part if rows is None else rows.union(part)
    stale = tables["documents"].join(marked, "doc_id", "left_semi").agg(F.coalesce(F.bool_or(trained), F.lit(False)).alias("model_stale"))
    counts = rows.join(marked, "doc_id", "left").groupBy("kind").agg(F.count("*").alias("before"), F.count_if(F.col("gone").isNull()).alias("after"))
    return counts.join(F.broadcast(stale))  # one row


def rebuild(documents: DataFrame, chunks: DataFrame, present: DataFrame, deleted: DataFrame, cached: DataFrame) -> DataFrame:
    """Per fate (kept, missing, deleted): documents, chunks, and how many of these reuse a cached vector or need one.

    documents, present, deleted: doc_id; chunks: doc_id, text_hash; cached: text_hash.
    """
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    fate = documents.join(flag(present, "doc_id", "present"), "doc_id", "left").join(flag(deleted, "doc_id", "deleted"), "doc_id", "left")
    fate = fate.select("doc_id", F.when(F.col("deleted"), "deleted").when(F.col("present").isNull(), "missing").otherwise("kept").alias("fate"))
    known = chunks.join(flag(cached, "text_hash", "hit"), "text_hash", "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    live = F.col("fate") != "deleted"
    per = fate.join(known, "doc_id", "left").groupBy("fate")
    return per.agg(F.countDistinct("doc_id").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.when(live, F.col("hits"))), F.lit(0)).alias("reused"), F.coalesce(F.sum(F.when(live, F.col("n") - F.col("hits"))), F.lit(0)).alias("embedded"))


def audited(writes: DataFrame, event: str) -> DataFrame:
    """The audit events of writes (kind, target_id, payload); an event's id follows from what was written."""
    return writes.select("kind", F.lit(event).alias("event"), "target_id", F.md5(F.concat_ws(":", "kind", "target_id", "payload")).alias("event_id"))
