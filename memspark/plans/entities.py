"""Entities (documents, chunks, messages, accesses, marks, findings) as lazy views of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import pages as P
from memspark.functions import text as T
from memspark.functions import vector as V

#: Moment that stands for now in all queries: 2024-02-01T00:00:00Z.
NOW_MS = 1_706_745_600_000
#: How much an access of each kind weighs.
ACCESS_WEIGHTS = {"query_hit": 0.03, "open": 0.08, "expand": 0.12, "jump": 0.12, "cite": 0.18}
#: Event types as accesses; other types are no accesses.
EVENT_KINDS = {"view": "query_hit", "click": "open", "signup": "expand", "purchase": "cite"}
#: Change of a target's score by a mark's action.
MARK_DELTAS = {"pin": 0.35, "hot": 0.28, "promote": 0.22, "active": 0.14, "warm": 0.10, "cold": -0.08, "decay": -0.14, "suppress": -0.40}


def lookup(c, table: dict):
    """CASE over a small fixed table."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


#: A table is dealt to all cores if it is larger than the first and has fewer bytes a core than the second.
WORTH_BYTES, SMALL_BYTES = 1 << 20, 8 << 20


def spread(table: DataFrame) -> DataFrame:
    """The table, over all cores where its few files are too small for the scan to be split.

    For tables whose next step is heavy on every row (embedding); larger tables stay as their scan deals them, so
    their texts pass no shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if WORTH_BYTES <= size < cores * SMALL_BYTES and len(table.inputFiles()) < cores:
        return table.repartition(cores)
    return table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, max_chars: int = T.MAX_DOCUMENT_CHARS, max_chunks: int = T.MAX_CHUNKS) -> DataFrame:
    """document_id, family, ordinal, start, end, text; larger bounds take whole texts however long."""
    d = spread(read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("document_id"), F.col("source").alias("family"), F.explode(T.chunk_structs(F.col("text"), True, max_chars, max_chunks)).alias("c"))
    return d.select("document_id", "family", "c.ordinal", "c.start", "c.end", "c.text")


def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without their texts: no window is cut."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("family"), F.explode(T.chunk_structs(F.col("text"), False)).alias("c"))
    return d.select("document_id", "family", "c.ordinal", "c.start", "c.end")


def embedded_chunks(spark: SparkSession, sf_dir: str, max_chars: int = T.MAX_DOCUMENT_CHARS, max_chunks: int = T.MAX_CHUNKS) -> DataFrame:
    return chunks(spark, sf_dir, max_chars, max_chunks).withColumn("embedding", V.embed(F.col("text")))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, target (a document id), kind, accessed_at in ms."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("target_id"), lookup(F.col("event_type"), EVENT_KINDS).alias("kind"), F.unix_millis(F.col("ts").cast("timestamp_ltz")).alias("accessed_at")).filter("kind is not null")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks from quality and toxicity labels: good ones promote, toxic ones suppress, poor ones are cold."""
    lab = read(spark, sf_dir, "labels")
    action = F.when(F.col("toxic") == 1, "suppress").when(F.col("quality") == 1, "promote").otherwise("cold")
    return lab.select(F.col("doc_id").alias("target_id"), action.alias("action"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages: url, text, hash of the whole page text, retrieval time (page n is n hours old)."""
    return captured(read(spark, sf_dir, "pages"))


def captured(pages: DataFrame) -> DataFrame:
    """Findings of pages, be they a table or a stream."""
    p = pages.select("page_id", "url", P.page_text(F.col("html"), None).alias("whole"))
    return p.select("page_id", "url", P.url_domain(F.col("url")).alias("domain"), F.substring("whole", 1, P.MAX_BODY).alias("body"), F.sha2("whole", 256).alias("content_hash"), (F.lit(NOW_MS) - F.col("page_id") * 3_600_000).alias("retrieved_at"))
