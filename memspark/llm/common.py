"""Helpers that the operators of this subpackage share: tables, shared storage and Arrow text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir, as in local tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints/memspark"
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Rows that are unpacked to Python objects at a time.
BATCH_ROWS = 500


#: A table is dealt to all cores if it is larger than the first and has fewer bytes a core than the second.
WORTH_BYTES, SMALL_BYTES = 1 << 20, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of few small files, which a scan can't split, is dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    small = WORTH_BYTES <= size < cores * SMALL_BYTES and len(df.inputFiles()) < cores
    return df.repartition(cores) if small else df


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share; what is left there goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_SHARED_DIR
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    file_system, where = _file_system(spark, path)
    file_system.deleteOnExit(where)
    return path


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to shared storage and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    file_system, where = _file_system(spark, path)
    file_system.delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later step reads."""
    for df in tables:
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, name)


#: Keys that may be broadcast in a join, each with more than one in as many rows.
HEAVY = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of written rows with a table of unique keys; the at most HEAVY keys that each hold more than a HEAVY-th of the rows come by broadcast."""
    n = rows.count()
    heavy = materialize(rows.groupBy(*keys).agg(F.count("*").alias("heavy")).filter(F.col("heavy") * HEAVY > n), "heavy-keys")  # fewer than HEAVY
    if heavy.isEmpty():
        discard(heavy)
        return rows.join(table, keys)
    few = F.broadcast(heavy.select(*keys))
    by_broadcast = rows.join(F.broadcast(table.join(few, keys, "left_semi")), keys)
    return by_broadcast.unionByName(rows.join(few, keys, "left_anti").join(table.join(few, keys, "left_anti"), keys))


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, without a copy. Spark bounds a batch's bytes; this bounds what is unpacked of it."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
