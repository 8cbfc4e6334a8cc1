"""Writers: full overwrite behind a pointer, keyed upsert as append plus latest view, exports and backups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; the columns in order decide, largest first."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of existing without the incoming keys, and the incoming rows."""
    return existing.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming)


def save_version(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Write every table under root/version, then point to it; earlier versions stay as backups."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    row = spark.range(1).select(F.lit(version).alias("version"), F.unix_micros(F.current_timestamp()).alias("saved_at"))
    row.coalesce(1).write.mode("append").json(f"{root}/_versions")
    return version


def load_version(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A table of a version, of the one saved last if none is named."""
    if version is None:
        version = spark.read.schema("version string, saved_at long").json(f"{root}/_versions").agg(F.max_by("version", F.struct("saved_at", "version"))).first()[0]
    return spark.read.parquet(f"{root}/{version}/{name}")


def file_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path as Arrow knows it, and the path there."""
    for name in ("s3a://", "s3n://"):
        path = path.replace(name, "s3://", 1) if path.startswith(name) else path
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_files(files: DataFrame, root: str) -> int:
    """Write each row as a file of its own below root, many to a folder; how many. A task that runs again writes the same files.

    files: folder, name, content (binary).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_store(root)
        made: set[str] = set()
        for batch in batches:
            for folder, name, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                where = f"{base}/{folder}"
                if where not in made:
                    store.create_dir(where, recursive=True)
                    made.add(where)
                with store.open_output_stream(f"{where}/{name}", compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["files"])

    written = files.select("folder", "name", "content").mapInArrow(run, "files long")
    return written.agg(F.sum("files")).first()[0] or 0


def export_records(records: DataFrame, path: str) -> None:
    """JSON lines by task and split."""
    records.write.mode("overwrite").partitionBy("task", "split").json(path)


def prompts(records: DataFrame, split: str) -> DataFrame:
    """prompt / completion rows of a split, or of the next one that has rows: eval, test, train."""
    rank = F.when(F.col("split") == split, 0).otherwise(F.array_position(F.array(F.lit("eval"), F.lit("test"), F.lit("train")), F.col("split")))
    chosen = records.agg(F.min_by("split", rank).alias("split"))
    return records.join(F.broadcast(chosen), "split").select(F.col("input").alias("prompt"), F.col("target").alias("completion"))  # one row is broadcast


def rebase_paths(rows: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """Backup restore: the prefix old of path columns becomes new."""
    for c in columns:
        moved = F.concat(F.lit(new), F.substring(F.col(c), F.lit(len(old) + 1), F.length(c)))
        rows = rows.withColumn(c, F.when(F.col(c).startswith(old), moved).otherwise(F.col(c)))
    return rows
