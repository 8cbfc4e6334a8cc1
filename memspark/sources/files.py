"""File intake: walk, type and size rules, decoding, skip reasons; JSON and JSON-lines stores."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memspark.functions import text as T
from memspark.operators.digests import group_digest

MAX_TEXT_BYTES, MAX_PDF_BYTES = 2_000_000, 25_000_000


def walk(spark: SparkSession, path: str) -> DataFrame:
    """Accepted files below path (path, length, content), hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(T.accepted_file("path") & ~F.col("path").rlike(r"/\.[^/]*(/|$)"))


def classify(files: DataFrame) -> DataFrame:
    """Adds text and skip_reason: too large, binary, not UTF-8, empty, or null where imported."""
    pdf = F.lower("path").endswith(".pdf")
    content = F.col("content")
    as_text = F.try_validate_utf8(content.cast("string"))
    reason = (
        F.when(pdf & (F.col("length") > MAX_PDF_BYTES), "pdf too large")
        .when(~pdf & (F.col("length") > MAX_TEXT_BYTES), "text too large")
        .when(~pdf & F.contains(content, F.lit(b"\x00")), "binary")
        .when(~pdf & as_text.isNull(), "not utf-8")
        .when(~pdf & (F.trim(as_text) == ""), "empty")
    )
    return files.withColumn("skip_reason", reason).withColumn("text", F.when(reason.isNull() & ~pdf, as_text))


def parse_pages(raw):
    """Pages split at form feeds, each with stripped non-blank lines, joined by a blank line, at most 250 000 characters."""
    pages = F.filter(F.transform(F.split(raw, "\f"), T.normalize_segment), lambda p: p != "")
    return F.substring(F.array_join(pages, "\n\n"), 1, T.MAX_DOCUMENT_CHARS)


def page_spans(raw):
    """Structs (start, end, value = page number) of the parsed text's pages."""
    pages = F.transform(F.split(raw, "\f"), lambda p, i: F.struct(T.normalize_segment(p).alias("text"), (i + 1).alias("page")))
    pages = F.filter(pages, lambda p: p["text"] != "")
    step = lambda a, p: F.struct(F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(p["text"])).alias("end"), p["page"].cast("string").alias("value")))).alias("out"), (a["at"] + F.length(p["text"]) + 2).alias("at"))
    zero = F.struct(F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(pages, zero, step, lambda a: a["out"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder, one row a file, with skip reasons."""
    files = classify(walk(spark, path))
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.length("content").alias("bytes"), "skip_reason", parse_pages(F.col("text")).alias("text"), page_spans(F.col("text")).alias("page_spans"))


def read_json_store(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_records(spark: SparkSession, path: str, split: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """JSON-lines records of a data set written by task and split."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.json(path)
    return rows if split is None else rows.filter(F.col("split") == split)


def watch_hashes(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """path and content hash of all files below the enabled roots."""
    paths = [r["path"] for r in roots.filter("enabled").select("path").distinct().collect()]  # a user's list of folders
    if not paths:
        return spark.createDataFrame([], "path string, file_hash string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select("path", F.sha2("content", 256).alias("file_hash"))


def folder_digest(spark: SparkSession, path: str, leave_out: str | None = None) -> str:
    """Digest of a folder: relative paths and contents of its files, in any order; leave_out is a pattern of paths that don't count."""
    root = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/").removeprefix("file:").removeprefix("//") + "/"
    relative = F.regexp_replace("path", rf"^.*?\Q{base}\E", "")
    files = root.select(relative.alias("name"), F.sha2("content", 256).alias("hash"))
    if leave_out:
        files = files.filter(~F.col("name").rlike(leave_out))
    found = group_digest(files.select(F.lit(0).alias("folder"), F.concat_ws(":", "name", "hash").alias("line")), ["folder"]).first()
    return found["digest"] if found else hashlib.sha256(b"").hexdigest()


def managed_copy(files: DataFrame, root: str) -> DataFrame:
    """Write each distinct content once under root, by the first digits of its hash; path, hash and where it lies.

    files: path, content. Equal contents are one row, so a file copied often is stored once.
    """
    named = files.select("path", "content", F.sha2("content", 256).alias("file_hash"))
    blobs = named.groupBy("file_hash").agg(F.first("content").alias("content"))
    blobs.withColumn("shard", F.substring("file_hash", 1, 2)).write.mode("overwrite").partitionBy("shard").parquet(root)
    return named.select("path", "file_hash", F.concat(F.lit(f"{root}/shard="), F.substring("file_hash", 1, 2)).alias("stored"))


def document_hash(file_hash, content_hash):
    """The hash of a document's file, where it has one, else that of its content."""
    return F.coalesce(F.when(F.trim(file_hash) != "", file_hash), content_hash)
