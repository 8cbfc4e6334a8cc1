"""Canonical exact fingerprints.

A text is canonical after NFKC normalisation, case folding, NFKC again and folding of
white space to single blanks; its fingerprint is the 128-bit xxhash of the canonical
UTF-8. Documents with equal digests are compared byte by byte: should two canonical texts
share a digest, the later ones get a numbered fingerprint, so equal fingerprints mean
equal canonical texts and equal texts have equal fingerprints.

The comparison moves only texts of buckets with several rows, compressed, and one copy per
task: per bucket the smallest and largest canonical text are found by partial aggregation
and must be the same. Should a bucket hold different texts, the texts of its digest are
numbered by byte order, those of documents and edited ones alike (edited texts alone open no
bucket). Likeness of exact fingerprints is 1 or 0.

Nulls are empty texts; the fingerprint of an empty text is a valid one. Very long texts
are hashed whole. Repeated rows share a fingerprint; rows of one id are ordered by the
hash of their text, then by the text, and null ids come last. An empty table gives no
rows, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.llm.common import discard, materialize, slices


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes, digits: int = 32) -> str:
    return xxhash.xxh3_128_hexdigest(canon)[:digits]


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def bucket_digests(docs: DataFrame, digits: int = 32) -> DataFrame:
    """doc_id, digest and text size of every row; texts stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            names = [digest(canonical(t or ""), digits) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), sizes], ["doc_id", "digest", "size"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest string, size long")


#: Text that one range of ids holds, on average.
RANGE_BYTES = 64 << 20
TEXT, MARK = 0, 1
FIRST, LAST = "first", "last"
RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_FACTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, canon binary, edited_canon binary"
_WALKED = _FACTS + ", r int, edge string, marked boolean, text string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _facts(doc: int | None, own: str, own_canon: bytes, following: str, next_canon: bytes, keep: tuple[bool, bool], digits: int) -> tuple:
    """The facts of a document; keep says whether its canonical text and the edited one's go along."""
    changed = edited(own, following)
    changed_canon = canonical(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    packed = [zstandard.compress(c) if k else None for c, k in zip((own_canon, changed_canon), keep, strict=True)]
    return (doc, len(own), sha, digest(own_canon, digits), digest(changed_canon, digits), float(changed_canon == own_canon), float(next_canon == own_canon), *packed)


def walk(rows: DataFrame, marks: DataFrame, parts: int, every: bool = False, digits: int = 32) -> DataFrame:
    """Facts of all documents, each with the one that follows it by descending id.

    One exchange deals texts to ranges of ids, and every range is walked in order. The last text of
    a range is followed by the first of the next one that holds any, so these two of each range are written
    apart and joined by the number of the range. `marks` are ids whose canonical text is wanted; `every` wants all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, mark, waiting = TaskContext.get().partitionId(), None, None
        none = (None,) * 7
        for batch in slices(batches):
            out: list[tuple] = []
            for kind, doc, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if kind == MARK:
                    mark = doc
                    continue
                canon = canonical(text)
                if waiting:
                    out.append((*_facts(*waiting[:3], text, canon, (waiting[3] or every, every), digits), here, None, None, None))
                else:
                    out.append((doc, None, *none, here, FIRST, None, text))
                waiting = (doc, text, canon, doc is not None and mark == doc)
            if out:
                yield _batch(out, _WALKED)
        if waiting:
            yield _batch([(waiting[0], None, *none, here, LAST, waiting[3], waiting[1])], _WALKED)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _batch([_facts(doc, text, canonical(text), after, canonical(after), (marked or every, every), digits) for doc, marked, text, after in rows], _FACTS)

    both = rows.select(F.lit(TEXT).alias("kind"), "doc_id", "text").union(marks.select(F.lit(MARK), "doc_id", F.lit(None).cast("string")))
    down = F.col("doc_id").desc_nulls_last()
    dealt = both.repartitionByRange(parts, down).sortWithinPartitions(down, F.col("kind").desc(), F.xxhash64("text"), F.col("text"))
    walked = materialize(dealt.select("kind", "doc_id", "text").mapInArrow(run, _WALKED), "fingerprints")
    ends = walked.filter(F.col("edge") == LAST)
    order = Window.orderBy("r")  # a row a range, without its text
    follows = ends.select("r").select("r", F.coalesce(F.lead("r").over(order), F.min("r").over(Window.partitionBy())).alias("to"))
    firsts = walked.filter(F.col("edge") == FIRST).select(F.col("r").alias("to"), F.col("text").alias("after"))
    last = ends.select("r", "doc_id", "marked", "text").join(follows, "r").join(firsts, "to").select("doc_id", "marked", "text", "after").mapInArrow(close, _FACTS)
    return walked.filter("edge is null").drop("r", "edge", "marked", "text").union(last)


def compare_with_next(docs: DataFrame, parts: int | None = None, digits: int = 32) -> DataFrame:
    """Fingerprints of each document, of its edited text and how like its own the next one's is.

    `digits` is the length of a digest; short ones only serve to test what happens when digests clash.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digests = materialize(bucket_digests(own, digits), "digests")
    # Written out, so both sides of the join come from an exchange and AQE can split a large group of copies.
    repeated = materialize(digests.groupBy(F.col("digest").alias("again")).agg(F.count("*").alias("rows")).filter("rows > 1").select("again"), "repeated")
    marks = materialize(digests.join(repeated, F.col("digest") == F.col("again"), "left_semi").filter("doc_id is not null").select("doc_id").distinct(), "marks")
    if not parts:  # whatever the session's number of partitions is
        size = digests.agg(F.sum("size")).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    found = walk(own, marks, parts, digits=digits)
    clash = materialize(clashing(found), "fingerprint-clashes")
    discard(digests, repeated)
    if clash.isEmpty():
        discard(marks)
        return found.select(*RESULT)
    return numbered(walk(own, marks, parts, True, digits), clash).select(*RESULT)


def clashing(found: DataFrame) -> DataFrame:
    """Fingerprints that different canonical texts share, by comparing bytes."""
    ends = found.filter("canon is not null").groupBy("fingerprint").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    return ends.filter("least <> most").select("fingerprint")


def numbered(found: DataFrame, clash: DataFrame) -> DataFrame:
    """Clashing fingerprints get a number for each text but the first by bytes, in both columns alike."""
    both = found.select("fingerprint", "canon").union(found.select("edited_fingerprint", "edited_canon"))
    texts = both.join(clash, "fingerprint", "left_semi").distinct()
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon"))
    names = materialize(texts.select("fingerprint", "canon", rank.alias("rank")).filter("rank > 1"), "fingerprint-names")
    for name, canon in (("fingerprint", "canon"), ("edited_fingerprint", "edited_canon")):
        new = names.select(F.col("fingerprint").alias(name), F.col("canon").alias(canon), "rank")
        found = found.join(new, [name, canon], "left").withColumn(name, F.concat_ws("-", name, "rank")).drop("rank")
    return found
