"""References to documents by normalised id, title or part of a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as T

#: Characters that a path position must share with a reference before longer pieces are cut there. Normalised
#: references have 37 characters, so there are at most 37 + 37^2 + 37^3 heads: they can be broadcast whatever the tables hold.
HEAD = 3


def contained(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """ref, target: the smallest id of the paths that contain each reference.

    wanted: ref (distinct, not empty); paths: id, path (both texts normalised). A path is cut only at places where some
    reference's first characters stand, into pieces as long as the references that begin so, and pieces meet
    references by equality: each piece keeps its smallest id before the exchange, so neither a reference
    that lies in every path nor a path with many references makes pairs.
    """
    heads = wanted.select(F.substring("ref", 1, HEAD).alias("head"), F.length("ref").alias("n")).groupBy("head").agg(F.sort_array(F.collect_set("n")).alias("sizes"))
    distinct = paths.filter("path <> ''").groupBy("path").agg(F.min("id").alias("id"))
    places = distinct.select("id", "path", F.explode(F.expr("sequence(1, length(path))")).alias("at"), F.length("path").alias("end"))
    places = places.select("id", "path", "at", "end", F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.col("end") - F.col("at") + 1))).alias("k"))
    cut = places.withColumn("head", F.expr("substring(path, at, k)")).join(F.broadcast(heads), "head")
    # A head shorter than HEAD is a whole reference; a full one leads to references of its sizes.
    pieces = cut.select("id", "path", "at", "end", F.explode("sizes").alias("n")).filter(F.col("at") + F.col("n") - 1 <= F.col("end"))
    found = pieces.groupBy(F.expr("substring(path, at, n)").alias("ref")).agg(F.min("id").alias("target"))
    return wanted.join(found, "ref")


def resolved(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """ref, target: the smallest id of the documents that a normalised reference names.

    It names a document whose normalised id or title it equals, or whose normalised path contains it. refs: ref;
    documents: id, title, path. Empty references name nothing.
    """
    wanted = refs.select("ref").filter("ref <> ''").distinct()
    named = documents.select("id", F.explode(F.array(T.normalize_ref(F.col("id").cast("string")), T.normalize_ref("title"))).alias("ref")).filter("ref <> ''")
    equal = named.groupBy("ref").agg(F.min("id").alias("target")).join(wanted, "ref", "left_semi").select("ref", "target")
    inside = contained(wanted, documents.select("id", T.normalize_ref(F.col("path")).alias("path")))
    return equal.union(inside.select("ref", "target")).groupBy("ref").agg(F.min("target").alias("target"))


def reference_links(sources: DataFrame, documents: DataFrame, targets: Column) -> DataFrame:
    """source, target, score of the documents that a source's references name; no links to itself.

    sources: source and the columns that `targets`, an array of raw references, is made of.
    """
    raw = sources.select("source", F.explode(targets).alias("raw")).distinct()
    refs = raw.select("source", T.normalize_ref(F.col("raw")).alias("ref")).filter("ref <> ''").distinct()
    return refs.join(resolved(refs, documents), "ref").filter("source <> target").select("source", "target").distinct().withColumn("score", F.lit(0.82))
