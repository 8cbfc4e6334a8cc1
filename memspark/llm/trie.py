"""Prefix trie of conversations.

Every distinct sequence of first d turns (role, text) of a conversation is a node of depth d, the
root having no turn. A node belongs to its smallest member conversation. Since a longer prefix has
fewer members, a conversation owns all of its prefixes from some depth on: this first owned depth is found by
binary search, for all conversations at once, in joins of prefix digests with the smallest
conversation of each digest. Owned stretches are chains; a chain hangs on the node above its first
depth, which another chain holds. Sums over subtrees go bottom-up: chain totals by
doubling the distance over which chains hand their totals up, then running sums along each chain.

The search halves by powers of two: a conversation that doesn't own depth d asks next for
d + 2^k, so round k only meets depths that are odd multiples of 2^k, and all rounds together read each
prefix once. A conversation takes part in as many rounds as its length has binary digits.

Texts pass one exchange, by ranges of (conversation, turn, role, text), and go on as 128-bit digests;
a prefix digest is the wrapping sum of digests mixed with their positions. Equal digests count as
equal prefixes. A conversation of any length is dealt by ranges and by blocks of `BLOCK` turns; joins whose keys may be
shared by many rows take the few keys that hold a large share of them by broadcast (`common.lookup`). Ids that end at one node
are hashed in order, in pieces of `PIECE` ids; SHA-256 itself is sequential, so the pieces of one node pass one task as a stream.

Null roles and texts are empty. Turns of a conversation are ordered by turn, null first, ties by role and text, so
repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left out. An empty table has
no node, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.llm.common import discard, lookup, materialize, mix64, slices

#: Turns of a conversation, or nodes of a chain, that one group holds.
BLOCK = 1 << 16
#: Ids that one piece of an end list holds.
PIECE = 8192
#: Characters of role and text that ranges are cut by; rows that agree in them stay in one range.
RANGE_CHARS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _columns(names: list[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, d1, d2, size: the turns of each conversation from 0 on, as digests of role and text, with the text's UTF-8 bytes."""
    names = ["conv_id", "r", "at", "d1", "d2", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in slices(batches, 5000):
            conv = batch.column(0).to_numpy()
            marks = []
            for role, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = hashlib.blake2b(f"{len(role)} {role}".encode("utf-8", "surrogatepass"), digest_size=16)
                h.update(text.encode("utf-8", "surrogatepass"))
                marks.append(h.digest())
            lanes = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            place = np.arange(len(conv))
            fresh = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
            at = place - np.maximum.accumulate(np.where(fresh, place, 0))
            if not fresh[0]:
                at[: int(np.argmax(fresh)) if fresh.any() else len(at)] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            size = pc.binary_length(batch.column(2)).cast(pa.int64()).to_numpy()
            yield _columns(names, conv, np.full(len(conv), here, np.int64), at, lanes[:, 0], lanes[:, 1], size)

    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    first = F.col("turn").asc_nulls_first()
    dealt = turns.repartitionByRange("conv_id", first, F.substring("role", 1, RANGE_CHARS), F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("conv_id", first, "role", "text")
    counted = materialize(dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, r long, at long, d1 long, d2 long, size long"), "trie-turns")
    # Only a conversation that goes on from one range to the next has rows in several of them: at most one for each border.
    ranges = counted.groupBy("conv_id").agg(F.min("r").alias("a"), F.max("r").alias("b")).filter("a < b").select(F.col("conv_id").alias("of"))
    parts = counted.join(F.broadcast(ranges), F.col("conv_id") == F.col("of")).groupBy("of", F.col("r").alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = materialize(parts.select("of", "part", F.coalesce(before, F.lit(0)).alias("before")), "trie-borders")
    placed = counted.join(F.broadcast(parts), (F.col("conv_id") == F.col("of")) & (F.col("r") == F.col("part")), "left")  # at most two rows a range
    return placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "d1", "d2", "size")


def grafted(turns: DataFrame) -> DataFrame:
    """conv_id, pos, d1, d2, size: conversations c whose first turns are those of c - c % 5, then their own.

    The first h = crc32(decimal c) % 9 turns come from conversation c - c % 5 (all if it has fewer, none if it is absent), then
    come c's own turns after its first h. A conversation without any turn left has one row of null position.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = materialize(convs.select("conv_id", "n", base.alias("base"), F.when(base == F.col("conv_id"), 0).otherwise(h).alias("h")), "trie-convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").select("conv_id", "n", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    heads = turns.filter((F.col("pos") < 8) & (base == F.col("conv_id"))).withColumnRenamed("conv_id", "base")
    taken = convs.filter("taken > 0").select("conv_id", "base", "taken").join(heads, "base").filter("pos < taken")  # at most 9 conversations a base, 8 turns each
    blocks = convs.select("conv_id", "h", "taken", F.explode(F.expr(f"sequence(0, (n - 1) div {BLOCK})")).alias("block"))
    own = turns.withColumn("block", F.expr(f"pos div {BLOCK}")).join(blocks, ["conv_id", "block"]).filter("pos >= h")
    none = convs.filter("taken = 0 and n <= h").select("conv_id", *(F.lit(None).cast("long").alias(c) for c in ("pos", "d1", "d2", "size")))
    rows = ["conv_id", "pos", "d1", "d2", "size"]
    return taken.select(*rows).union(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "d1", "d2", "size")).union(none)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2, size, level: digests of all prefixes; level is the number of zero bits that end the depth."""
    names = ["conv_id", "block", "pos", "p1", "p2", "size"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Running sums within (conv_id, block), for rows in order."""
        last, carry = None, np.zeros(2, np.uint64)
        for batch in slices(batches, 1 << 16):
            conv, block, pos, d1, d2, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            place = mix64(pos.astype(np.uint64) * _ODD + np.uint64(1))
            fresh = np.concatenate([[last != (conv[0], block[0])], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(conv)), 0))
            out, less = [], np.zeros(2, np.uint64) - carry
            for k, d in enumerate((d1, d2)):
                run = np.cumsum(mix64(d.view(np.uint64) ^ (place + np.uint64(k))))
                before = np.concatenate([[np.uint64(0)], run])[start]
                before = np.where(fresh.cumsum() == 0, less[k], before)  # goes on from the batch before
                out.append(run - before)
            last, carry = (conv[-1], block[-1]), np.array([out[0][-1], out[1][-1]])
            yield _columns(names, conv, block, pos, out[0].view(np.int64), out[1].view(np.int64), size)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the blocks before each one, for rows in order."""
        last, a, b = None, 0, 0
        full = 1 << 64
        for batch in batches:
            rows = []
            for conv, block, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last:
                    last, a, b = conv, 0, 0
                a, b = (a + x) % full, (b + y) % full
                rows.append((conv, block + 1, a - full * (a >> 63), b - full * (b >> 63)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, ["conv_id", "block", "b1", "b2"])

    rows = turns.filter("pos is not null").withColumn("block", F.expr(f"pos div {BLOCK}"))
    rows = rows.select("conv_id", "block", "pos", "d1", "d2", "size").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    within = materialize(rows.mapInArrow(sums, "conv_id long, block long, pos long, p1 long, p2 long, size long"), "trie-sums")
    full = within.filter(F.col("pos") % BLOCK == BLOCK - 1).select("conv_id", "block", "p1", "p2")
    before = full.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(totals, "conv_id long, block long, b1 long, b2 long")
    # Wraps as the sums above do: the sum of two longs, brought back to the range of a long.
    add = lambda x, y: F.expr(f"cast(pmod(cast({x} as decimal(20)) + {y} + 9223372036854775808, 18446744073709551616) - 9223372036854775808 as long)")
    later = within.filter("block > 0").join(before, ["conv_id", "block"]).select("conv_id", "pos", add("p1", "b1").alias("p1"), add("p2", "b2").alias("p2"), "size")
    whole = within.filter("block = 0").select("conv_id", "pos", "p1", "p2", "size").union(later)
    found = whole.withColumn("depth", F.col("pos") + 1)
    level = F.bit_count(F.expr("(depth & -depth) - 1"))
    out = materialize(found.select("conv_id", "depth", "p1", "p2", "size", level.alias("level")), "trie-prefixes")
    discard(within)
    return out


def first_owned(found: DataFrame, minima: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, length, above, parent: the greatest depth that a conversation doesn't own (0: none) and that prefix's owner.

    Rounds go from the greatest power of two within any length down to 1; conversations enter with their own greatest power.
    """
    longest = lengths.agg(F.max("length")).first()[0] or 0
    state = None
    for k in range(max(longest, 1).bit_length() - 1, -1, -1):
        step = 1 << k
        entering = lengths.filter(F.col("length").between(step, 2 * step - 1)).select("conv_id", "length", F.lit(0).cast("long").alias("above"), F.lit(None).cast("long").alias("parent"))
        now = entering if state is None else state.unionByName(entering)
        asks = F.col("above") + step <= F.col("length")
        probes = now.filter(asks).withColumn("depth", F.col("above") + step).join(found.filter(F.col("level") == k).select("conv_id", "depth", "p1", "p2"), ["conv_id", "depth"])
        probes = materialize(probes, "trie-probes")
        answers = lookup(probes, minima.filter(F.col("level") == k).select("depth", "p1", "p2", "owner"), ["depth", "p1", "p2"])
        other = F.col("owner") != F.col("conv_id")
        moved = answers.select("conv_id", "length", F.when(other, F.col("depth")).otherwise(F.col("above")).alias("above"), F.when(other, F.col("owner")).otherwise(F.col("parent")).alias("parent"))
        new = materialize(moved.unionByName(now.filter(~asks)), "trie-state")
        discard(probes, *([] if state is None else [state]))
        state = new
    return state


def end_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of (owner, depth, conv_id): SHA-256 of the ascending decimal ids joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PIECE):
            owner, depth, conv = (batch.column(k).to_numpy() for k in range(3))
            at = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])]))
            ids = conv.astype(str).tolist()
            joined = [",".join(ids[a:b]) for a, b in zip(at, [*at[1:], len(ids)], strict=True)]
            yield _columns(["owner", "depth", "first", "ids"], owner[at], depth[at], conv[at], joined)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            out = []
            for owner, depth, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (owner, depth) == key:
                    h.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, h.hexdigest()))
                key, h = (owner, depth), hashlib.sha256(ids.encode())
            yield from _hashed(out)
        if key is not None:
            yield from _hashed([(*key, h.hexdigest())])

    dealt = ends.repartitionByRange("owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")
    cut = dealt.select("owner", "depth", "conv_id").mapInArrow(pieces, "owner long, depth long, first long, ids string")
    whole = cut.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").select("owner", "depth", "ids")
    return whole.mapInArrow(hashes, "owner long, depth long, ends_sha256 string")


def _hashed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        owner, depth, sha = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha, pa.string())], ["owner", "depth", "ends_sha256"])


def chain_totals(chains: DataFrame, own: DataFrame) -> DataFrame:
    """conv_id, leaves, saved of each chain and all chains that hang on it, however far.

    After k rounds a chain's sums cover chains less than 2^k below it, and `up` leads 2^k up; parents that many
    chains share receive sums that are aggregated before the exchange.
    """
    sums = materialize(own, "trie-totals")
    up = materialize(chains.filter("parent is not null").select("conv_id", F.col("parent").alias("up")), "trie-up")
    while not up.isEmpty():
        given = up.join(sums, "conv_id").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        new = sums.join(given, "conv_id", "left").select("conv_id", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))
        new = materialize(new, "trie-totals")
        next_up = lookup(up, up.select(F.col("conv_id").alias("up"), F.col("up").alias("beyond")), ["up"])
        next_up = materialize(next_up.select("conv_id", F.col("beyond").alias("up")), "trie-up")
        discard(sums, up)
        sums, up = new, next_up
    discard(up)
    return sums


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, pos, d1, d2, size): a conversation without turns has one row of null position.

    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes of the subtree),
    saved_tokens (over the subtree, members but one times the bytes of the node's last text) and ends_sha256 (of the members that end here).
    """
    turns = materialize(turns, "trie-rows")
    lengths = materialize(turns.groupBy("conv_id").agg(F.count("pos").alias("length")), "trie-lengths")
    found = prefixes(turns)
    discard(turns)
    minima = found.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("size").alias("size"), F.first("level").alias("level"))
    minima = materialize(minima, "trie-minima")
    searched = first_owned(found, minima, lengths.filter("length > 0"))
    root = lengths.agg(F.min("conv_id").alias("root"), F.count("*").alias("all")).first()
    top = F.lit(root["root"]).cast("long")

    # The root's owner holds depth 0 too; chains that begin at depth 1 hang on it.
    none = lengths.filter("length = 0").select("conv_id", "length", F.lit(0).cast("long").alias("above"), F.lit(None).cast("long").alias("parent"))
    owned = searched.unionByName(none)
    owned = owned.select("conv_id", "length", F.when(F.col("conv_id") == top, -1).otherwise(F.col("above")).alias("above"), F.when(F.col("conv_id") != top, F.coalesce("parent", top)).alias("parent"))
    owned = materialize(owned, "trie-chains")
    discard(found, searched, lengths)
    chains = owned.filter("above < length")
    at_top = chains.select(F.col("conv_id").alias("owner"), (F.col("above") + 1).alias("depth"), "parent").filter(F.col("parent").isNotNull())
    ends = owned.select(F.when(F.col("above") < F.col("length"), F.col("conv_id")).otherwise(F.col("parent")).alias("owner"), F.col("length").alias("depth"), "conv_id")

    root_node = lengths_root(turns.sparkSession, root)
    nodes = minima.select("owner", "depth", "n_convs", "size").unionByName(root_node)
    hung = chains.filter("parent is not null").groupBy(F.col("parent").alias("owner"), F.col("above").alias("depth")).agg(F.count("*").alias("hung"))
    hung = materialize(hung, "trie-hung")
    last = chains.select(F.col("conv_id").alias("owner"), F.col("length").alias("depth"))
    leaf = last.join(hung, ["owner", "depth"], "left_anti").select(F.col("owner").alias("conv_id"), F.lit(1).alias("leaf"))
    saved = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    own = saved.join(leaf, "conv_id", "left").select("conv_id", F.coalesce("leaf", F.lit(0)).cast("long").alias("leaves"), "saved")
    totals = chain_totals(chains, own)

    given = chains.filter("parent is not null").select("conv_id", "parent", "above").join(totals, "conv_id").groupBy(F.col("parent").alias("owner"), F.col("above").alias("depth"))
    given = given.agg(F.count("*").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    keys = ["owner", "depth"]
    rows = nodes.join(given, keys, "left").join(at_top, keys, "left").join(last.withColumn("last", F.lit(True)), keys, "left").join(end_digests(ends), keys, "left")
    hung_here = F.coalesce("hung", F.lit(0))
    is_last = F.col("last").isNotNull()
    rows = rows.select(
        "owner",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "owner")).alias("parent_conv_id"),
        "n_convs",
        (hung_here + F.when(is_last, 0).otherwise(1)).cast("long").alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + F.when(is_last & (hung_here == 0), 1).otherwise(0)).alias("leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.expr(f"depth div {BLOCK}").alias("block"),
    )
    rows = materialize(rows, "trie-nodes")
    discard(minima, hung, totals, owned)
    # Sums from a node to the end of its chain: within a block, then those of the blocks below it.
    blocks = rows.filter(F.col("block") > 0).select("owner").distinct()
    blocks = rows.join(blocks, "owner", "left_semi").groupBy("owner", "block").agg(F.sum("leaves").alias("b_leaves"), F.sum("saved").alias("b_saved"))
    below = Window.partitionBy("owner").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = blocks.select("owner", "block", F.sum("b_leaves").over(below).alias("b_leaves"), F.sum("b_saved").over(below).alias("b_saved"))
    down = Window.partitionBy("owner", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("n_leaves", F.sum("leaves").over(down)).withColumn("saved_tokens", F.sum("saved").over(down)).join(below, ["owner", "block"], "left")
    return summed.select(
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("n_leaves") + F.coalesce("b_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("b_saved", F.lit(0))).alias("saved_tokens"),
        "ends_sha256",
    )


def lengths_root(spark, root) -> DataFrame:
    """The root's row, or none for an empty table."""
    one = spark.range(1 if root["all"] else 0)
    return one.select(F.lit(root["root"]).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), F.lit(root["all"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("size"))


def oracle() -> str:
    """DuckDB SQL of the trie of grafted conversations; crc32 goes byte by byte through its table."""
    return """
WITH crc AS (SELECT list(list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
h AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base,
  xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 AS h FROM c, crc),
k AS (SELECT h.*, least(h.h, coalesce(c.n, 0)) AS taken FROM h LEFT JOIN c ON c.conv_id = h.base),
turns AS (SELECT k.conv_id, o.pos, o.role, o.text FROM k JOIN o ON o.conv_id = k.base AND o.pos < k.taken
  UNION ALL SELECT k.conv_id, o.pos - k.h + k.taken, o.role, o.text FROM k JOIN o ON o.conv_id = k.conv_id AND o.pos >= k.h),
pre AS (SELECT conv_id, pos + 1 AS depth, strlen(text) AS size,
  sha256(string_agg(sha256(length(role) || ' ' || role || text), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS key FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM pre GROUP BY depth, key),
up AS (SELECT n.depth, n.key, p.depth AS above, p.key AS above_key, n.n_convs, n.size FROM node n JOIN pre p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
child AS (SELECT above AS depth, above_key AS key, count(*) AS n_children FROM up WHERE above = depth - 1 GROUP BY 1, 2),
total AS (SELECT above AS depth, above_key AS key, count(*) FILTER (WHERE ch.n_children IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM up LEFT JOIN child ch ON ch.depth = up.depth AND ch.key = up.key GROUP BY 1, 2),
len AS (SELECT conv_id, max(depth) AS depth FROM pre GROUP BY conv_id),
ends AS (SELECT p.depth, p.key, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS sha FROM pre p JOIN len l ON l.conv_id = p.conv_id AND l.depth = p.depth GROUP BY p.depth, p.key),
parent AS (SELECT up.depth, up.key, n.conv_id FROM up JOIN node n ON n.depth = up.above AND n.key = up.above_key WHERE up.above = up.depth - 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0)::BIGINT AS n_children, t.n_leaves, t.saved::BIGINT AS saved_tokens,
  coalesce(e.sha, sha256('')) AS ends_sha256
FROM node n JOIN total t ON t.depth = n.depth AND t.key = n.key LEFT JOIN child ch ON ch.depth = n.depth AND ch.key = n.key
LEFT JOIN ends e ON e.depth = n.depth AND e.key = n.key LEFT JOIN parent p ON p.depth = n.depth AND p.key = n.key"""
