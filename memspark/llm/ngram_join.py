"""Jaccard self-join of word-shingle sets by grouped prefixes, and its connected classes.

Two documents link when 100 |A & B| >= 80 |A | B| over their five-word shingles.

1. Sets and order. A scan hashes every text's shingles, names equal sets by a 128-bit
   sum (equal sets are one unit with its smallest id) and counts all shingles in a
   fixed-size counting table. The join's total order of shingles is (count, hash): common
   passages come last and hardly ever enter a prefix. Any order gives the same result.
2. Grouped prefixes. Of n shingles the first n - ceil(0.8 n) + 1 are the prefix; linked
   sets share one of them. Documents with identical prefixes and size collapse into one
   group. Shingles that fill more than a block are salted.
3. First links. Per shingle, groups that pass the length and position filters against a
   pivot (the group with the smallest share of rarer shingles) give a candidate pair, so
   the pairs are fewer than the rows, however large a group of copies is. Groups expand to
   their units, pairs are verified on full sets, links give classes.
4. The rest, exactly. Shingles whose groups lie in more than one class yield all pairs of
   units of different classes that pass the filters; units outside a shingle's largest
   class meet all others, block by block. A group of several units is such a set by itself,
   as if its units' common prefix were one shingle. These pairs are verified too.
   Pairs inside a class need no test, as the result is the class.

Texts without words, null texts and null ids link with nothing; a null id has no class.
Rows that share an id are one document and so share a class; repeated rows agree, and of
equal sets the smallest id leads. Very long texts are hashed whole, piece by piece. An empty
table gives no rows. Other columns are ignored. Nothing is dropped: filters only remove
pairs that can't link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import discard, materialize, mix64, slices
from memspark.llm.components import connected_classes
from memspark.llm.shingles import WIDTH, shingle_sets

#: Similarity as a fraction: NUMER / DENOM.
NUMER, DENOM = 80, 100
#: Counting table: 2 ** bits counters, sent in pieces.
COUNT_BITS, PIECE_BITS = 20, 12
#: Rows of one shingle that one block holds, and pivots tried on a run before step 4 takes over.
BLOCK, PIVOTS = 20_000, 64
#: Rows on either side of one comparison in step 4, and pairs that a task holds before they go out.
REST_BLOCK, HELD_PAIRS = 2048, 1_000_000
#: Bits of the map of documents whose sets are needed for verification.
MAP_BITS = 24


def prefix_length(n: int) -> int:
    return n + 1 - -(-NUMER * n // DENOM)


def passes(n: np.ndarray, pos: np.ndarray, n2: np.ndarray | int, pos2: np.ndarray | int) -> np.ndarray:
    """Length and position filters: can sets of these sizes that meet at these prefix places still link?"""
    small, large = np.minimum(n, n2), np.maximum(n, n2)
    bound = np.minimum(n - pos, n2 - pos2)
    return (DENOM * small >= NUMER * large) & (bound * (DENOM + NUMER) >= NUMER * (n + n2))


def set_facts(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Per document size and 128-bit name of its set; counts of all shingles by slot."""
    spark = docs.sparkSession
    fields = ["doc_id", "n", "s1", "s2", "piece", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in slices(batches):
            n, s1, s2 = [], [], []
            for s in shingle_sets(batch.column(1)):
                np.add.at(table, (s & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64), 1)
                n.append(len(s))
                s1.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                s2.append(int(mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, s1, s2)), *none], fields)
        pieces = table.reshape(-1, 1 << PIECE_BITS)
        live = np.flatnonzero(pieces.any(axis=1))
        if len(live):
            empty = [pa.nulls(len(live), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*empty, pa.array(live, pa.int32()), pa.array([pieces[k].tobytes() for k in live], pa.binary())], fields)

    both = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, piece int, counts binary"), "join-sets")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(counts, np.uint32).astype(np.uint64)
                sums[piece] = sums[piece] + c if piece in sums else c
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["piece", "counts"])

    table = np.zeros((1 << (COUNT_BITS - PIECE_BITS), 1 << PIECE_BITS), np.uint64)
    for r in both.filter("piece is not null").select("piece", "counts").repartition("piece").mapInArrow(add, "piece int, counts binary").collect():
        table[r["piece"]] = np.frombuffer(bytes(r["counts"]), np.uint64)  # 8 MB in all, whatever the input
    return both.filter("piece is null").select("doc_id", "n", "s1", "s2"), table.ravel()


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Per document its group's name (prefix and size), size and salted prefix; heavy shingles also unsalted."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << COUNT_BITS) - 1)
        for batch in slices(batches):
            ids, out = batch.column(0).to_pylist(), [[] for _ in range(6)]
            for doc, s in zip(ids, shingle_sets(batch.column(1)), strict=True):
                if doc is None or not len(s):
                    continue
                c = shared.value[(s & mask).astype(np.int64)]
                order = np.argsort(c, kind="stable")[: prefix_length(len(s))]
                tokens, salts = s[order], c[order] // np.uint64(BLOCK) + np.uint64(1)
                named = np.concatenate([tokens * (2 * np.arange(len(tokens), dtype=np.uint64) + np.uint64(1)), np.array([len(s)], np.uint64)])
                group = mix64(named).sum(dtype=np.uint64, keepdims=True)
                heavy = np.flatnonzero(salts > 1)
                salt = mix64(tokens ^ group) % salts
                salted = np.where(salts > 1, mix64(tokens + salt * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)), tokens)
                for o, v in zip(out, (doc, int(group.view(np.int64)[0]), len(s), salted.view(np.int64), tokens[heavy].view(np.int64), heavy.astype(np.int32)), strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["doc_id", "grp", "n", "prefix", "heavy", "heavy_at"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, grp long, n long, prefix array<long>, heavy array<long>, heavy_at array<int>")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Sorted rows, so many batches that each run of equal keys is whole; with the runs' bounds."""
    held: list[list[np.ndarray]] = []
    rows = 0

    def cut(cols: list[np.ndarray]) -> np.ndarray:
        change = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:keys]:
            change |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [len(cols[0])]])

    for batch in batches:
        if not len(batch):
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += len(batch)
        if rows < 200_000:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        at = cut(cols)
        if len(at) > 2:
            yield [c[: at[-2]] for c in cols], at[:-1]
            cols = [c[at[-2] :] for c in cols]
        held, rows = [cols], len(cols[0])
    if held:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        yield cols, cut(cols)


def star_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, group, n, pos) sorted by token: pairs with pivots (kind 0), and the rows of shared tokens (kind 1)."""
    for (token, group, n, pos), at in _runs(batches, 1):
        two = at[:-1][np.diff(at) == 2]
        two = two[passes(n[two], pos[two], n[two + 1], pos[two + 1])]
        pairs = [np.stack([group[two], group[two + 1]], axis=1)]
        for r in np.flatnonzero(np.diff(at) > 2):
            a, b = at[r], at[r + 1]
            g, size, p = group[a:b], n[a:b], pos[a:b]
            left = np.lexsort((g, p / size))
            for _ in range(PIVOTS):
                if len(left) < 2:
                    break
                pivot, rest = left[0], left[1:]
                ok = passes(size[rest], p[rest], size[pivot], p[pivot])
                if ok.any():
                    pairs.append(np.stack([np.full(ok.sum(), g[pivot]), g[rest[ok]]], axis=1))
                left = rest[~ok]
        found = np.unique(np.concatenate(pairs), axis=0)
        keep = np.repeat(np.diff(at) > 1, np.diff(at))
        zeros, none = np.zeros(len(found), np.int64), int(keep.sum())
        cols = [np.concatenate([np.zeros(len(found), np.int64), np.ones(none, np.int64)]), np.concatenate([found[:, 0], token[keep]]), np.concatenate([found[:, 1], group[keep]]), np.concatenate([zeros, n[keep]]), np.concatenate([zeros, pos[keep]])]
        for k in range(0, len(cols[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000], pa.int64()) for c in cols], ["kind", "a", "b", "n", "pos"])


def rest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, j, i, side, unit, class, n, pos) sorted by token and blocks: all pairs of the two sides that differ in class and pass.

    What is found goes out after each block pair, so a task holds the pairs of few blocks.
    """
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        found = np.unique(np.concatenate(held), axis=0) if held else np.zeros((0, 2), np.int64)
        held.clear()
        for k in range(0, len(found), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 50_000, c], pa.int64()) for c in (0, 1)], ["a", "b"])

    for (_, _, _, side, unit, cls, n, pos), at in _runs(batches, 3):
        for r in np.flatnonzero(np.diff(at) > 1):
            here = np.arange(at[r], at[r + 1])
            right = here[side[here] == 1]
            for x in here[side[here] == 0]:
                y = right[cls[right] != cls[x]]
                y = y[passes(n[y], pos[y], n[x], pos[x])]
                if len(y):
                    held.append(np.stack([np.minimum(unit[x], unit[y]), np.maximum(unit[x], unit[y])], axis=1))
                    size += len(y)
                if size > HELD_PAIRS:
                    yield from flush()
                    size = 0
    yield from flush()


def spread_blocks(placed: DataFrame) -> DataFrame:
    """Rows of shingles whose units lie in several classes, dealt to block pairs.

    Only rows outside a shingle's largest class need be compared with all others: they are
    the left side. So a large class is dealt to blocks once, and what is sent to every
    block is the few rows beside it.
    """
    sizes = placed.groupBy("token", "cls").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("token").agg(F.sum("k").alias("rows"), F.max("k").alias("largest"), F.max_by("cls", "k").alias("major")).filter("largest < rows")
    mixed = mixed.select("token", "major", F.ceil(F.col("rows") / REST_BLOCK).alias("rights"), F.ceil((F.col("rows") - F.col("largest")) / REST_BLOCK).alias("lefts"))
    rows = placed.join(mixed, "token")
    draw = F.xxhash64("unit", "token")
    facts = ["unit", "cls", "n", "pos"]
    right = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("j"), F.pmod(draw, F.col("rights")).alias("i"), F.lit(1).cast("long").alias("side"), *facts)
    left = rows.filter("cls <> major").select("token", F.pmod(draw, F.col("lefts")).alias("j"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("i"), F.lit(0).cast("long").alias("side"), *facts)
    return left.unionByName(right)


def _needed(pairs: DataFrame) -> np.ndarray:
    """A bit map of fixed size with a bit for the hash of each id in pairs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select((F.pmod(F.xxhash64("id"), F.lit(1 << MAP_BITS)) + 1).alias("slot"))  # the bitmap functions count from 1
    bits = ids.groupBy(F.bitmap_bucket_number("slot").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros((1 << MAP_BITS) // 8 + 8192, np.uint8)
    for r in bits.collect():  # 2 MB at most
        k = (r["piece"] - 1) * 4096
        out[k : k + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose full sets link. Only the texts of ids in pairs are hashed again."""
    spark = docs.sparkSession
    needed = spark.sparkContext.broadcast(_needed(pairs))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            slot = batch.column(1).to_numpy(zero_copy_only=False)
            keep = needed.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
            batch = batch.filter(pa.array(keep.astype(bool)))
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(2))], pa.binary())], ["id", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    # Two rows of one id may differ in text: every set of the id is tried.
    items = texts.select("id", F.pmod(F.xxhash64("id"), F.lit(1 << MAP_BITS)).alias("slot"), "text").mapInArrow(sets, "id long, items binary")
    items = materialize(items, "join-items")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and DENOM * both >= NUMER * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(items.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b").join(items.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
    out = materialize(joined.select("a", "b", "items_a", "items_b").mapInArrow(check, "a long, b long"), "join-links")
    discard(items)
    return out


def link_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    # A stated number of partitions: AQE would merge small inputs whose work is large.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts, counts = set_facts(docs)
    named = facts.filter("n > 0 and doc_id is not null")
    # Written out, so both sides of the join come from an exchange and AQE can split a large group of copies.
    units = materialize(named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("unit")), "join-names")
    same = materialize(named.join(units, ["n", "s1", "s2"]).select("doc_id", "unit").distinct(), "join-units")

    pre = materialize(prefixes(docs, counts), "join-prefixes")
    groups = materialize(pre.groupBy(F.col("grp").alias("lead_grp")).agg(F.min("doc_id").alias("lead")), "join-groups")
    members = pre.select("doc_id", "grp").join(groups, F.col("grp") == F.col("lead_grp")).select("doc_id", "lead").join(same, "doc_id").select("lead", "unit").distinct()
    members = materialize(members, "join-members")

    leads = pre.select("doc_id", "n", "prefix", "grp").join(groups, (F.col("doc_id") == F.col("lead")) & (F.col("grp") == F.col("lead_grp")), "left_semi")
    tokens = leads.select(F.col("doc_id").alias("lead"), "n", F.posexplode("prefix").alias("pos", "token")).select("token", "lead", "n", F.col("pos").cast("long").alias("pos"))
    starred = tokens.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(star_pairs, "kind long, a long, b long, n long, pos long")
    starred = materialize(starred, "join-stars")

    # Groups expand to units; a group's units meet its own first unit as well.
    unit_of = members.groupBy("lead").agg(F.min("unit").alias("first"))
    met = starred.filter("kind = 0").select("a", "b").distinct().join(unit_of.select(F.col("lead").alias("a"), F.col("first").alias("ua")), "a").join(unit_of.select(F.col("lead").alias("b"), F.col("first").alias("ub")), "b").select("ua", "ub")
    within = members.join(unit_of, "lead").select(F.col("first").alias("ua"), F.col("unit").alias("ub"))
    pairs = met.union(within).filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
    found = materialize(pairs, "join-pairs")
    links = verify(docs, found)
    # An id with several texts ties its units together.
    several = same.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1")
    ties = same.join(several, "doc_id", "left_semi").filter("doc_id <> unit").select(F.col("unit").alias("a"), F.col("doc_id").alias("b"))
    first = connected_classes(links.union(ties))
    discard(found, units)

    heavy = leads_heavy(pre, groups)
    rows = starred.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("lead"), "n", "pos").union(heavy).union(own_rows(members))
    placed = rows.join(members, "lead").join(first.select(F.col("id").alias("unit"), F.col("class_id").alias("cls")), "unit", "left").select("token", "unit", F.coalesce("cls", "unit").alias("cls"), "n", "pos")
    placed = materialize(placed, "join-placed")
    discard(pre, starred, members, groups)
    spread = spread_blocks(placed)
    more = spread.repartition(parts, "token", "j", "i").sortWithinPartitions("token", "j", "i").mapInArrow(rest_pairs, "a long, b long").distinct()
    more = materialize(more, "join-rest")
    discard(placed)
    if not more.isEmpty():
        rest = verify(docs, more)
        again = connected_classes(links.union(rest).union(ties))
        discard(first, rest)
        first = again
    classes = same.groupBy("doc_id").agg(F.min("unit").alias("unit")).join(first.select(F.col("id").alias("unit"), "class_id"), "unit", "left").select("doc_id", F.coalesce("class_id", "unit").alias("class_id"))
    out = facts.join(classes, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("component_id"))
    out = materialize(out, "join-classes")
    discard(facts, more, links, first, same)
    return out


def own_rows(members: DataFrame) -> DataFrame:
    """A row for each group of several units, under a token of its own.

    Units of one group meet at their first shingle, which no other group need hold; later ones fail the position filter.
    """
    several = members.groupBy("lead").agg(F.count("*").alias("units")).filter("units > 1")
    # Size 1 at place 0 passes the filters: units of a group have equal sizes. A token that equals a shingle's only adds pairs to verify.
    return several.select(F.xxhash64("lead", F.lit("group")).alias("token"), "lead", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"))


def leads_heavy(pre: DataFrame, groups: DataFrame) -> DataFrame:
    """Unsalted rows of shingles that were salted, one per group."""
    heavy = pre.filter(F.size("heavy") > 0).select("doc_id", "grp", "n", "heavy", "heavy_at")
    heavy = heavy.join(groups, (F.col("doc_id") == F.col("lead")) & (F.col("grp") == F.col("lead_grp")), "left_semi")
    zipped = F.explode(F.arrays_zip("heavy", "heavy_at")).alias("h")
    return heavy.select("doc_id", "n", zipped).select(F.col("h.heavy").alias("token"), F.col("doc_id").alias("lead"), "n", F.col("h.heavy_at").cast("long").alias("pos"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class stays: that with the class's smallest id. Columns as given."""
    classes = link_classes(docs)
    gone = classes.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    gone = materialize(gone, "join-gone")
    discard(classes)
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
