"""Mixing of sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells (source, language, topic); a cell's weight is its token
count. Rounds of scaling rake the cell weights to three sets of marginal targets, until a
block of rounds changes no cell any more. A cell can't keep more tokens than it has: each
scaling stops at its upper bound, so what one cell can't give is asked of the others of its
class in the next rounds, and the kept tokens meet budget and marginals in expectation. A
class that has fewer tokens than its target keeps them all, and the rest of its target is
dealt to the other classes beforehand, in proportion to theirs. Only where the classes of
several margins leave no cells that could give more do marginals stay apart from their
targets; `cell_weights` shows by how much.

A document stays when a hash of its id falls below its cell's inclusion probability, so a
rerun keeps the same documents. Default targets temper the observed token shares
(share ** TEMPER, normalised), the usual way to lift small sources. The topic is a hash
bucket of the word that dominates the whole text: the most frequent word of at least
`TOPIC_LETTERS` letters, in lower case, the first by bytes among equals ('' without any).

Nulls in source, language or text count as their own class ('') and as empty texts.
A document without words weighs one token. Very long texts are read whole. Repeated rows
have equal fates, tables may be empty, and other columns pass through. The cell table has
as many rows as there are combinations of classes that occur. Up to MAX_BROADCAST_CELLS it
is raked in one partition and broadcast, so texts pass no shuffle. Beyond that every step
sums a margin by partial aggregation and joins the few factors back, so no class gathers
its cells in one task; steps are written out (README has the time that takes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import discard, materialize

TEMPER = 0.7
TOPICS = 5
TOPIC_LETTERS = 6
BUDGET = 0.5
#: Rounds between two looks at the change, largest change of a cell's share at rest, and rounds after which raking ends anyway.
ROUNDS, AT_REST, MAX_ROUNDS = 8, 1e-13, 400
MAX_BROADCAST_CELLS = 20_000
MARGINS = ("source", "lang", "topic")


def dominant_word(text: Column) -> Column:
    """The most frequent long word of a text."""
    words = F.array_sort(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"\\p{{L}}{{{TOPIC_LETTERS},}}"), F.lit(0)))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit("").alias("best"), F.lit(0).alias("most"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(w == a["word"], a["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.when(run > a["most"], w).otherwise(a["best"]).alias("best"), F.greatest(run, a["most"]).alias("most"))

    return F.aggregate(words, start, step, lambda a: a["best"])


def topic_of(text: Column, topics: int = TOPICS) -> Column:
    return F.conv(F.substring(F.md5(dominant_word(text)), 1, 4), 16, 10).cast("int") % topics


def token_count(text: Column) -> Column:
    """Runs of non-blank characters, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+"))).cast("long")


def draw(id_col: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def described(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic_of(text).alias("topic"), token_count(text).alias("tokens"))


def class_targets(cells: DataFrame, m: str, total: float, budget: float, targets: dict | None, few: bool) -> DataFrame:
    """The classes of a margin with their target shares, none above what the class has; the excess goes to the others."""
    if targets:
        known = F.coalesce(*[F.when(F.col(m) == k, F.lit(float(v))) for k, v in targets.items()], F.lit(0.0))
    else:
        known = F.pow(F.sum("cell_tokens") / total, F.lit(TEMPER))
    grouped = cells.groupBy(m).agg(F.sum("cell_tokens").alias("class_tokens"), *([] if targets else [known.alias("w")]))
    classes = (grouped.withColumn("w", known) if targets else grouped).withColumn("most", F.col("class_tokens") / (budget * total))
    classes = classes.select(m, "w", "most")
    if not few:  # few cells are summed again sooner than their sums are written
        classes = materialize(classes, "mix-classes")
    factor = -1.0
    while True:  # the more classes are at their bound, the larger the factor of the others
        full = (F.col("most") <= F.col("w") * factor) if factor >= 0 else F.lit(False)
        left, weight = classes.agg(F.lit(1.0) - F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.sum(F.when(~full, F.col("w")))).first()
        new = left / weight if weight else factor
        if new <= factor:
            return classes.select(m, F.least("most", F.col("w") * max(factor, 0.0)).alias(f"want_{m}"))
        factor = new


def cell_weights(facts: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Cells with their tokens, raked share and inclusion probability; hinted for broadcast if few."""
    cells = materialize(facts.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("cell_tokens")), "mix-cells")
    n, total = cells.agg(F.count("*"), F.sum("cell_tokens")).first()
    total = total or 1.0
    few = n <= MAX_BROADCAST_CELLS
    scratch = [cells]
    for m in MARGINS:
        cells = cells.join(class_targets(scratch[0], m, total, budget, (targets or {}).get(m), few), m)
    cells = cells.withColumn("most", F.col("cell_tokens") / (budget * total)).withColumn("share", F.col("cell_tokens") / total).withColumn("before", F.col("share"))

    def scaled(cells: DataFrame, m: str) -> DataFrame:
        new = F.when(F.col("share") > 0, F.least("most", F.col("share") * F.col(f"want_{m}") / F.col("sum"))).otherwise(0.0)
        if few:  # one partition satisfies every window, so no round shuffles
            return cells.withColumn("sum", F.sum("share").over(Window.partitionBy(m))).withColumn("share", new).drop("sum")
        sums = cells.groupBy(m).agg(F.sum("share").alias("sum"))
        return materialize(cells.join(sums, m).withColumn("share", new).drop("sum"), "mix-step")

    rounds = 0
    while n and rounds < max_rounds:
        now = (cells.coalesce(1) if few else cells).withColumn("before", F.col("share"))
        for _ in range(ROUNDS):
            for m in MARGINS:
                now = scaled(now, m)
        cells = materialize(now, "mix-rounds")
        discard(*scratch)
        scratch = [cells]
        rounds += ROUNDS
        if cells.agg(F.max(F.abs(F.col("share") - F.col("before")))).first()[0] <= AT_REST:
            break
    inclusion = F.least(F.lit(1.0), F.col("share") / F.col("most"))
    cells = cells.select(*MARGINS, "cell_tokens", "share", inclusion.alias("inclusion"))
    return F.broadcast(cells) if few else cells


def sample(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """One row per document: its cell, tokens, inclusion probability and whether it stays."""
    facts = materialize(described(docs), "mix-facts")  # a few numbers and names a document
    cells = cell_weights(facts, targets, budget)
    return facts.join(cells, list(MARGINS)).select("doc_id", *MARGINS, "tokens", F.round("inclusion", 6).alias("inclusion"), (draw(F.col("doc_id")) < F.col("inclusion")).alias("kept"))


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """The documents that stay, all columns as given."""
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")  # so no given name can clash
    own = docs.select(whole, F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic_of(F.col("text")).alias("topic"))
    cells = cell_weights(described(docs), targets, budget).select(*MARGINS, "inclusion")
    return own.join(cells, list(MARGINS)).filter(draw(F.col("id")) < F.col("inclusion")).select("row.*")


def oracle(budget: float = BUDGET, rounds: int = 32) -> str:
    """The same in DuckDB SQL over documents, with a number of rounds that brings its tables to rest."""
    facts = rf"""d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
    long AS (SELECT rid, unnest(regexp_extract_all(lower(text), '\p{{L}}{{{TOPIC_LETTERS},}}')) AS word FROM d),
    dominant AS (SELECT rid, word FROM long GROUP BY rid, word QUALIFY row_number() OVER (PARTITION BY rid ORDER BY count(*) DESC, word) = 1),
    facts AS (SELECT doc_id, source, lang, ('0x' || substr(md5(coalesce(word, '')), 1, 4))::INT % {TOPICS} AS topic, greatest(1, len(regexp_extract_all(text, '[^ \t-\r]+')))::BIGINT AS tokens FROM d LEFT JOIN dominant USING (rid))"""
    parts = [facts, "c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS cell_tokens, sum(sum(tokens)::DOUBLE) OVER () AS all_tokens FROM facts GROUP BY ALL)"]
    for m in MARGINS:
        # Water filling: of the factors with k classes at their bound the largest is the one.
        parts.append(f"k_{m} AS (SELECT {m}, pow(sum(cell_tokens) / any_value(all_tokens), {TEMPER}) AS w, sum(cell_tokens) / ({budget} * any_value(all_tokens)) AS most FROM c0 GROUP BY {m})")
        parts.append(f"f_{m} AS (SELECT *, (1 - (sum(most) OVER (ORDER BY most / w, {m} ROWS UNBOUNDED PRECEDING) - most)) / sum(w) OVER (ORDER BY most / w DESC, {m} DESC ROWS UNBOUNDED PRECEDING) AS f FROM k_{m})")
        parts.append(f"t_{m} AS (SELECT {m}, least(most, w * (SELECT max(f) FROM f_{m})) AS want_{m} FROM f_{m})")
    parts.append(f"s0 AS (SELECT c0.*, want_source, want_lang, want_topic, cell_tokens / ({budget} * all_tokens) AS most, cell_tokens / all_tokens AS share FROM c0 JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            k += 1
            parts.append(f"s{k} AS (SELECT * REPLACE (CASE WHEN share > 0 THEN least(most, share * want_{m} / sum(share) OVER (PARTITION BY {m})) ELSE 0 END AS share) FROM s{k - 1})")
    parts.append(f"cells AS (SELECT source, lang, topic, least(1.0, share / most) AS inclusion FROM s{k})")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, tokens, round(inclusion, 6) AS inclusion, ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < inclusion AS kept FROM facts JOIN cells USING (source, lang, topic)"
