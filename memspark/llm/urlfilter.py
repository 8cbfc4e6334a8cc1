"""URL filter: host and path rules first, then word segmentation and multinomial naive Bayes.

Words concatenated in host labels and path pieces are split by a unigram Viterbi search over the words of
the whole texts of all pages, however rare. Each distinct piece is split once: its substrings meet the word counts in a
join, so no task holds the dictionary, and a piece that many hosts share is no word unless pages use it.

The urls that a rule fits are the labelled examples: the rule's verdict is their class. The rule's own pieces are
left out of them, so that the words around it count and not the rule again. A multinomial naive Bayes model
(Laplace smoothing) of their host and path tokens judges the urls that no rule fits. A token counts if `MIN_HOSTS`
hosts of one class have it, since one host's words tell of that host only. The prior is an argument, not the share of blocked
examples, which tells how rules were written and not how common bad urls are. A url without any token that counts is allowed.

A null url or one without `://` has an empty host and path, no tokens, and is allowed.
An empty table gives no rows; without examples of both classes everything unruled is allowed, and
so is a tie (a probability of 0.5). Long urls are segmented whole: a piece of n letters is 24 n substrings and words of at most
that length. Repeated rows agree, page ids may be null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import discard, lookup, materialize

#: (verdict, host, path) of the rules; a rule's text is host + path, the longest that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Hosts of one class that make a token count, and the probability of block before any token is seen.
MIN_HOSTS, PRIOR = 2, 0.1
LONGEST_WORD = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What isn't text in a page.
_MARKUP = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>|&#?\w+;"
_PIECES = "\\p{L}+|\\p{Nd}+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later ones, the longer, take precedence
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def split(piece: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable cut of a piece into words; an unknown word of k letters has probability 10 / total / 10^k."""
    total = max(total, 1)
    log = {w: math.log(c / total) for w, c in counts.items()}
    unknown = [math.log(10 / total) - k * math.log(10) for k in range(LONGEST_WORD + 1)]
    best, cut = [0.0], [0]
    for j in range(1, len(piece) + 1):
        options = ((best[i] + log.get(piece[i:j], unknown[j - i]), -i) for i in range(max(0, j - LONGEST_WORD), j))
        value, i = max(options)
        best.append(value)
        cut.append(-i)
    out, j = [], len(piece)
    while j:
        out.append(piece[cut[j] : j])
        j = cut[j]
    return out[::-1]


def word_counts(pages: DataFrame) -> DataFrame:
    """word, count of all page texts; words longer than LONGEST_WORD can't be found in a piece."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), _MARKUP, " "))
    words = pages.select(F.explode(F.split(text, "[^\\p{L}]+")).alias("word")).filter(F.length("word").between(1, LONGEST_WORD))
    return words.groupBy("word").agg(F.count("*").alias("count"))


def segmented(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """piece, words of each distinct letter piece."""
    total = words.agg(F.sum("count")).first()[0] or 0
    spots = pieces.select("piece", F.explode(F.expr("sequence(1, length(piece))")).alias("at"))
    spots = spots.select("piece", "at", F.explode(F.expr(f"sequence(1, least({LONGEST_WORD}, length(piece) - at + 1))")).alias("n"))
    parts = materialize(spots.select("piece", F.expr("substring(piece, at, n)").alias("word")).distinct(), "url-substrings")
    known = lookup(parts, words, ["word"]).groupBy("piece").agg(F.collect_list(F.struct("word", "count")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, known = (c.to_pylist() for c in batch.columns)
            cut = [split(p, {k["word"]: k["count"] for k in ks or ()}, total) for p, ks in zip(piece, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.string()))], ["piece", "words"])

    found = materialize(pieces.join(known, "piece", "left").select("piece", "known").mapInArrow(run, "piece string, words array<string>"), "url-segments")
    discard(parts)
    return found


def _raw_pieces(host: Column, path: Column) -> Column:
    """Array of (mark, piece) of host and path: marks tell the two apart."""
    each = lambda text, mark: F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), lambda p: F.struct(F.lit(mark).alias("mark"), p.alias("piece")))
    return F.concat(each(host, "h:"), each(F.lower(path), "p:"))


def parts_of(pages: DataFrame, rules: tuple) -> DataFrame:
    """row, page_id, host, path, rule, ruled, pieces of every page."""
    host, path = host_and_path(F.col("url"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "ruled": ruled})
    return materialize(parts.withColumn("pieces", _raw_pieces(F.col("host"), F.col("path"))).withColumn("row", F.monotonically_increasing_id()), "url-parts")


def tokens_of(parts: DataFrame, words: DataFrame) -> DataFrame:
    """row, host, rule, ruled, pos, k, piece (marked), token: tokens in order; a number is the token 0."""
    pieces = parts.select("row", "host", "rule", "ruled", F.posexplode("pieces").alias("pos", "p")).select("row", "host", "rule", "ruled", "pos", "p.mark", "p.piece")
    pieces = materialize(pieces, "url-pieces")
    number = F.col("piece").rlike("^\\p{Nd}")
    cut = segmented(pieces.filter(~number).select("piece").distinct(), words)
    letters = materialize(pieces.filter(~number), "url-letters")
    split_ = lookup(letters, cut, ["piece"]).select("row", "host", "rule", "ruled", "pos", "mark", "piece", F.posexplode("words").alias("k", "word"))
    numbers = pieces.filter(number).select("row", "host", "rule", "ruled", "pos", "mark", "piece", F.lit(0).alias("k"), F.lit("0").alias("word"))
    every = split_.unionByName(numbers)
    tokens = materialize(every.select("row", "host", "rule", "ruled", "pos", "k", F.concat("mark", "piece").alias("piece"), F.concat("mark", "word").alias("token")), "url-tokens")
    discard(pieces, letters, cut)
    return tokens


def token_odds(tokens: DataFrame, rules: tuple = RULES, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """token, odds: log odds of block against allow of tokens that enough hosts of one class have."""
    own = F.create_map(*[x for _, h, p in rules for x in (F.lit(h + p), F.transform(_raw_pieces(F.lit(h), F.lit(p)), lambda r: F.concat(r["mark"], r["piece"])))]) if rules else None
    ruled = tokens.filter("ruled is not null")
    if own is not None:
        ruled = ruled.filter(~F.array_contains(F.try_element_at(own, F.col("rule")), F.col("piece")))
    hosts = ruled.groupBy("token", "ruled", "host").agg(F.count("*").alias("n"))
    of = lambda kind, c: F.sum(F.when(F.col("ruled") == kind, c).otherwise(0))
    counts = hosts.groupBy("token").agg(of("allow", F.col("n")).alias("allow"), of("block", F.col("n")).alias("block"), F.greatest(of("allow", F.lit(1)), of("block", F.lit(1))).alias("hosts"))
    counts = materialize(counts, "url-counts")
    kinds, allow, block = counts.agg(F.count("*"), F.sum("allow"), F.sum("block")).first()
    if not allow or not block:
        return counts.filter(F.lit(False)).select("token", F.lit(0.0).cast("decimal(28,18)").alias("odds"))
    odds = F.log((F.col("block") + 1) / F.lit(block + kinds + 1)) - F.log((F.col("allow") + 1) / F.lit(allow + kinds + 1))
    # Decimals, so that sums don't hang on their order.
    return counts.filter(F.col("hosts") >= min_hosts).select("token", odds.cast("decimal(28,18)").alias("odds"))


def block_scores(tokens: DataFrame, odds: DataFrame, prior: float = PRIOR) -> DataFrame:
    """row, block_score of the rows that have a token that counts."""
    z = F.sum("odds").cast("double") + math.log(prior / (1 - prior))
    return lookup(tokens.select("row", "token"), odds, ["token"]).groupBy("row").agg((1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))).alias("block_score"))


def judge(pages: DataFrame, rules: tuple = RULES, prior: float = PRIOR, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """page_id, host, path, rule, verdict, block probability by the method (0 without a token that counts) and the segments."""
    parts = parts_of(pages, rules)
    words = materialize(word_counts(pages), "url-words")
    tokens = tokens_of(parts, words)
    scores = block_scores(tokens, token_odds(tokens, rules, min_hosts), prior)
    listed = tokens.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k", "token"))), lambda t: t["token"]), " ").alias("segments"))
    score = F.coalesce("block_score", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(score > 0.5, "block").otherwise("allow"))
    found = parts.join(scores, "row", "left").join(listed, "row", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("block_score"), F.coalesce("segments", F.lit("")).alias("segments"))
    found = materialize(found, "url-verdicts")
    discard(parts, words, tokens)
    return found


def held_out_figures(pages: DataFrame, rules: tuple = RULES, prior: float = 0.5, min_hosts: int = MIN_HOSTS) -> dict[str, int]:
    """How the method judges ruled urls of hosts it hasn't seen (a fifth of all hosts, by hash), the rules' pieces left out: counts of (rule's verdict)_(method's)."""
    tokens = tokens_of(parts_of(pages, rules), word_counts(pages))
    unseen = F.pmod(F.xxhash64("host"), F.lit(5)) == 0
    odds = token_odds(tokens.filter(~unseen), rules, min_hosts)
    own = F.create_map(*[x for _, h, p in rules for x in (F.lit(h + p), F.transform(_raw_pieces(F.lit(h), F.lit(p)), lambda r: F.concat(r["mark"], r["piece"])))])
    asked = tokens.filter(unseen & F.col("ruled").isNotNull())
    around = materialize(asked.filter(~F.array_contains(F.try_element_at(own, F.col("rule")), F.col("piece"))), "url-asked")
    scores = block_scores(around, odds, prior)
    said = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    rows = asked.select("row", "ruled").distinct().join(scores, "row", "left").groupBy("ruled", said.alias("said")).count().collect()
    return {f"{r['ruled']}_{r['said']}": r["count"] for r in rows}
