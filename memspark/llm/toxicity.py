"""Toxic passages: maximum-scoring segments of token log-odds.

Tokens are words of letters, marks and digits, lower-cased. A token's score is the log of how
much likelier it is in texts labelled toxic than in others, less `PENALTY`. The odds come from counts
of texts under nested Dirichlet priors: the share of label 1 among the texts with a word has as its prior
the share among texts with its first six letters, that one the share of the first five, and so on to three
letters and to all texts; each prior counts like `STRENGTH` texts. An unseen word thus scores as its stem,
and one with an unseen stem 0 less the penalty. As words come in bursts, a text counts once for a word, and
the j-th occurrence in a text carries 1/j^2 of the odds if they are above 0. Counts are kept in 2^20 slots by
hash whatever the vocabulary. The classifier is fitted on at most about `MOST_LABELLED` labelled ids (a bound that is
an argument), with all rows of each.

Every maximal segment of a text's scores is found by the linear scan of Ruzzo and Tompa, over
blocks of equal sign. Under the scores of tokens in texts labelled 0, the best segment of n tokens
follows an extreme-value distribution P(S >= s) = 1 - exp(-K n exp(-lambda s)) (Karlin and Altschul):
lambda solves sum(p exp(lambda s)) = 1 over all such tokens, K is its maximum-likelihood value over all such
texts. Segments with K n exp(-lambda s) of at most `SIGNIFICANT` are the passages. The segments of a text are
aggregated by the sum statistic, the least probability of its r best segments over all r, and a logistic curve of
the negative logarithm gives the score. Scores that lambda, K and the curve are fitted on leave out
the counts of the text itself.

Defined cases: a null or empty text or one without a word has no passage and gets the score of no evidence.
Of several labels of one id, 1 wins; null labels and labels of unknown ids count for nothing; repeated rows
are scored alike. Without labels, or with labels of one kind only, every score is the share of label 1 (0 without any).
Very long texts are scored whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import discard, materialize, mix64, slices
from memspark.llm.words import spans_of

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
STEMS = (3, 4, 5, 6)
STRENGTH, PENALTY, SIGNIFICANT = 4.0, 0.5, 0.01
#: Labelled ids that are learned from; of more, about so many are drawn by hash.
MOST_LABELLED = 200_000
#: Bins of token scores, from -BIN_EDGE to BIN_EDGE, and of evidence, which counts up to MOST_EVIDENCE in the fit of the curve.
BINS, BIN_EDGE, EVIDENCE_STEP, MOST_EVIDENCE = 4000, 20.0, 0.05, 60.0
#: Characters that one step works on, and characters of a word that are hashed one at a time; longer words are hashed at once.
STEP_CHARS, STEPPED = 1 << 20, 64
_PLANE = 1 << 16
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Which code points of the basic plane belong to words, and their lower case; made once a process."""
    if not _TABLES:
        chars = [chr(i) for i in range(_PLANE)]
        low = [c.lower() for c in chars]
        _TABLES.extend([np.array([unicodedata.category(c)[0] in "LMN" for c in chars] + [True]), np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint32)])
    return _TABLES


class Tokens:
    """Tokens of some texts: row, first and last character, and a slot for each stem and the word (-1: too short for the stem)."""

    def __init__(self, texts: list[str | None]) -> None:
        of_words, low = _tables()
        points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = spans_of(np.array([len(t or "") for t in texts], np.int64))
        basic = np.minimum(points, _PLANE)
        points = np.where(basic < _PLANE, low[np.minimum(basic, _PLANE - 1)], points)
        word = of_words[basic]
        edge = np.zeros(len(points) + 1, bool)
        edge[rows] = True
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1] | edge[1:-1]
        closes[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.at = np.searchsorted(starts, rows)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.at))
        self.start, self.end = starts - rows[self.row], ends - rows[self.row]
        self.slots = self._slots(points.astype(np.uint64), starts, ends - starts)

    def occurrence(self) -> np.ndarray:
        """For each token, how many times its word has occurred in its text so far, itself included."""
        key = self.row * SLOTS + self.slots[-1]
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(key)]
        place = np.arange(len(key))
        out = np.empty(len(key), np.int64)
        out[order] = place - np.maximum.accumulate(np.where(first, place, 0)) + 1
        return out

    @staticmethod
    def _slots(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        slots = np.full((len(STEMS) + 1, len(starts)), -1, np.int32)
        h = np.zeros(len(starts), np.uint64)
        shift = np.uint64(64 - SLOT_BITS)
        left, k = np.arange(len(starts)), 0
        while len(left) and k < STEPPED:
            h[left] = h[left] * np.uint64(0x9E3779B97F4A7C15) + points[starts[left] + k] + np.uint64(1)
            k += 1
            if k in STEMS:
                slots[STEMS.index(k), left] = mix64(h[left] ^ np.uint64(k << 32)) >> shift
            left = left[sizes[left] > k]
        for i in left:
            h[i] = xxhash.xxh3_64_intdigest(points[starts[i] : starts[i] + sizes[i]].tobytes())
        slots[-1] = mix64(h) >> shift
        return slots


def steps_of(texts: list[str | None], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `limit` characters, or one longer text."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t or "") > limit:
            yield i, j
            i, size = j, 0
        size += len(t or "")
    if i < len(texts):
        yield i, len(texts)


class Odds:
    """Texts by slot, of label 1 and of both labels, and the numbers of all texts."""

    def __init__(self, ones: np.ndarray, both: np.ndarray, n_ones: float, n_both: float) -> None:
        self.ones, self.both, self.n_ones, self.n_both = ones, both, n_ones, n_both

    def scores(self, tokens: Tokens, labels: np.ndarray | None = None, strength: float = STRENGTH, penalty: float = PENALTY) -> np.ndarray:
        """Score of each token; with the labels of the rows, the counts of a token's own row are left out."""
        own = np.zeros(len(tokens.row)) if labels is None else labels[tokens.row].astype(np.float64)
        alone = labels is not None
        base = np.clip((self.n_ones - own) / max(self.n_both - alone, 1), 1e-9, 1 - 1e-9)
        share = base.copy()
        for slots in tokens.slots:
            there = np.flatnonzero(slots >= 0)
            s = slots[there]
            share[there] = (self.ones[s] - own[there] + strength * share[there]) / (self.both[s] - alone + strength)
        odds = np.log(share / (1 - share)) - np.log(base / (1 - base))
        return np.where(odds > 0, odds / tokens.occurrence() ** 2, odds) - penalty


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(start, end, sum) of all maximal scoring segments, in order, in linear time (Ruzzo and Tompa)."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum with it, last one with a smaller sum before
    total = 0.0
    for i, s in enumerate(scores):
        if s > 0:
            start, before, after = i, total, total + s
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= before:
                    j = found[j][4]
                if j < 0 or found[j][3] >= after:
                    found.append((start, i + 1, before, after, j))
                    break
                start, before = found[j][0], found[j][2]
                del found[j:]
        total += s
    return [(a, b, y - x) for a, b, x, y, _ in found]


def segments(tokens: Tokens, scores: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """Rows that have a token above 0, with their maximal segments as (first token, end, sum)."""
    positive = scores > 0
    if not positive.any():
        return
    change = np.ones(len(scores), bool)
    change[1:] = (positive[1:] != positive[:-1]) | (tokens.row[1:] != tokens.row[:-1])
    block = np.flatnonzero(change)
    sums, row = np.add.reduceat(scores, block), tokens.row[block]
    ends = np.append(block[1:], len(scores))
    at = np.searchsorted(row, np.arange(len(tokens.at)))
    for r in np.unique(tokens.row[positive]):
        a, b = at[r], at[r + 1]
        yield int(r), [(int(block[a + i]), int(ends[a + j - 1]), s) for i, j, s in maximal_segments(sums[a:b].tolist())]


def evidence(sums: list[float], n: int, lam: float, k: float) -> float:
    """-ln of the least probability, over r, that chance gives the r best segments of n tokens their sums or more."""
    if not sums:
        return 0.0
    x = np.cumsum(lam * np.sort(np.array(sums))[::-1] - math.log(max(k * n, 1e-300)))
    r = np.arange(1, len(x) + 1)
    x_ = np.maximum(x, 1e-9)
    lg = np.array([math.lgamma(i + 1) + math.lgamma(i) for i in r])
    value = np.where(x >= r, x_ - (r - 1) * np.log(x_) + lg, 0.0)  # the formula holds for sums well above what chance gives
    return float(max(0.0, value.max()))


def solve_lambda(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum(p exp(lambda s)) = 1 for scores with a negative mean; without a positive score none is needed."""
    p = counts / counts.sum()
    if not (counts[scores > 0] > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    grown = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while grown(high) < 0:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if grown(middle) < 0 else (low, middle)
    return (low + high) / 2


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton steps; n rows of each (x, share y of ones)."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        w = n * p * (1 - p) + 1e-12
        g = np.array([(n * (y - p)).sum(), (n * (y - p) * x).sum()]) - ridge * np.array([a, b])
        hess = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        da, db = np.linalg.solve(hess, g)
        size = max(abs(da), abs(db))
        scale = min(1.0, 2.0 / size) if size else 1.0
        a, b = a + scale * da, b + scale * db
        if size < 1e-9:
            break
    return float(a), float(b)


class Model:
    """Odds, the two constants of chance, and the curve from evidence to score."""

    def __init__(self, odds: Odds | None, share: float, lam: float = 1.0, k: float = 1.0, curve: tuple[float, float] = (0.0, 0.0)) -> None:
        self.odds, self.share, self.lam, self.k, self.curve = odds, share, lam, k, curve

    def judge(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, int, float, float]]]]:
        """Score and significant passages (first character, end, sum, expected number by chance) of each text."""
        if self.odds is None:
            yield from ((self.share, []) for _ in texts)
            return
        a, b = self.curve
        for i, j in steps_of(texts):
            tokens = Tokens(texts[i:j])
            of_row = dict(segments(tokens, self.odds.scores(tokens)))
            for r in range(j - i):
                n, x, passages = int(tokens.at[r + 1] - tokens.at[r]), 0.0, []
                if r in of_row:
                    x = min(evidence([s for _, _, s in of_row[r]], n, self.lam, self.k), MOST_EVIDENCE)
                    for first, end, s in of_row[r]:
                        by_chance = self.k * n * math.exp(-self.lam * s)
                        if by_chance <= SIGNIFICANT:
                            passages.append((int(tokens.start[first]), int(tokens.end[end - 1]), s, by_chance))
                yield 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x)))), passages


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def known_labels(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """of, toxic: one row for each labelled id that isn't held out; of more than `most` about that many, drawn by a hash of the id."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy(F.col("doc_id").alias("of")).agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = materialize(known, "toxicity-known")
    n = known.count()
    if n <= most:
        return known
    drawn = materialize(known.filter(F.xxhash64(F.lit("toxicity"), "of").cast("double") / 2.0**64 + 0.5 <= most / n), "toxicity-known")
    discard(known)
    return drawn


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """toxic, text of the documents that `known` has; texts pass no shuffle."""
    rows = docs.select("doc_id", "text").filter(F.length("text") > 0)
    return rows.join(F.broadcast(known), F.col("doc_id") == F.col("of")).select("toxic", "text")  # about MOST_LABELLED short rows at most


def count_tokens(rows: DataFrame) -> Odds:
    """Texts by slot, over all rows; each task sends one row a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, both, n = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), np.zeros(2, np.int64)
        for batch in slices(batches):
            toxic, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in steps_of(texts):
                tokens = Tokens(texts[i:j])
                n += (int(toxic[i:j].sum()), j - i)
                for s in tokens.slots:
                    row, slot = np.divmod(np.unique(tokens.row[s >= 0] * SLOTS + s[s >= 0]), SLOTS)
                    np.add.at(both, slot, 1)
                    np.add.at(ones, slot[toxic[i:j][row] == 1], 1)
        there = np.flatnonzero(both)
        columns = np.append(there, -1), np.append(ones[there], n[0]), np.append(both[there], n[1])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["slot", "ones", "both"])

    counts = rows.mapInArrow(run, "slot long, ones long, both long").groupBy("slot").agg(F.sum("ones").alias("ones"), F.sum("both").alias("both"))
    table = counts.toArrow()  # a row a slot at most
    slot, one, two = (table.column(k).to_numpy() for k in range(3))
    ones, both = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)
    at = slot >= 0
    ones[slot[at]], both[slot[at]] = one[at], two[at]
    return Odds(ones, both, float(one[~at].sum()), float(two[~at].sum()))


def measured(rows: DataFrame, odds: Odds) -> DataFrame:
    """Of each labelled text its number of tokens and sums of segments without its own counts; and how scores of clean tokens are spread."""
    shared = rows.sparkSession.sparkContext.broadcast(odds)
    names = ["toxic", "n", "sums", "bin", "tokens"]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.zeros(BINS, np.int64)
        for batch in slices(batches):
            toxic, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in steps_of(texts):
                tokens = Tokens(texts[i:j])
                scores = shared.value.scores(tokens, toxic[i:j].astype(np.int64))
                clean = scores[toxic[i:j][tokens.row] == 0]
                spread += np.bincount(np.clip((clean + BIN_EDGE) * (BINS / 2 / BIN_EDGE), 0, BINS - 1).astype(np.int64), minlength=BINS)
                of_row = dict(segments(tokens, scores))
                sums = [[s for _, _, s in of_row.get(r, [])] for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((toxic[i:j], np.diff(tokens.at), sums, [None] * (j - i), [None] * (j - i)), kinds, strict=True)], names)
        there = np.flatnonzero(spread)
        none = [None] * len(there)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((none, none, none, there, spread[there]), kinds, strict=True)], names)

    return rows.mapInArrow(run, "toxic int, n long, sums array<double>, bin int, tokens long")


def evidence_counts(texts: DataFrame, lam: float, k: float) -> DataFrame:
    """Texts of each label by step of evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            toxic, n, sums = (c.to_pylist() for c in batch.columns)
            steps = [int(min(evidence(s, m, lam, k), MOST_EVIDENCE) / EVIDENCE_STEP) for s, m in zip(sums, n, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(steps, pa.int32())], ["toxic", "step"])

    return texts.select("toxic", "n", "sums").mapInArrow(run, "toxic int, step int").groupBy("step").agg(F.count("*").alias("n"), F.sum("toxic").alias("ones"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Learn from labelled documents that aren't held out."""
    known = known_labels(labels, most)
    rows = materialize(labelled(docs, known), "toxicity-labelled")
    discard(known)
    odds = count_tokens(rows)
    if not 0 < odds.n_ones < odds.n_both:
        discard(rows)
        return Model(None, odds.n_ones / max(1, odds.n_both))
    facts = materialize(measured(rows, odds), "toxicity-facts")
    discard(rows)
    spread = np.zeros(BINS)
    for r in facts.filter("bin is not null").groupBy("bin").agg(F.sum("tokens").alias("tokens")).collect():  # at most BINS rows
        spread[r["bin"]] = r["tokens"]
    lam = solve_lambda((np.arange(BINS) + 0.5) * (2 * BIN_EDGE / BINS) - BIN_EDGE, spread)
    best = F.coalesce(F.array_max("sums"), F.lit(0.0))
    clean = facts.filter("toxic = 0 and n > 0").agg(F.count("*").alias("rows"), F.sum(F.col("n") * F.exp(-lam * best)).alias("mass")).first()
    k = clean["rows"] / clean["mass"] if clean["rows"] else 1.0
    steps = evidence_counts(facts.filter("toxic is not null"), lam, k).collect()  # at most MOST_EVIDENCE / EVIDENCE_STEP rows
    discard(facts)
    x, m, ones = (np.array([r[c] for r in steps], float) for c in ("step", "n", "ones"))
    return Model(odds, odds.n_ones / odds.n_both, lam, k, fit_curve(x * EVIDENCE_STEP, ones / m, m))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted and the significant passages, whose places are characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64()), ("by_chance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(shared.value.judge(batch.column(1).to_pylist()))
            score = np.array([s for s, _ in found], float)
            lists = [[dict(zip(("start", "end", "sum", "by_chance"), p, strict=True)) for p in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(lists, pa.list_(passage))], [id_col, "score", "predicted", "passages"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, passages array<struct<start:long,end:long,sum:double,by_chance:double>>")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit, then judge every document: doc_id, held_out, score, predicted, passages."""
    found = judge(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "passages")
