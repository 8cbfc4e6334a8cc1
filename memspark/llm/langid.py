"""Language identification with string kernels.

Kernel: blended spectrum of character 1- to 4-grams by presence, n-grams hashed to
`DIM` slots, normalised: k(x, y) = |x & y| / sqrt(|x| |y|). Nystroem landmarks give
features K(x, L) K(L, L)^(-1/2); a ridge regression per language (one versus rest)
is solved on them. As K(x, L) = P(x) Lt is linear in the presence row P(x), scoring a
batch is one matrix product of its presence matrix with (Lt A), A being the ridge
weights seen through the landmarks.

Presence says nothing once most n-grams occur, so a text is compared in windows of at most
`WINDOW` characters that cover all of it, and its kernel is the mean of theirs: a text of any length
is scored like one window of average content.

The fit reads a bounded sample of labelled rows: `PER_LANG` a language, those with the
smallest hashes of id and text, and of a longer text the window that the hash names; beyond `TOTAL / PER_LANG`
languages every language gives `TOTAL` over their number. The `MOST_LANGS` most frequent languages are learned (ties by name), each with
one row at least, which bounds the driver, the model and the broadcast whatever the column `lang` holds. Every whole
text is scored, also very long ones. Null texts and texts without a
letter get `und` and score 0; a tie of scores goes to the first language by name. Rows are
scored one by one, so repeated rows agree; an empty table gives an empty result, and
without labelled rows all texts are `und`. Columns besides those named are ignored,
whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.llm.common import materialize, slices

DIM_BITS = 15
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3, 4)
#: Labelled rows of one language, of all languages where they are many, and languages that are learned.
PER_LANG, TOTAL, MOST_LANGS = 600, 60_000, 1000
#: Characters of a window, its n-grams beginning in it.
WINDOW = 2048
LANDMARKS = 400
RIDGE = 1e-2
#: Steepness of the logistic curve from a ridge output (targets -1 and 1) to a score.
SLOPE = 4.0
UNKNOWN = "und"
#: Characters that one step works on, so a very long text takes little more memory than itself.
PIECE = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_PLANE = 1 << 16
_IS_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Letters and marks of the basic plane; made once a process. Code points beyond it count as letters."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(_PLANE)] + [True]))
    return _IS_LETTER[0]


def _plain(text: str) -> np.ndarray:
    """Code points of the lower-cased text with a blank at either end, runs of other than letters as one blank."""
    parts, open_run = [], False
    for k in range(0, max(1, len(text)), PIECE):
        c = np.frombuffer(f"{' ' * (k == 0)}{text[k : k + PIECE].lower()}{' ' * (k + PIECE >= len(text))}".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[np.minimum(c, _PLANE)]
        parts.append(np.where(letter, c, np.uint32(32))[letter | np.concatenate([[not open_run], letter[:-1]])])
        open_run = not letter[-1]
    return np.concatenate(parts)


def window_count(plain: np.ndarray) -> int:
    return max(1, -(-len(plain) // WINDOW))


def presence(plain: np.ndarray, first: int, end: int, out: np.ndarray) -> None:
    """Mark in the rows of out which hashed n-grams begin in windows first to end of a plain text; windows are of equal size."""
    count = window_count(plain)
    borders = len(plain) * np.arange(first, end + 1) // count
    c = plain[borders[0] : borders[-1] + max(ORDERS) - 1]
    own = np.repeat(np.arange(end - first), np.diff(borders))
    shift = np.uint32(32 - DIM_BITS)
    h = np.zeros(len(c), dtype=np.uint32)
    for n in ORDERS:
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
        k = min(len(h), len(own))
        out[own[:k], (h[:k] * np.uint32(0x9E3779B1)) >> shift] = 1


def window_rows(texts: list[str], block: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Presence rows of all windows of all texts, at most `block` at a time, with the text each belongs to."""
    rows, owner = np.zeros((block, DIM), np.uint8), []
    for i, text in enumerate(texts):
        plain = _plain(text)
        at, count = 0, window_count(plain)
        while at < count:
            take = min(block - len(owner), count - at)
            presence(plain, at, at + take, rows[len(owner) : len(owner) + take])
            owner += [i] * take
            at += take
            if len(owner) == block:
                yield rows, np.array(owner)
                rows, owner = np.zeros((block, DIM), np.uint8), []
    if owner:
        yield rows[: len(owner)], np.array(owner)


def one_window(text: str, draw: int) -> np.ndarray:
    """The presence row of the window that draw names."""
    plain = _plain(text)
    at = draw % window_count(plain)
    out = np.zeros((1, DIM), np.uint8)
    presence(plain, at, at + 1, out)
    return out[0]


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


class Model:
    """Languages and the matrix that presence rows are multiplied with."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.langs, self.weights, self.bias = langs, weights, bias

    def predict(self, texts: list[str | None], block: int = 64) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return lang, score
        live = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        total, windows = np.zeros((len(live), len(self.langs))), np.zeros(len(live))
        for rows, owner in window_rows([texts[i] for i in live], block):
            p = rows.astype(np.float32)
            np.add.at(total, owner, (p @ self.weights) / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1)))
            np.add.at(windows, owner, 1)
        out = total / np.maximum(windows, 1)[:, None] + self.bias
        best = out.argmax(axis=1)
        for i, b, v in zip(live, best, out[np.arange(len(live)), best], strict=True):
            lang[i], score[i] = self.langs[b], float(1 / (1 + np.exp(-SLOPE * v)))
        return lang, score


def fit_rows(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Ridge regression on Nystroem features of packed presence rows, given in a fixed order."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32))
    bits = np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), -1)

    def normal(part: np.ndarray) -> np.ndarray:
        p = np.unpackbits(part, axis=1)[:, :DIM].astype(np.float32)
        return p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))

    y = np.where(np.array([lang for lang, _ in rows])[:, None] == np.array(langs)[None], 1.0, -1.0)
    pick = np.concatenate([np.flatnonzero(y[:, c] > 0)[: max(1, landmarks // len(langs))] for c in range(len(langs))])
    mark = normal(bits[pick])
    values, vectors = np.linalg.eigh((mark @ mark.T).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    # Presence rows are unpacked a block at a time, so the driver never holds the whole matrix.
    phi = np.concatenate([(normal(bits[k : k + 128]) @ mark.T).astype(np.float64) for k in range(0, len(bits), 128)]) @ root
    weight = 1 / np.maximum((y > 0).sum(axis=0), 1)
    w = (y > 0) @ weight
    w *= len(rows) / w.sum()  # each language counts alike
    mean_phi, mean_y = (w[:, None] * phi).sum(0) / w.sum(), (w[:, None] * y).sum(0) / w.sum()
    p, t = phi - mean_phi, y - mean_y
    beta = np.linalg.solve((p * w[:, None]).T @ p + ridge * len(rows) / 100 * np.eye(p.shape[1]), (p * w[:, None]).T @ t)
    seen = root @ beta
    weights = np.concatenate([(mark[:, k : k + 4096].T.astype(np.float64) @ seen).astype(np.float32) for k in range(0, DIM, 4096)])
    return Model(langs, weights, (mean_y - mean_phi @ beta).astype(np.float32))


def first_rows(labelled: DataFrame, lang_col: str, order: list[Column], rows: int) -> DataFrame:
    """The first rows of each language; Spark cuts every partition to them before the shuffle."""
    place = F.row_number().over(Window.partitionBy(lang_col).orderBy(*order))
    return labelled.withColumn("place", place).filter(F.col("place") <= rows).drop("place")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, total: int = TOTAL, most_langs: int = MOST_LANGS) -> Model:
    """Fit on rows that aren't held out and have a language and a letter."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    labelled = labelled.filter(F.col("lang").isNotNull() & ~held_out("id") & F.col("id").isNotNull() & F.col("text").rlike("\\p{L}")).withColumn("draw", F.xxhash64(F.lit("langid"), "id", "text"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).orderBy(F.desc("n"), "lang").limit(most_langs)
    counts = materialize(counts, "langid-counts")
    langs = counts.count()
    if not langs:
        return fit_rows([])
    rows = min(per_lang, max(1, total // langs))
    # Four times the rows are drawn by hash, without texts, and the first row of each language in any case; the smallest hashes then pick the rows.
    counts = F.broadcast(counts.select(F.col("lang").alias("of"), F.least(F.lit(1.0), F.lit(4.0 * rows) / F.col("n")).alias("part"), "least"))  # most_langs rows
    chosen = (F.col("draw").cast("double") / 2.0**64 + 0.5 <= F.col("part")) | (F.col("draw") == F.col("least"))
    drawn = labelled.select("lang", "draw").join(counts, F.col("lang") == F.col("of")).filter(chosen).select("lang", "draw")
    last = first_rows(drawn, "lang", [F.col("draw")], rows).groupBy("lang").agg(F.max("draw").alias("last"))
    last = F.broadcast(last.select(F.col("lang").alias("of"), "last"))
    sample = labelled.join(last, (F.col("lang") == F.col("of")) & (F.col("draw") <= F.col("last"))).select("draw", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [(d, x, np.packbits(one_window(t, d % 2**64 >> 8)).tobytes()) for d, x, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t and _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.string()), pa.array([k[2] for k in keep], pa.binary())], ["draw", "lang", "bits"])

    found = first_rows(sample.mapInArrow(run, "draw long, lang string, bits binary"), "lang", [F.col("draw"), F.col("bits")], rows)  # rows may be repeated
    kept = sorted((r["draw"], r["lang"], bytes(r["bits"])) for r in found.collect())
    return fit_rows([(lang, bits) for _, lang, bits in kept])


def predict(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs without its text, with a predicted language and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [f for f in docs.schema.fields if f.name not in (text_col, *into)]
    names = [f.name for f in others]
    ordered = docs.select(*(F.col(f"`{n}`") for n in names), F.col(text_col))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"{into[0]} string", f"{into[1]} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score = shared.value.predict(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, *into])

    return ordered.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fit on docs, then predict every row: id, held_out, lang_pred, score."""
    model = fit(docs, id_col)
    return predict(docs.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "text"), model)


def keep_known(docs: DataFrame, least_score: float = 0.15) -> DataFrame:
    """Rows whose language is recognised (score of at least `least_score`); columns as given, `lang` holds the prediction.

    A very short text of a learned language scores low too, so the bound is low; texts
    without a letter always go.
    """
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score = shared.value.predict(batch.column(text_at).to_pylist())
            cols = [pa.array(lang, c.type) if k == lang_at else c for k, c in enumerate(batch.columns)]
            known = pa.array([x != UNKNOWN and s >= least_score for x, s in zip(lang, score, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names).filter(known)

    return docs.mapInArrow(run, docs.schema)
