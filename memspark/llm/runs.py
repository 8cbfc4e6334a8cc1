"""Periodic runs of words: stretches that repeat a sequence of words several times.

A run is a stretch of consecutive words with smallest period q (words q apart are equal)
of at least max(`least_words`, `least_exponent` * q) words that no neighbouring word
extends. They are found by divide and conquer over interned word numbers (Main and
Lorentz): a run that crosses a midpoint m holds, on its longer side, at least two whole
periods, that is a square w[m : m + 2q] = uu, or its mirror image on the left. Values
Z(q), how far w[m:] and w[m + q:] agree, give these squares and how far the period goes on
that side; the common suffix of both places gives the other side. A run that goes on
beyond its segment crosses an earlier midpoint and was found there. Of equal intervals
the smallest period stays.

All segments of one depth are worked on together by whole-array steps, over the documents
of a batch. Z is only asked for at places that pass three single comparisons; a segment
where many places pass is given whole Z-values by the linear algorithm, so no text is
quadratic: n words take O(n log n) steps.

Words are runs of bytes other than the space and 0x09 to 0x0D; case counts. Null and empty
texts have no words and no runs. Texts of any length are one unit of work, with some 60
bytes of memory a word; rows are worked on alone, so repeated rows agree. No shuffle takes
place. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import slices, steps, text_bytes
from memspark.llm.words import interned, packed, spans_of, word_spans

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Text that one step works on, and places that are compared at a time.
STEP_BYTES, PLACES = 4 << 20, 1 << 20
#: A segment with more places left after the single comparisons has all its Z-values computed.
DENSE = 128
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def common_extent(ids: np.ndarray, x: np.ndarray, y: np.ndarray, limit: np.ndarray, sign: int) -> np.ndarray:
    """How many words agree from x and y on, forwards (sign 1) or backwards (-1), up to a limit each."""
    n = np.zeros(len(x), np.int64)
    open_, width = np.flatnonzero(limit > 0), 16
    while len(open_):
        still = []
        rows = max(1, PLACES // width)
        for k in range(0, len(open_), rows):
            part = open_[k : k + rows]
            step = np.arange(width)[None] + n[part][:, None]
            inside = step < limit[part][:, None]
            step = np.where(inside, step, 0)
            same = (ids[x[part][:, None] + sign * step] == ids[y[part][:, None] + sign * step]) & inside
            all_ = same.all(axis=1)
            n[part] += np.where(all_, width, same.argmin(axis=1))
            still.append(part[all_ & (n[part] < limit[part])])
        open_, width = np.concatenate(still), min(width * 4, PLACES)
    return n


def z_values(s: list[int]) -> list[int]:
    """Z[q]: how far s and s[q:] agree, by the linear algorithm."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for q in range(1, n):
        k = min(right - q, z[q - left]) if q < right else 0
        while q + k < n and s[k] == s[q + k]:
            k += 1
        if q + k > right:
            left, right = q, q + k
        z[q] = k
    return z


def _places(ids: np.ndarray, mid: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments and periods q <= most for which w[mid], the square's middle word and its last word agree q words on."""
    at = spans_of(most)
    segments, periods = [], []
    for k in range(0, int(at[-1]), PLACES):
        end = min(k + PLACES, int(at[-1]))
        a, b = np.searchsorted(at, k, side="right") - 1, np.searchsorted(at, end, side="left")
        counts = np.minimum(at[a + 1 : b + 1], end) - np.maximum(at[a:b], k)
        seg = np.repeat(np.arange(a, b), counts)
        q = np.arange(k, end) - at[seg] + 1
        m = mid[seg]
        keep = np.flatnonzero(ids[m + q] == ids[m])
        seg, q, m = seg[keep], q[keep], m[keep]
        keep = (ids[m + 2 * q - 1] == ids[m + q - 1]) & (ids[m + q + q // 2] == ids[m + q // 2])
        segments.append(seg[keep])
        periods.append(q[keep])
    if not segments:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(segments), np.concatenate(periods)


def squares(ids: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, period q and Z(q) >= q of the squares that begin at the midpoints and have no smaller period.

    A square of period q that lies within the stretch of a smaller period has that period too (Fine and Wilf).
    """
    seg, q = _places(ids, mid, (hi - mid) // 2)
    found = []
    counts = np.bincount(seg, minlength=len(mid)) if len(seg) else np.zeros(len(mid), np.int64)
    for s in np.flatnonzero(counts > DENSE):
        z = np.array(z_values(ids[mid[s] : hi[s]].tolist()))
        here, least = q[seg == s], 0
        for period in here[z[here] >= here]:
            if 2 * period > least:
                found.append((s, period, z[period]))
                least = period + z[period]
    out = [np.array(found, np.int64).reshape(-1, 3)]
    keep = counts[seg] <= DENSE
    seg, q = seg[keep], q[keep]
    while len(seg):
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        s, p = seg[first], q[first]
        z = common_extent(ids, mid[s], mid[s] + p, hi[s] - mid[s] - p, 1)
        square = z >= p
        out.append(np.stack([s, p, z], axis=1)[square])
        reach = np.zeros(len(mid), np.int64)
        reach[s] = np.where(square, p + z, 0)
        left = 2 * q > reach[seg]
        left[first] = False
        seg, q = seg[left], q[left]
    all_ = np.concatenate(out)
    return all_[:, 0], all_[:, 1], all_[:, 2]


def _crossing(ids: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, first: np.ndarray, end: np.ndarray, least_words: int, exponent: int) -> np.ndarray:
    """(start, end, period) of runs that cross midpoints with two periods or more on the right."""
    s, q, z = squares(ids, mid, hi)
    lo, mid, hi, first, end = (x[s] for x in (lo, mid, hi, first, end))
    a = mid - common_extent(ids, mid - 1, mid + q - 1, mid - lo, -1)
    b = mid + q + z
    keep = b - a >= np.maximum(least_words, exponent * q)
    top = len(ids) - 1
    keep &= ~((a == lo) & (lo > first) & (ids[np.maximum(a - 1, 0)] == ids[np.minimum(a - 1 + q, top)]))
    keep &= ~((b == hi) & (hi < end) & (ids[np.minimum(b, top)] == ids[b - q]))
    return np.stack([a, b, q], axis=1)[keep]


def find_runs(ids: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """(start, end, period) of all runs, by start and period; rows of words lie between bounds."""
    if exponent < 4:
        raise ValueError("an exponent of at least 4 is needed: a run must hold two periods on one side of any place")
    n, found = len(ids), []
    lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    first, end = lo, hi
    back = ids[::-1]
    while True:
        live = hi - lo >= least_words
        lo, hi, first, end = lo[live], hi[live], first[live], end[live]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        found.append(_crossing(ids, lo, mid, hi, first, end, least_words, exponent))
        mirrored = _crossing(back, n - hi, n - mid, n - lo, n - end, n - first, least_words, exponent)
        found.append(np.stack([n - mirrored[:, 1], n - mirrored[:, 0], mirrored[:, 2]], axis=1))
        lo, hi, first, end = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.tile(first, 2), np.tile(end, 2)
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _described(raw: np.ndarray, offsets: np.ndarray, least_words: int, exponent: int) -> list[pa.Array]:
    """The columns of SCHEMA for the rows of a text buffer."""
    starts, ends, bounds = word_spans(raw, offsets)
    runs = find_runs(interned(raw, starts, ends), bounds, least_words, exponent)
    doc = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    fields = [pa.array(x, pa.int64()) for x in (runs[:, 0] - bounds[doc], runs[:, 1] - runs[:, 0], runs[:, 2])]
    lists = pa.ListArray.from_arrays(pa.array(spans_of(np.bincount(doc, minlength=len(offsets) - 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    kept = np.cumsum(depth[:-1]) == 0
    data, at = packed(raw, starts[kept], ends[kept], 1)
    row = spans_of(kept)[bounds]  # how many kept words stand before each row
    at = at[row]
    closing = at[1:][np.diff(row) > 0] - 1  # the blank after a row's last word
    shift = spans_of(np.diff(row) > 0)
    data = np.ascontiguousarray(np.delete(data, closing))
    text = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(at - shift), pa.py_buffer(data)])
    return [pa.array(np.diff(bounds), pa.int64()), lists, text.cast(pa.string())]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """id, n_words, runs by start and period, and the text with one period of each run, words joined by one blank.

    A word is dropped from `collapsed` if any run holds it after that run's first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            raw, offsets = text_bytes(batch.column(1))
            for i, j in steps(offsets, STEP_BYTES):
                part = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_described(*part, least_words, exponent)], [id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; of one document in ten (by crc32 of its id) the words from some place on repeat with one period.

    With h = crc32 of the decimal id, unsigned, g = floor(h / 10), n words and h % 10 = 0, word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    split = chosen.select("doc_id", "text", "g", F.when(F.col("h") % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    spot = split.select("doc_id", "text", "g", "words", "n", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")).alias("a"))
    rest = F.col("n") - F.col("a")
    spot = spot.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return spot.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, its greatest run (ties: smallest start, then period) and digests of runs and collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    greatest = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period")))), F.lit(1))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), greatest.alias("r"), lines.alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        F.col("r.start").alias("start"),
        (-F.col("r.less")).alias("length"),
        F.col("r.period").alias("period"),
        F.floor(-1000 * F.col("r.less") / F.col("r.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
