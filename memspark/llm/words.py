"""Words of many texts at once, as places in one Arrow buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of words: all but the space and 0x09 to 0x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, *range(9, 14)]] = False


def word_spans(raw: np.ndarray, offsets: np.ndarray, of_words: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and where each row's words begin (one more entry than rows)."""
    word = of_words[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1] | edge[1:-1]
    closes[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def spans_of(counts: np.ndarray) -> np.ndarray:
    """0, then the running sums of counts."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def packed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, after: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans in a row, each followed by `after` blanks, and their offsets."""
    sizes = ends - starts + after
    at = spans_of(sizes)
    from_ = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
    out = raw[np.minimum(from_, max(len(raw) - 1, 0))] if len(raw) else np.zeros(0, np.uint8)
    for k in range(after):
        out[at[1:] - 1 - k] = 32
    return out, at


def interned(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words (compared by bytes)."""
    data, at = packed(raw, starts, ends)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
