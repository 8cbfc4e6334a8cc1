"""Word shingles as 64-bit hashes, made from Arrow buffers by whole-array steps.

Words are runs of bytes other than space and 0x09 to 0x0D; A-Z are lower-cased. A text of
fewer words than the width is one shingle of its whole sequence; without words it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from memspark.llm.common import STEP_BYTES, mix64, steps, text_bytes

WIDTH = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Longest word that is hashed in steps of eight bytes; longer ones go to xxhash one by one.
_STEPPED = 256


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row it stands in. Eight bytes at a time pass a mixer, so no word's hash follows from others'."""
    low = _LOWER[raw]
    word = ~_BLANK[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    sizes = ends - starts
    h = mix64(sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(low) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from every place on
    left = np.flatnonzero(sizes <= _STEPPED)
    at = 0
    while len(left):
        rest = sizes[left] - at
        keep = np.minimum(rest, 8).astype(np.uint64)
        part = eight[starts[left] + at] & (~np.uint64(0) >> (np.uint64(64) - keep * np.uint64(8)))
        h[left] = mix64((h[left] ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at))
        left = left[rest > 8]
        at += 8
    for k in np.flatnonzero(sizes > _STEPPED):
        h[k] = xxhash.xxh3_64_intdigest(low[starts[k] : ends[k]].data)
    return h, np.searchsorted(offsets, starts, side="right") - 1


def long_row_hashes(raw: np.ndarray, limit: int) -> np.ndarray:
    """Word hashes of one long row, piece by piece, cut after blanks; a longer word is one piece."""
    found, at = [], 0
    while at < len(raw):
        end = min(at + limit, len(raw))
        if end < len(raw):
            blanks = np.flatnonzero(_BLANK[raw[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                while end < len(raw) and not _BLANK[raw[end - 1]]:
                    after = np.flatnonzero(_BLANK[raw[end : end + limit]])
                    end = end + int(after[0]) + 1 if len(after) else min(end + limit, len(raw))
        found.append(word_hashes(raw[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(found)


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a string column."""
    raw, offsets = text_bytes(column)
    for i, j in steps(offsets, STEP_BYTES):
        part = offsets[i : j + 1] - offsets[i]
        if not part[-1]:
            yield from (np.zeros(0, np.uint64) for _ in range(j - i))
            continue
        if j - i == 1 and part[-1] > STEP_BYTES:
            h = long_row_hashes(raw[offsets[i] : offsets[j]], STEP_BYTES)
            row = np.zeros(len(h), np.int64)
        else:
            h, row = word_hashes(raw[offsets[i] : offsets[j]], part)
        at = np.searchsorted(row, np.arange(j - i + 1))
        runs = len(h) - width + 1
        folded = _fold([h[k : k + runs] for k in range(width)]) if runs > 0 else h[:0]
        for k in range(j - i):
            a, b = at[k], at[k + 1]
            if b - a >= width:
                yield np.unique(folded[a : b - width + 1])
            elif b > a:
                yield _fold([h[x : x + 1] for x in range(a, b)]) ^ np.uint64(b - a)
            else:
                yield h[:0]
