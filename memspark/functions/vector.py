"""Vectors as arrays of double, JVM-side; hash embedding as an Arrow-batched function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from memspark.functions.hashing import FNV_OFFSET, FNV_PRIME

DIM = 64
#: Bytes of text that are embedded at a time: its tokens take some twenty times as many.
EMBED_BYTES = 1 << 18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, other lengths or zero norms."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (scale == 0), 0.0).otherwise(dot(a, b) / scale)


def _sum_of_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per column, added from the first row on as `dot` does, so that both give the same doubles."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


@F.arrow_udf(ArrayType(DoubleType()))
def cosines(vector: pa.Array, others: pa.Array) -> pa.Array:
    """`cosine` of a vector and each of a list of others, over whole batches: vector array<double>, others array<array<double>>."""
    counts = pc.fill_null(pc.list_value_length(others), 0).to_numpy(zero_copy_only=False)
    row, other = np.repeat(np.arange(len(vector)), counts), others.flatten()

    def parts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, and where each list lies; one that is null or holds null has length -1."""
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, bad = lists.flatten(), lists.is_null().to_numpy(zero_copy_only=False).copy()
        start = np.cumsum(size) - size
        if flat.null_count:
            bad[np.repeat(np.arange(len(lists)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        return flat.to_numpy(zero_copy_only=False), start, np.where(bad, -1, size)

    (x, x_at, x_size), (y, y_at, y_size) = parts(vector), parts(other)
    x_at, x_size = x_at[row], x_size[row]
    null = (x_size < 0) | (y_size < 0)
    out = np.zeros(len(row))
    for size in np.unique(x_size[(x_size == y_size) & (x_size > 0)]):
        here = np.flatnonzero((x_size == size) & (y_size == size))
        steps = np.arange(size)[:, None]
        a, b = x[x_at[here] + steps], y[y_at[here] + steps]
        scale = np.sqrt(_sum_of_products(a, a)) * np.sqrt(_sum_of_products(b, b))
        np.divide(_sum_of_products(a, b), scale, out=scale, where=scale != 0)
        out[here] = scale
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out, mask=null))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def mean_vector(v: Column, dim: int = DIM) -> Column:
    """Element-wise mean of a group, as `dim` averages with map-side combining."""
    return F.array(*[F.avg(F.get(v, F.lit(i)).cast("double")) for i in range(dim)])


def normal_tokens(text: Column) -> Column:
    """Text as lower-case alphanumeric runs, for `hash_embed`."""
    return F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+", " ")


def token_slot(token: str) -> int:
    """Slot of a token: FNV-1a modulo the dimension, which the low bits alone decide; -1 if too short."""
    raw = token.encode()
    if len(raw) <= 2:
        return -1
    h = FNV_OFFSET % DIM
    for b in raw:
        h = ((h ^ b) * FNV_PRIME) % DIM
    return h


def _slots(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slots of many tokens, byte by byte over all of them; tokens of two bytes or less get -1."""
    h = np.full(len(starts), FNV_OFFSET % DIM, np.int64)
    left, k = np.flatnonzero(sizes > 2), 0
    while len(left):
        h[left] = ((h[left] ^ raw[starts[left] + k]) * (FNV_PRIME % DIM)) % DIM
        k += 1
        left = left[sizes[left] > k]
    h[sizes <= 2] = -1
    return h


def _by_slices(normal: pa.Array, width: int, made: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """Lists of `width` numbers, made of the vectors of texts; a batch's texts may be long, so few bytes are worked on at a time."""
    end = np.cumsum(pc.fill_null(pc.binary_length(normal), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = np.flatnonzero(np.diff(np.maximum(end - 1, 0) // EMBED_BYTES, prepend=-1))
    out = np.zeros((len(normal), width))
    for s, t in zip(begin, np.append(begin, len(normal))[1:], strict=True):
        out[s:t] = made(_bags(normal.slice(s, t - s)))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(normal) + 1) * width, pa.int32()), pa.array(out.ravel()))


def embedded(normal: pa.Array) -> pa.Array:
    """Unit bag-of-tokens vectors of texts as `normal_tokens` makes them."""
    return _by_slices(normal, DIM, lambda v: v)


#: `embedded` of a column.
hash_embed = F.arrow_udf(ArrayType(DoubleType()))(embedded)


def _bags(normal: pa.Array) -> np.ndarray:
    column = pc.fill_null(normal, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    # Tokens lie between blanks and the ends of texts.
    cuts = np.union1d(np.flatnonzero(raw == 32), at)
    edges = np.concatenate([cuts, [len(raw)]])
    starts = np.where(raw[np.minimum(cuts, max(len(raw) - 1, 0))] == 32, cuts + 1, cuts) if len(raw) else cuts
    sizes = np.maximum(edges[1:] - starts, 0)
    row = np.searchsorted(at, cuts, side="right") - 1
    slot = _slots(raw, starts, sizes)
    keep = (slot >= 0) & (row < n)
    v = np.bincount(row[keep] * DIM + slot[keep], minlength=n * DIM).reshape(n, DIM).astype(np.float64)
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=v, where=size > 0)


def embed(text: Column) -> Column:
    return hash_embed(normal_tokens(text))


def projected(text: Column, axes: np.ndarray) -> Column:
    """`dot` of a text's `embed` and each axis, as array<double>; the vector itself doesn't leave its task."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def products(normal: pa.Array) -> pa.Array:
        return _by_slices(normal, len(axes), lambda v: np.stack([_sum_of_products(v.T, axis) for axis in axes], axis=1))

    return products(normal_tokens(text))
