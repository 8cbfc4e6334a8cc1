"""Hashes: FNV-1a, train/eval/test split, digests of sorted lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


@F.pandas_udf(StringType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """Sixteen hex digits over the UTF-8 bytes; all texts of a batch step through their bytes together."""
    raw = [t.encode() if t is not None else b"" for t in texts]
    size = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
    h = np.full(len(raw), FNV_OFFSET, np.uint64)
    live = np.argsort(-size, kind="stable")
    for k in range(size.max(initial=0)):
        live = live[: np.searchsorted(-size[live], -k, side="left")]
        h[live] = (h[live] ^ data[start[live] + k]) * np.uint64(FNV_PRIME)
    return pd.Series([f"{x:016x}" if t is not None else None for x, t in zip(h.tolist(), texts, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def fnv1a_floats(vectors: pd.Series) -> pd.Series:
    """Sixteen hex digits over the little-endian 32-bit floats of a vector; vectors of one length step together."""
    out = np.full(len(vectors), None, object)
    sizes = np.array([-1 if v is None else len(v) for v in vectors])
    for n in np.unique(sizes[sizes >= 0]):
        own = np.flatnonzero(sizes == n)
        raw = np.stack([np.asarray(vectors.iloc[i], "<f4") for i in own]).view(np.uint8).reshape(len(own), -1).astype(np.uint64)
        h = np.full(len(own), FNV_OFFSET, np.uint64)
        for k in range(raw.shape[1]):
            h = (h ^ raw[:, k]) * np.uint64(FNV_PRIME)
        out[own] = [f"{x:016x}" for x in h.tolist()]
    return pd.Series(out, dtype=object)


def split_number(c: Column) -> Column:
    """First byte of the SHA-256 modulo 10."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 2), 16, 10).cast("int") % 10


def split_name(c: Column) -> Column:
    n = split_number(c)
    return F.when(n <= 6, "train").when(n == 7, "eval").otherwise("test")

