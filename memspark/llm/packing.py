"""Packing of token sequences by minimum bin slack.

Every document becomes token ids and an end id; whole windows are cut off, and the
remaining tails of a task wait in a bounded pool. A window takes the longest tail and
then the multiset of tail lengths that fills it closest to capacity: a subset-sum
bitset (one Python integer) grows by one length at a time with its count split into
powers of two, and backtracking through the kept bitsets gives the counts. A slack
that is left is filled by cutting another tail; what remains at a task's end is cut
into powers of two, so padding arises nowhere.

Packing is local to a task and needs no shuffle; sequence ids hold the partition's
number. Null texts are empty, so such a document is its end id alone. Very long texts
give many whole windows. Repeated rows are packed each on its own; an empty table
gives no rows; other columns aren't read. A null id is kept as it is. Equal slacks of a window
are told apart by the order of lengths, equal lengths by the order of arrival.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from memspark.llm.common import slices

CAPACITY = 2048
END_ID = 1
#: Tails that wait in a task before windows are filled, and those kept back for the next round.
POOL, KEEP = 4096, 1024
SPECIAL = "<|endoftext|>"
_LONG_SPACE = re.compile(r"\s{4000}")
_ENCODERS: dict[str, object] = {}


class Encoder:
    """Ids of `vocabulary` (a tokenizers file). The ranks beside it, if any, give the same ids faster."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.fast = None
        ranks = Path(vocabulary).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            pairs = (line.split() for line in ranks.read_bytes().splitlines())
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        # Special tokens are found by tokenizers alone, and long white space is where the fast pattern may give up.
        if self.fast is None or SPECIAL in text or (len(text) > 4000 and _LONG_SPACE.search(text)):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def encoder(vocabulary: str) -> Encoder:
    """One encoder a process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length sum as close to capacity as possible without passing it."""
    full = (1 << (capacity + 1)) - 1
    reach, trail = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, k = counts[length], 1
        while left > 0 and length * min(k, left) <= capacity:
            k = min(k, left)
            trail.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left, k = left - k, k * 2
        if reach >> capacity & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(trail):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + k
            at -= length * k
    return taken


class Packer:
    """Pieces of one task: rows of (document's row, start, length, crc, sequence, offset)."""

    def __init__(self, first_id: int, capacity: int) -> None:
        self.next_id, self.capacity = first_id, capacity
        self.pool: dict[int, list[tuple]] = {}
        self.waiting = 0
        self.out: list[tuple] = []

    def add(self, doc: object, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for s in range(0, whole, self.capacity):
            self._place([(doc, s, ids[s : s + self.capacity], len(ids))])
        if whole < len(ids):
            self._wait((doc, whole, ids[whole:].copy(), len(ids)))  # a view would keep a long document's ids in memory
        if self.waiting >= POOL:
            self.fill(KEEP)

    def _wait(self, tail: tuple) -> None:
        self.pool.setdefault(len(tail[2]), []).append(tail)
        self.waiting += 1

    def _take(self, length: int) -> tuple:
        tails = self.pool[length]
        tail = tails.pop()
        if not tails:
            del self.pool[length]
        self.waiting -= 1
        return tail

    def _place(self, tails: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in tails:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def fill(self, keep: int = 0) -> None:
        while self.waiting > keep:
            chosen = [self._take(max(self.pool))]
            room = self.capacity - len(chosen[0][2])
            for length, k in best_fill({n: len(t) for n, t in self.pool.items()}, room).items():
                chosen += [self._take(length) for _ in range(k)]
                room -= length * k
            if room and self.pool:  # all that is left is longer than the slack: cut one
                doc, start, ids, total = self._take(min(self.pool))
                chosen.append((doc, start, ids[:room], total))
                self._wait((doc, start + room, ids[room:], total))
                room = 0
            if room:
                self._powers(chosen)
            else:
                self._place(chosen)

    def _powers(self, tails: list[tuple]) -> None:
        """Sequences of powers of two, largest first, from the task's last tails."""
        size = sum(len(t[2]) for t in tails)
        while tails:
            part, want = [], 1 << (size.bit_length() - 1)
            size -= want
            while want:
                doc, start, ids, total = tails.pop(0)
                part.append((doc, start, ids[:want], total))
                if len(ids) > want:
                    tails.insert(0, (doc, start + want, ids[want:], total))
                want -= min(want, len(ids))
            self._place(part)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; every id of every document lies in exactly one."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)

        def rows() -> pa.RecordBatch:
            doc, start, length, crc, total, sequence, offset = zip(*packer.out, strict=True) if packer.out else ((),) * 7
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(doc, kind), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, sequence, offset))], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4", copy=False))
            if packer.out:
                yield rows()
        packer.fill()
        if packer.out:
            yield rows()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
