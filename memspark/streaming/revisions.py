"""Revisions of captured pages as a stream: state per domain is the last capture's time and hash."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "page_id long, domain string, previous_hash string, content_hash string"


def revisions(captures: DataFrame) -> DataFrame:
    """A row for each capture whose content differs from the capture before it of the same domain.

    captures: page_id, domain, content_hash, retrieved_at, a stream. Captures of one trigger are taken in the order of time, then
    page id; one that is older than the last capture of an earlier trigger is compared with that one and doesn't become the last.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["retrieved_at", "page_id"])  # short rows of one domain and trigger
        at, last = state.get if state.exists else (None, None)
        hashes, times = rows["content_hash"].tolist(), rows["retrieved_at"].tolist()
        before = []
        for h, t in zip(hashes, times, strict=True):
            before.append(last)
            if at is None or t >= at:
                at, last = t, h
        state.update((at, last))
        out = pd.DataFrame({"page_id": rows["page_id"], "domain": key[0], "previous_hash": before, "content_hash": hashes})
        yield out[out["previous_hash"].notna() & (out["previous_hash"] != out["content_hash"])]

    return captures.groupBy("domain").applyInPandasWithState(step, SCHEMA, "at long, last string", "append", GroupStateTimeout.NoTimeout)
