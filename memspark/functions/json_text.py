"""JSON texts of any shape: strings rewritten wherever they stand."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rebased(value: object, old: str, new: str) -> object:
    """value with every string that is the folder old or lies in it moved to new; keys stay. Any depth, without recursion."""
    moved = lambda s: new + s[len(old) :] if s == old or s.startswith(old + "/") else s
    top = [value]
    todo: list = [top]
    while todo:
        node = todo.pop()
        for k, v in node.items() if isinstance(node, dict) else enumerate(node):
            if isinstance(v, str):
                node[k] = moved(v)
            elif isinstance(v, (dict, list)):
                todo.append(v)
    return top[0]


def rebase_json(text: Column, old: str, new: str) -> Column:
    """JSON text with its strings moved from one folder to another, compact; what isn't JSON stays as it is."""

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(t if t is None or old not in t.replace("\\/", "/") else json.dumps(rebased(json.loads(t), old, new), ensure_ascii=False, separators=(",", ":")))
            except (ValueError, RecursionError):
                out.append(t)
        return pd.Series(out, dtype=object)

    return rewrite(text)
