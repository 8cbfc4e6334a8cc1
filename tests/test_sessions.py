"""Session stacks against a plain stack."""

import random

from memspark.operators import sessions

SCHEMA = "session_id string, seq long, action string, node string"


def plain(log):
    out = {}
    for session, _, action, node in sorted(log, key=lambda x: (x[0], x[1], x[2], x[3] is not None, x[3] or "")):
        stack, seen = out.setdefault(session, ([], set()))
        if action == "back":
            if len(stack) > 1:
                stack.pop()
        elif node is not None:
            stack.append(node)
            seen.add(node)
    return out


def check(spark, log, parts):
    df = spark.createDataFrame(log, SCHEMA).repartition(parts)
    stack = sessions.stacks(df)
    want = plain(log)
    got = {}
    for r in stack.collect():
        got.setdefault(r.session_id, {})[r.depth] = r.node
    assert {s: [v[k + 1] for k in range(len(v))] for s, v in got.items()} == {s: v for s, (v, _) in want.items() if v}
    rows = {r.session_id: (r.current, r.before, r.trail, r.visited) for r in sessions.states(df, stack).collect()}
    assert rows == {s: (v[-1] if v else None, max(len(v) - 1, 0), len(set(v)), len(seen)) for s, (v, seen) in want.items()}


def test_stacks_equal_a_plain_stack(spark):
    rng = random.Random(0)
    log = []
    for s in range(25):
        seq = 0
        for _ in range(rng.choice([1, 2, 5, 30, 200])):
            seq += rng.choice([0, 1, 1])
            back = rng.random() < rng.choice([0.3, 0.5, 0.6])
            log.append((f"s{s}", seq, "back" if back else "open", None if rng.random() < 0.1 else f"n{rng.randrange(9)}"))
    check(spark, log, 5)
    check(spark, log, 1)


def test_sessions_without_an_open_and_empty_logs(spark):
    check(spark, [("a", 1, "back", None), ("a", 2, "back", "x"), ("b", 1, "open", None)], 2)
    assert sessions.stacks(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_session_of_a_million_actions_is_many_segments(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("'s' AS session_id", "id AS seq", "CASE WHEN id % 5 IN (3, 4) THEN 'back' ELSE 'open' END AS action", "concat('n', id % 1000) AS node")
    stack = sessions.stacks(df)
    facts = sessions.states(df, stack).first()
    assert (facts.before, facts.current) == (n // 5 - 1, f"n{(n - 5) % 1000}")
    rows = stack.groupBy().agg({"depth": "max", "seq": "count"}).first()
    assert tuple(rows) == (n // 5, n // 5)
