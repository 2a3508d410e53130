"""Plain Python models of the operators, for small traces only."""

from __future__ import annotations

import heapq
from collections import defaultdict

SCHEMA = "owner string, function string, memory_mb int, duration_ms bigint, ts_ms bigint, seq bigint"


def make_trace(spark, rows):
    """Rows (owner, function, memory, duration, ts); ``seq`` is the position."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def pool_model(rows, keepalive):
    """(function, seq) -> [cold, reused_at, container_id] for trace tuples with seq."""
    out, pools = {}, defaultdict(list)
    for owner, function, _, duration, ts, seq in sorted(rows, key=lambda r: (r[4], r[5])):
        pool = pools[function]
        while pool and ts >= pool[0][0] + keepalive:
            heapq.heappop(pool)
        if pool and pool[0][0] <= ts:
            taken = heapq.heappop(pool)
            out[function, taken[2]][1] = ts
            root = taken[3]
            out[function, seq] = [False, None, root]
        else:
            root = seq
            out[function, seq] = [True, None, root]
        heapq.heappush(pool, (ts + duration, ts, seq, root))
    return out


def cap_model(rows, limit, weight):
    """``seq`` of the rows admitted greedily."""
    live, kept = [], []
    for row in sorted(rows, key=lambda r: (r[4], r[0], r[1], r[5])):
        live = [(e, w) for e, w in live if e > row[4]]
        w = weight(row)
        if sum(x for _, x in live) + w <= limit:
            live.append((row[4] + row[3], w))
            kept.append(row[5])
    return kept


def gauge_model(rows, model, keepalive, at):
    """Gauges at instant ``at`` by looking at every row."""
    users, functions, all_users, all_functions = set(), set(), set(), set()
    n = mb = cached = 0
    for owner, function, memory, duration, ts, seq in rows:
        end = ts + duration
        reused = model[function, seq][1]
        freed = end + keepalive if reused is None else min(reused, end + keepalive)
        if ts <= at < end:
            n, mb = n + 1, mb + memory
            users.add(owner), functions.add(function)
        if ts <= at < freed:
            all_users.add(owner), all_functions.add(function)
            if at >= end:
                cached += memory
    return (len(users), len(functions), n, mb, len(all_users) - len(users),
            len(all_functions) - len(functions), cached)
