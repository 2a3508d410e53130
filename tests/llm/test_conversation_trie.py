from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from warmtrace.llm import conversation_trie as ct
from warmtrace.llm.queries import rebuilt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
DDL = "conv_id long, turn long, role string, text string"


def brute(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """Nodes from the definition: every prefix of every sequence."""
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[:len(path)] == path]
        parents = {p[:-1] for p in members if p}
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(path))))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode().split()) for p in below if p)
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids),
                    sum(len(p) == len(path) + 1 for p in below), sum(p not in parents for p in below), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def remade(rows) -> dict[int, list[tuple[str, str]]]:
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def made(spark, rows, size):
    return sorted([tuple(r) for r in ct.trie(rebuilt(spark.createDataFrame(rows, DDL)), rows=size).select(*COLUMNS).collect()], key=str)


@pytest.mark.parametrize("size", [1, 3, 40, ct.ROWS])
def test_equals_all_prefixes(spark, size):
    random.seed(size)
    rows = []
    for c in range(0, 130, 1 if size > 3 else 4):
        for turn in range(random.choice([1, 2, 3, 5, 9])):
            hot = turn < 2 and random.random() < 0.6
            rows.append((c, turn, "user", "same words here" if hot else f"w{random.randrange(3)} \x0b x"))
    rows += [(200 + k, t, "user", f"a {t}") for k in range(30) for t in range(4)]   # equal ones
    assert made(spark, rows, size) == brute(remade(rows))


def test_odd_rows(spark):
    rows = [(20, 1, None, None), (20, None, "user", "null turn is first"), (20, 5, "", ""), (21, 0, "user", "one"),
            (23, 3, "a", "x"), (23, 2, "a", "x"), (41, 0, "user", "gone when h is one or more"), (None, 1, "user", "no id"),
            (60, 0, "ab", "c"), (80, 0, "a", "bc"), (-3, 0, "user", "below zero"), (100, 0, "u", "long text " * 50_000)]
    assert made(spark, rows, 2) == brute(remade(rows))
    extra = spark.createDataFrame(rows, DDL).withColumns({n: F.lit(1) for n in ["path", "turns", "words", "base", "key", "n", "head"]})
    assert sorted([tuple(r) for r in ct.trie(rebuilt(extra)).select(*COLUMNS).collect()], key=str) == brute(remade(rows))
    assert ct.trie(rebuilt(extra.where("false"))).collect() == []


def test_one_long_conversation(spark):
    rows = [(0, t, "user", f"turn {t % 7}") for t in range(3000)] + [(1, t, "user", f"turn {t % 7}") for t in range(2990)]
    assert {r[1] for r in made(spark, rows, 1)} == set(range(3001))


def test_turnless_conversations_end_at_the_root(spark):
    turns = "array<struct<id string, words int>>"
    df = spark.createDataFrame([(5, []), (3, []), (9, [("0" * 32, 4)])], f"conv_id long, turns {turns}")
    rows = {r.depth: r for r in ct.trie(df).collect()}
    assert rows[0].ends_sha256 == hashlib.sha256(b"3,5").hexdigest() and rows[0].n_convs == 3 and rows[0].conv_id == 3
    assert rows[1].parent_conv_id == 3 and rows[1].saved_tokens == 0
