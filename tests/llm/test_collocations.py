from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from warmtrace.llm import collocations as co

DDL = "doc_id long, text string, lang string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def counted(rows) -> dict[str, Counter]:
    out: dict[str, Counter] = {}
    for _, text, lang in rows:
        here = out.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                here.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return out


def brute(rows, least: int, share: int, top: int) -> list[tuple]:
    out = []
    for lang, f in counted(rows).items():
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in many.items():
            if any(len(q) > len(p) and p in [q[i:i + len(p)] for i in range(len(q) - len(p) + 1)] and 100 * b >= share * a for q, b in many.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, at, p.decode(), -a, left, r, n, -score) for at, (score, a, p, left, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def some_rows(seed: int, rows: int = 120) -> list[tuple]:
    random.seed(seed)
    words = ["a", "B", "cé", "日本", "the", "of", "x\x1cy", "z", "e f"]
    return [(i, "".join(random.choice(words) + random.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " \x0b"]) for _ in range(random.randint(0, 60))),
             random.choice(["en", "fr", None])) for i in range(rows)]


@pytest.mark.parametrize("burst,held", [(co.BURST, co.HELD), (4, 30)])
def test_equals_brute_force(spark, burst, held):
    rows = some_rows(burst)
    got = co.collocations(spark.createDataFrame(rows, DDL).repartition(5), least=5, top=40, burst=burst, held=held)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == brute(rows, 5, 50, 40)


def test_counts_equal_brute_force_when_numbers_begin_anew(spark, monkeypatch):
    counter = co.Counter(3, 20, 3, 4)
    monkeypatch.setattr(co, "WORDS", 6)
    rows, got = some_rows(7), Counter()

    def note(batch):
        for row in batch.to_pylist():
            for r in co._opened(row).to_pylist():
                got[row["lang"], r["phrase"]] += r["n"]

    for at in range(0, len(rows), 10):
        some = rows[at:at + 10]
        for batch in counter.add(pa.array([r[2] or "und" for r in some]), pa.array([r[1] for r in some])):
            note(batch)
    for batch in counter.ended():
        note(batch)
    want = {(lang, " ".join(p)): n for lang, f in counted(rows).items() for p, n in f.items()}
    assert {k: n for k, n in got.items() if k[1]} == want


def test_trie_bursts_between_prefixes_and_spills_whole_subtrees():
    trie, rng = co.HatTrie(burst=16), np.random.default_rng(1)
    want: Counter = Counter()
    for _ in range(30):
        w = rng.integers(1, 9, (40, 3))
        keys, n = np.unique(w[:, 0] << 2 * co.BITS | w[:, 1] << co.BITS | w[:, 2], return_counts=True)
        trie.add(keys, n)
        want.update(dict(zip(keys.tolist(), n.tolist())))
    assert trie.size == len(want) and {k: n for c in trie.containers for k, n in c.items()} == want
    for low, high, container in zip(trie.lows, [*trie.lows[1:], 1 << 63], trie.containers):
        assert all(low <= k < high for k in container)
        assert len(container) <= 16 or len({k >> co.BITS for k in container}) == 1
    taken = trie.spill(100)
    assert trie.size <= 100 and trie.size + taken.shape[1] == len(want)
    left = {k >> co.BITS for c in trie.containers for k in c}
    assert not left & {k >> co.BITS for k in taken[0].tolist()}


def test_runs_merge_in_parts(spark, monkeypatch):
    monkeypatch.setattr(co, "MERGED", 3)
    rows, out = some_rows(5), []
    counter = co.Counter(4, 50, 3, 2)
    for at in range(0, len(rows), 5):
        out += counter.add(pa.array(["en"] * 5), pa.array([r[1] for r in rows[at:at + 5]]))
    out += counter.ended()
    runs = pa.Table.from_batches(out).sort_by([("part", "ascending"), ("lang", "ascending")])
    got = [r for b in co._merged(iter(runs.to_batches(max_chunksize=3)), 2) for r in b.to_pylist()]
    f = counted([(0, r[1], "en") for r in rows])["en"]
    assert {r["phrase"]: r["n"] for r in got if r["phrase"]} == {" ".join(p): n for p, n in f.items() if n >= 2}
    assert len({r["phrase"] for r in got}) == len(got)


def test_large_numbers_are_exact(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    big = 3_000_000_017
    rows = [("en", "x", big + 5), ("en", "y", big + 9), ("en", "x y", big), ("en", "", 3 * big)]
    monkeypatch.setattr(co, "phrase_counts", lambda *a, **k: spark.createDataFrame(rows, "lang string, phrase string, n long"))
    r = co.collocations(spark.createDataFrame([], DDL)).collect()
    assert [(x.a, x.l, x.r, x.score) for x in r] == [(big, big + 5, big + 9, 1_000_000 * big * big // ((big + 5) * (big + 9)))]


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert sorted(tuple(r) for r in co.collocations(odd, least=2).select(*COLUMNS).collect()) == brute(rows, 2, 50, 2000)
    assert co.collocations(empty).collect() == []
    assert co.collocations(odd.where("text is null")).collect() == []
