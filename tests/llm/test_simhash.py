from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from warmtrace.llm import simhash
from warmtrace.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius):
    """Class of each distinct print: union of all pairs within the radius."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = sorted(prints)
    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_odd_rows_equal_brute_force(odd):
    rows = odd.collect()
    prints = [brute_print(r.text) for r in rows]
    classes = brute_classes(set(prints), 2)
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[classes[p]] = min(least.get(classes[p], r.doc_id), r.doc_id)
    want = sorted((r.doc_id, p, least.get(classes[p])) for r, p in zip(rows, prints) if r.doc_id is not None)
    found = simhash.near_duplicates(odd).collect()
    got = sorted((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in found if r.doc_id is not None)
    assert got == want and len(found) == len(rows)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius, crowd", [(0, 64), (2, 64), (2, 3), (4, 5)])
def test_links_join_what_brute_force_joins(spark, radius, crowd):
    """Random prints, chains of near ones, and a crowd that differs in the bits of one part only."""
    rng = random.Random(radius * 7 + crowd)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:20]:
        for _ in range(5):
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    base = rng.getrandbits(64)
    prints |= {base ^ (1 << i) ^ (1 << j) for i in range(0, 16) for j in range(16, 20)}
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    links = simhash.links(df, radius, crowd)
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= radius for r in links.collect())
    roots = {r.node % (1 << 64): r.root for r in components(links).collect()}
    want = brute_classes(prints, radius)
    ours = {}
    for p in prints:
        ours.setdefault(roots.get(p, signed(p)), set()).add(p)
    theirs = {}
    for p, c in want.items():
        theirs.setdefault(c, set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_thresholds_by_trying_all():
    from itertools import product
    rng = np.random.default_rng(3)
    for parts, radius in ((1, 2), (2, 2), (3, 2), (4, 2), (3, 4)):
        costs = [[0.0, *np.cumsum(rng.random(radius + 1)).tolist()] for _ in range(parts)]
        least, chosen = simhash.thresholds(costs, radius)
        assert sum(chosen) == radius - parts + 1
        brute = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in product(range(-1, radius + 1), repeat=parts)
                    if sum(ts) == radius - parts + 1)
        assert abs(least - brute) < 1e-12


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (500, 501), (501, 500), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}, 500: 500, 501: 500}


def test_one_of_each_keeps_the_smallest_id(odd, empty):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.select("doc_id", "text").collect()
    found = {(r.doc_id, r.text) for r in rows}
    assert len(rows) == len(found)
    assert (5, ) in {(i,) for i, _ in found} and 6 not in {i for i, _ in found}     # equal texts
    assert {2, 3, 4} & {i for i, _ in found} == {2}                              # texts without words are one class
    assert sum(i == 8 for i, _ in found) == 2                                    # one id, two texts; equal rows once
    assert (None, "a text without an id") in found
    assert simhash.one_of_each(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_odd_radius_is_refused(odd):
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd, radius=3)
