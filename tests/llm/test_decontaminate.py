from __future__ import annotations

import random

import numpy as np

from warmtrace.llm import decontaminate as d


def brute_align(passage, item):
    """The table of Smith and Waterman, cell by cell."""
    s = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            same = d.MATCH if item[i - 1] == passage[j - 1] else d.MISS
            s[i, j] = max(0, s[i - 1, j - 1] + same, s[i - 1, j] + d.GAP, s[i, j - 1] + d.GAP)
    return s.max()


def test_alignment_scores_equal_the_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        passage, item = rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(1, 25))
        score, end = d.align(passage, item)
        assert score == brute_align(passage, item) and brute_align(passage[:end], item) == score


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))


def planted(spark):
    rng = random.Random(9)
    items = [[word(rng) for _ in range(rng.randint(12, 50))] for _ in range(12)]
    common = ["of", "the", "and", "so", "on"]
    items[3] = common * 6 + items[3]            # an item that begins with words all documents share
    rows, want = [], set()
    for n in range(200):
        text = [word(rng) for _ in range(rng.randint(0, 200))] + common * 3
        if n % 4 == 0:
            k = rng.randrange(12)
            copy = list(items[k])
            kind = n % 16
            if kind == 4:                       # edited: every sixth word replaced
                copy = [word(rng) if i % 6 == 5 else w for i, w in enumerate(copy)]
            if kind == 8:                       # words put in and left out, marks and capitals
                copy = [w.upper() + "," for i, w in enumerate(copy) if i % 9 != 8]
                copy.insert(5, "inserted")
            at = rng.randint(0, len(text))
            text[at:at] = copy
            want.add((n, k))
        rows.append((n, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"), want


def test_exact_and_edited_copies_are_found_and_nothing_else(spark):
    docs, items, want = planted(spark)
    found = d.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    assert all(0.5 <= r.score <= 1 and r.matched <= r.words and len(r.passage.split()) == r.words for r in found)
    small = d.leaks(docs, items, block_words=40).collect()      # one pass for each few items
    assert sorted(map(tuple, small)) == sorted(map(tuple, found))
    assert sorted(r.doc_id for r in d.clean(docs, items).collect()) == sorted(set(range(200)) - {n for n, _ in want})


def test_an_item_that_leaked_everywhere_is_found_everywhere(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(300).selectExpr("id as doc_id", f"concat('doc ', id, ' ', '{item}') as text")
    assert d.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 300


def test_odd_rows(spark, odd, empty):
    rows = [(1, "the cat sat on the mat and the dog"), (2, None), (None, "x"), (3, ""), (4, "too short"), (1, "the cat sat on the mat and the dog")]
    items = spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 as words", "2 as doc_id")
    found = d.leaks(odd, items).collect()
    assert [(r.doc_id, r.item_id, r.first_word, r.words) for r in found] == [(1, 1, 0, 9)]
    assert d.clean(odd, items).columns == odd.columns and d.clean(odd, items).count() == odd.count() - 1
    assert d.leaks(empty, items).collect() == [] and d.clean(empty, items).collect() == []
    assert d.leaks(odd, items.where("false")).collect() == [] and d.clean(odd, items.where("false")).count() == odd.count()
