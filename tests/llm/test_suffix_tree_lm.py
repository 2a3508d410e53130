from __future__ import annotations

import glob
import math
import os
import random
import time
from collections import Counter

import numpy as np
import pytest

from warmtrace.llm import suffix_tree_lm as lm


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute_base(training, text):
    counts = Counter(t for x in training for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(text)), sum(counts[t] > 0 for t in tokens(text))


class Brute:
    """The tree from its definition: which contexts must be kept, and what each makes of a next word."""

    def __init__(self, training, depth=3, price=2.0):
        self.texts = [tokens(t) for t in training]
        self.counts = Counter(t for x in self.texts for t in x)
        self.n, self.depth = sum(self.counts.values()), depth
        bits = price * math.log2(max(self.n, 2))
        self.kept, before = {}, {(t,): self.base(t) for t in self.counts}
        for length in range(1, depth + 1):
            follow = {}
            for x in self.texts:
                for i in range(length, len(x)):
                    follow.setdefault(tuple(x[i - length:i]), Counter())[x[i]] += 1
            after = {}
            for context, nexts in follow.items():
                total = sum(nexts.values())
                listed = {t: (n, before[context[1:] + (t,)]) for t, n in nexts.items() if n > 1 and context[1:] + (t,) in before}
                listed = {t: (n, q) for t, (n, q) in listed.items() if -n * math.log2(q) > bits}
                if not listed:
                    continue
                left = max(1 - sum(n - 0.5 for n, _ in listed.values()) / total, 1e-9)
                own = {t: (n - 0.5) / total + left * q for t, (n, q) in listed.items()}
                gain = sum(n * math.log2(own[t] / q) for t, (n, q) in listed.items()) + (total - sum(n for n, _ in listed.values())) * math.log2(left)
                kept = gain > bits * len(listed)
                p = own if kept else {t: q for t, (_, q) in listed.items()}
                if kept:
                    self.kept[context] = left, own
                after.update({context + (t,): p[t] for t, (n, _) in listed.items() if -n * math.log2(p[t]) > bits})
            before = after

    def base(self, t):
        return (self.counts[t] + 0.1) / (self.n + 0.1 * (len(self.counts) + 1))

    def p(self, context, t):
        """The longest kept context first; what it does not list is shared as its suffix has it."""
        if not context:
            return self.base(t)
        left, own = self.kept.get(context, (1.0, {}))
        return own[t] if t in own else left * self.p(context[1:], t)

    def score(self, text):
        x = tokens(text)
        return sum(math.log10(self.p(tuple(x[max(0, i - self.depth):i]), t)) for i, t in enumerate(x))


def corpus(rng, n):
    follow = {"der": ["hund", "mann", "baum"], "die": ["frau", "katze"], "the": ["dog", "man", "tree"], "new": ["york"], "york": ["city", "times"]}
    out = []
    for _ in range(n):
        words = []
        while len(words) < 40:
            w = rng.choice([*follow, "and", "und", "is", "ist"])
            words.append(w)
            while w in follow:
                w = rng.choice(follow[w])
                words.append(w)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    texts = corpus(random.Random(3), 60)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return texts, *lm.learn(df)


def test_scores_equal_brute_force(spark, learned):
    texts, model, counts = learned
    brute = Brute(texts)
    assert len(brute.kept) >= 4
    tests = corpus(random.Random(8), 10) + ["der unseen Hund", "", None, "YORK york\tcity", "der"]
    rows = lm.score(spark.createDataFrame([(i, t) for i, t in enumerate(tests)], "doc_id long, text string"), model, counts).collect()
    for r in rows:
        base, known = brute_base(texts, tests[r.doc_id])
        assert abs(r.base_score - base) < 1e-9 and r.n_known == known and r.n_tokens == len(tokens(tests[r.doc_id]))
        assert r.train_tokens == sum(len(tokens(t)) for t in texts)
        assert abs(r.score - brute.score(tests[r.doc_id])) < 1e-9
    held = [r for r in rows if r.doc_id < 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 50


def test_every_context_adds_up_to_one(learned):
    brute = Brute(learned[0])
    words = [*brute.counts, b"never seen"]
    for context in [(), *brute.kept]:
        assert abs(sum(brute.p(context, t) for t in words) - 1) < 1e-9


def test_long_repeats_end_with_the_memory_of_the_tree(spark, monkeypatch):
    """A text of 3,000 words three times over: a pass for each length up to the depth, and the kept contexts of the definition."""
    rng, passes = random.Random(9), []
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(3000))
    texts = [f"a {long}", f"b {long}", f"c {long} d", "w1 w2", "w2 w1"]
    level = lm._level
    monkeypatch.setattr(lm, "_level", lambda *a: passes.append(a) or level(*a))
    model, counts = lm.learn(spark.createDataFrame([(t,) for t in texts], "text string"), depth=6, price=0.1)
    brute = Brute(texts, depth=6, price=0.1)
    assert len(passes) <= 6 and max(map(len, brute.kept)) >= 2
    tests = [texts[0], " ".join(long.split()[500:700]), "w1 w2 w3"]
    for r in lm.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model, counts).collect():
        assert abs(r.score - brute.score(tests[r.doc_id])) < 1e-6


def test_runs_in_many_parts_and_blocks_give_the_same(spark, learned, monkeypatch):
    texts = learned[0]
    brute = Brute(texts)
    monkeypatch.setattr(lm, "HELD", 50)
    parts = [np.array([[1, 2, 5], [1, 2, 3], [2, 2, 3], [1, 1, 2]]), np.array([[1, 1], [1, 1], [2, 2], [1, 1]])]
    assert sorted(lm._added(np.concatenate(parts, axis=1)).T.tolist()) == [[1, 1, 2, 3], [2, 2, 2, 1], [5, 3, 3, 2]]
    runs = sorted((b.to_pylist()[0] for p in parts for b in lm._sent(p, 1)), key=lambda r: r["part"])
    import pyarrow as pa
    merged = [r for b in lm._merged(iter(pa.Table.from_pylist(runs).to_batches()), 2, np.zeros(0)) for r in b.to_pylist()]
    assert sorted((r["n"], r["total"]) for r in merged) == [(2, 2), (3, 3)]
    assert brute.kept


def test_rare_words_meet_their_counts_by_a_join(spark, learned):
    texts = learned[0]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model, counts = lm.learn(df, most_words=3)
    assert model.size <= 4
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:9] + ["never seen der"])], "doc_id long, text string")
    for r in lm.score(docs, model, counts).collect():
        base, known = brute_base(texts, (texts[:9] + ["never seen der"])[r.doc_id])
        assert abs(r.base_score - base) < 1e-9 and r.n_known == known


def test_odd_rows(spark, odd, empty):
    model, counts = lm.learn(odd.where("doc_id < 6").select("text"))
    rows = lm.score(odd, model, counts).collect()
    training = [r.text for r in odd.where("doc_id < 6").collect()]
    texts = sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert len(rows) == len(texts) and "text" not in rows[0].asDict() and "words" in rows[0].asDict()
    want = sorted(round(brute_base(training, t)[0], 6) for _, t in texts)
    assert sorted(round(r.base_score, 6) for r in rows) == want
    assert lm.score(empty, model, counts).collect() == []
    model, counts = lm.learn(empty.select("text"))
    assert all(r.base_score == r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in lm.score(odd, model, counts).collect())


def test_rare_and_long_contexts_are_kept_beyond_what_workers_hold(spark):
    """The model does not depend on the bounds of what workers hold, and has contexts of three words and rare words."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(80)]
    # Only all three words before it tell the fourth: each pair is followed by both.
    texts += [f"{a} mid {b} {'even' if (a == 'x') == (b == 'u') else 'odd'}" for a in "xy" for b in "uv"] * 40
    texts += ["seldom pair"] * 5
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tests = spark.createDataFrame([(i, t) for i, t in enumerate(["x mid u even", "x mid v odd", "seldom pair", texts[0]])], "doc_id long, text string")
    scores = []
    for bounds in ({}, {"share": 2.0}, {"most_words": 3}):
        model, counts = lm.learn(df, **bounds)
        assert model.longest >= 4
        scores.append({r.doc_id: (r.score, r.base_score) for r in lm.score(tests, model, counts).collect()})
    brute = Brute(texts)
    assert {len(c) for c in brute.kept} >= {1, 3}
    assert all(abs(scores[0][i][0] - brute.score(t)) < 1e-9 for i, t in enumerate(["x mid u even", "x mid v odd", "seldom pair", texts[0]]))
    for other in scores[1:]:
        assert all(abs(a - b) < 1e-9 for i in other for a, b in zip(other[i], scores[0][i]))
    # "even" is nearly sure behind "x mid u", and "pair" behind "seldom".
    assert scores[0][0][0] > scores[0][0][1] + 3 and scores[0][2][0] > scores[0][2][1] + 2


def test_workers_hold_as_many_sequences_as_their_bound_allows(spark, learned):
    """Sequences below ``share`` are held too while there is room; beyond it the rest meets the texts by a join, with the same scores."""
    texts, whole, _ = learned
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tests = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:5])], "doc_id long, text string")
    brute, every = Brute(texts), len(whole.keys.keys) + whole.rest.count()
    assert every > 8
    for share in (3.5 / every, 1.0):
        model, counts = lm.learn(df, share=share)
        held = len(model.keys.keys)
        assert held <= 4 / share and held + model.rest.count() == every
        assert (held == every) == (share < 1)
        for r in lm.score(tests, model, counts).collect():
            assert abs(r.score - brute.score(texts[r.doc_id])) < 1e-9


def test_shuffle_files_go_with_each_table(spark):
    def files():
        return {f for d in {spark.conf.get("spark.local.dir", "/tmp"), os.environ.get("SPARK_LOCAL_DIRS", "/tmp")}
                for f in glob.glob(f"{d}/**/blockmgr-*/*/shuffle_*.data", recursive=True) if os.stat(f).st_size}

    before, setting = files(), spark.conf.get(lm.CLEANUP)
    counts = lm.word_counts(spark.createDataFrame([("a b c",), ("b c d",)], "text string"))
    made = lm._written(counts)
    assert spark.conf.get(lm.CLEANUP) == setting
    for _ in range(50):   # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert made.count() == 4
