from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from warmtrace.llm import quality as q


def good_text(rng):
    return ". ".join(" ".join(rng.choice(["some", "plain", "words", "about", "weather", "and", "houses", "of", "the", "town"]) + str(rng.randint(0, 300))
                              for _ in range(rng.randint(8, 14))) for _ in range(6))


def bad_text(rng):
    word = rng.choice(["buy", "now", "cheap"])
    return rng.choice([f"{word}!! " * 40, " | ".join("x%d" % rng.randint(0, 9) for _ in range(60)), "%%% $$$ &&& " * 20])


def test_measures_of_known_texts():
    texts = ["a a a a", "One two.\nOne two.\nthree", None, "", "x" * 50, "| ! | ?"]
    found = dict(zip(q.NAMES, q.measure(pa.array(texts)).T))
    assert found["same_as_last"].tolist() == [0.75, 0, 0, 0, 0, 0] and found["most_frequent"][0] == 1
    assert found["different_words"][:2].tolist() == [0.25, 0.6]
    assert found["same_lines"][1] == 1 / 3 and found["share_bar"][5] == 2 / 7 and found["one_sign_words"][5] == 1
    assert abs(found["repeats_2"][0] - 2 / 3) < 1e-12 and found["word_length"][4] == 50
    assert all(np.isfinite(v).all() for v in found.values())


def test_learns_from_positives_and_unlabelled_only(spark):
    rng = random.Random(6)
    texts = [(i, good_text(rng), 1) if rng.random() < 0.7 else (i, bad_text(rng), 0) for i in range(1500)]
    df = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    measured = q.features(df)
    model = q.learn(measured.where("doc_id < 1000").select("doc_id", "features"), df.where("quality = 1 and doc_id < 1000 and doc_id % 3 = 0"))
    assert 0.55 < model.prior < 0.75
    rows = q.score(measured.where("doc_id >= 1000"), model).collect()
    assert len(rows) == 500 and np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) > 0.97
    ranked = sorted(rows, key=lambda r: r.score)
    bad = sum(r.quality == 0 for r in rows)
    assert sum(r.quality == 0 for r in ranked[:bad]) >= 0.98 * bad


def test_class_prior_of_a_mixture():
    rng = np.random.default_rng(0)
    for prior in (0.3, 0.6, 0.9):
        good = rng.normal(2, 1, 20_000)
        web = np.where(rng.random(20_000) < prior, rng.normal(2, 1, 20_000), rng.normal(-3, 1, 20_000))
        assert abs(q.class_prior(good, web) - prior) < 0.04


def test_odd_rows(odd, empty):
    measured = q.features(odd)
    assert measured.columns == [c for c in odd.columns if c not in ("text", "features")] + ["features"]
    model = q.learn(measured, odd.where("doc_id < 5"))
    rows = q.score(measured, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    nothing = q.learn(q.features(empty), empty)
    assert {r.score for r in q.score(measured, nothing).collect()} == {0.5}
    assert q.score(q.features(empty), model).collect() == []
    alone = q.learn(measured, empty)
    assert {r.score for r in q.score(measured, alone).collect()} == {0.5}
