from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from warmtrace.llm import language_id as li


def brute_phrases(snippets, codes):
    """Greedy phrases, each the longest stretch that some snippet contains; unknown symbols are phrases alone."""
    count = at = 0
    while at < len(codes):
        size = 0
        while at + size < len(codes) and any(codes[at:at + size + 1] == s[k:k + size + 1] for s in snippets for k in range(len(s))):
            size += 1
        count, at = count + 1, at + max(size, 1)
    return count


def test_phrases_equal_brute_force():
    rng = random.Random(4)
    snippets = ["".join(rng.choice("abc ") for _ in range(rng.randint(3, 40))) for _ in range(8)]
    number = {c: n for n, c in enumerate("abc ", 1)}
    automaton = li.Automaton([np.array([number[c] for c in s]) for s in snippets], 5)
    texts = ["".join(rng.choice("abc z") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts.sort(key=len, reverse=True)
    codes = np.array([number.get(c, 0) for t in texts for c in t], np.uint16)
    lengths = np.array([len(t) for t in texts])
    got = automaton.phrases(codes, np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [brute_phrases(snippets, t) for t in texts]


def test_symbols_are_letters_and_single_spaces():
    texts = ["Ab, 12 cD!", None, "", "  x", "é́ 9", "日本", "!!"]
    codes, first, lettered = li.symbols(pa.array(texts))
    words = ["".join(chr(c) if c else " " for c in codes[a:b]) for a, b in zip(first, first[1:])]
    assert words == ["ab cd ", "", "", "x ", "é́ ", "日本 ", ""]
    assert lettered.tolist() == [True, False, False, True, True, True, False]


def corpus(rng, vocabulary, n):
    return [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(n)]


def test_held_out_texts_and_odd_ones(spark, odd, empty):
    rng = random.Random(1)
    own = {"aa": ["the", "house", "with", "water", "thing", "over"], "bb": ["der", "haus", "mit", "wasser", "ding", "über"],
           "cc": ["дом", "вода", "вещь", "над", "под"]}
    rows = [(lang, text) for lang, vocabulary in own.items() for text in corpus(rng, vocabulary, 40)] + [(None, "x y"), ("dd", None)]
    samples = li.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert [n for n, _ in samples] == ["aa", "bb", "cc"]
    tests = [(lang, text) for lang, vocabulary in own.items() for text in corpus(rng, vocabulary, 10)]
    found = li.identify(spark.createDataFrame(tests, "lang string, text string"), samples).collect()
    assert all(r.lang == r.lang_pred and 0.99 < r.score <= 1 for r in found)
    rows = li.identify(odd, samples).collect()
    assert len(rows) == odd.count() and set(odd.columns) | {"lang_pred", "bits_per_symbol"} == set(rows[0].asDict())
    for r in rows:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        assert 0 <= r.score <= 1
    assert li.identify(empty, samples).collect() == []
    assert {r.lang_pred for r in li.identify(odd, ()).collect()} == {"und"} and li.learn(empty.select("text", "lang")) == ()


def test_texts_do_not_touch_each_other(spark):
    samples = (("aa", ("abc abd " * 9,)), ("bb", ("xyz xyw " * 9,)))
    texts = ["abc abd", "xyz xyw", "abc " * 300, "q"]
    alone = [li._languages(samples).parse(pa.array([t]))[0].tolist()[0] for t in texts]
    assert li._languages(samples).parse(pa.array(texts))[0].tolist() == alone


def test_accuracy_on_the_tables(spark):
    from warmtrace.llm.queries import op4_language
    sf = "/root/testdata/sf0.01"
    found = op4_language(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.where("lang is not null").count()


def test_each_symbol_of_the_samples_has_its_codes():
    rng = random.Random(2)
    points = np.array([rng.randrange(0x4E00, 0x5A00) for _ in range(9_000)] + [0] * 50, np.uint32)
    alphabet = li.Alphabet([points], 20)
    known = np.unique(points)
    pairs = {(int(alphabet.first[p]), int(alphabet.second[p])) for p in known}
    assert len(pairs) == len(known) and all(a for a, _ in pairs) and alphabet.second[0] == 0
    assert max(max(p) for p in pairs) < alphabet.width < 2 * len(known) ** 0.5 + 24
    # Firsts and seconds are different codes: a sequence reads in one way only.
    assert not {a for a, _ in pairs} & {b for _, b in pairs if b}
    codes, first = alphabet.codes(np.array([0, known[0], known[7], 0x41], np.uint32), np.array([0, 2, 2, 4]))
    want = [[c for c in (alphabet.first[p], alphabet.second[p]) if c] or [0] for p in (0, known[0], known[7], 0x41)]
    assert codes.tolist() == sum(want, []) and first.tolist() == [0, len(want[0] + want[1]), len(want[0] + want[1]), len(codes)]


def test_a_language_of_many_letters_stays(spark):
    import corpus_pipeline as cp
    rng = random.Random(3)
    signs = [chr(0x4E00 + n) for n in range(3_000)]
    words = ["".join(rng.choice(signs) for _ in range(2)) for _ in range(2_000)]
    latin = ["house", "water", "thing", "over", "with", "under", "light"]
    many = ["".join(rng.choice(words) for _ in range(150)) for _ in range(150)]
    few = [" ".join(rng.choice(latin) for _ in range(60)) for _ in range(50)]
    more = ["".join(rng.choice(words) for _ in range(150)) for _ in range(20)]
    # No order at all, 2,000 other signs: the dearest text that a language can be.
    free = ["".join(chr(0x6000 + rng.randrange(2_000)) for _ in range(300)) for _ in range(150)]
    noise = ["".join(chr(rng.randrange(0xAC00, 0xD7A0)) for _ in range(200)) for _ in range(5)]
    rows = [("zz", t) for t in many] + [("en", t) for t in few] + [("uu", t) for t in free] + [(None, t) for t in more + noise]
    docs = spark.createDataFrame([(n, t, lang) for n, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    left = {r.doc_id: r.lang for r in cp.identify_language(spark, docs, "").collect()}
    assert [left.get(n) for n in range(370)] == ["zz"] * 150 + ["en"] * 50 + ["uu"] * 150 + ["zz"] * 20
    assert not set(left) & set(range(370, 375))
    samples, held = li.sample(docs.select("text", "lang"), held_out=20)
    assert all(texts and not set(texts) & set(dict(samples)[name]) for name, texts in held)
