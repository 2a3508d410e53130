from __future__ import annotations

import numpy as np
import pyarrow as pa

from warmtrace.llm.lookup import Lookup, Words, word_hashes

WORDS = [b"", b"a", b"a\0", b"b", b"abcdefgh", b"abcdefgh\0", b"abcdefghi", "über".encode(), b"x" * 63, b"x" * 64, b"x" * 65, b"x" * 100_000]


def test_hash_depends_on_the_bytes_alone():
    whole = word_hashes(pa.array(WORDS, pa.binary()))
    assert len(set(whole.tolist())) == len(WORDS)
    assert word_hashes(pa.array(WORDS, pa.large_binary()).slice(3, 5)).tolist() == whole[3:8].tolist()
    assert word_hashes(pa.array([w.decode() for w in WORDS[::-1]])).tolist() == whole[::-1].tolist()
    assert word_hashes(pa.array([], pa.string())).tolist() == [] and word_hashes(pa.array([""])).tolist() == [whole[0]]


def test_lookup_is_a_search():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000, 5000):
        keys = np.unique(rng.integers(-1 << 63, (1 << 63) - 1, n, np.int64))
        crowded = np.unique(np.concatenate([keys, np.arange(50)]))   # many keys with the same leading bits
        for some in (keys, crowded):
            wanted = np.concatenate([rng.permutation(some), rng.integers(-1 << 63, (1 << 63) - 1, 100, np.int64), np.array([-1, 0, 49, 50])])
            places = {k: i for i, k in enumerate(some.tolist())}
            assert Lookup.of(some).find(wanted).tolist() == [places.get(w, -1) for w in wanted.tolist()]


def test_numbers_of_words():
    words = Words.of(WORDS[::2])
    number, hashes = words.numbers(pa.array(WORDS, pa.binary()))
    assert number.tolist() == [i // 2 if i % 2 == 0 else -1 for i in range(len(WORDS))]
    assert hashes.tolist() == word_hashes(pa.array(WORDS, pa.binary())).tolist()
    assert Words.of([]).numbers(pa.array(["a"]))[0].tolist() == [-1]
