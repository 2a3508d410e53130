from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from warmtrace.llm import packing, token_output
from warmtrace.llm.tokens import Remembered, WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(reference):
    odd = ["don't we'll Straße É é́ x a b x y ΣΑΣ naïve… 10,000 <|endoftext|> I'm. (x) 'tis o'", " tab\tnew\nline\x0bv\x1cw İstanbul ŒUVRE ",
           "", None, "日本語 テキスト。ok ½ ²x x² _a_ a_b", "   ", "x", "same same Same, same."]
    found = WordTokenizer(PATH, cached=3).encode(pa.array(odd))
    assert [ids.tolist() for ids in found] == [reference(t) for t in odd]
    assert list(WordTokenizer(PATH).encode(pa.array([], pa.string()))) == []


def test_pieces_are_learned_once_and_by_the_model_alone():
    words = WordTokenizer(PATH)
    asked, library = [], words.tokenizer

    class Watched:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    words.tokenizer = Watched()
    texts = ["Same same, SAME. (same) same;same", "Über den Übeln, être; Être.", "10,000 a1b22", None, "tel: 555-0207"]
    found = [ids.tolist() for ids in words.encode(pa.array(texts))]
    assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert asked == [] and len(words.known.young) < 30
    assert [p for p in words.known.young if b"same" in p.lower()] == [b"same"]


def test_ids_next_to_marks_and_apostrophes(reference):
    # H, T, W, J and Y have composed forms with these marks in lower case only.
    odd = ["H\u0331 T\u0308 W\u030a J\u030c Y\u030a h\u0331", "=\u0338 <\u0338, 1\u0301", "x's 'rex ''re .'s 5's é's 's's",
           "a×b c÷d µ ª\xa0b\x85c", "\u212a \u037e\u037f \x1c\x00 a\x7fb", "ÀÉÞß.ÿ,Ā…x…"]
    parts = [t[k:] for t in odd for k in range(len(t))]
    for kind in (pa.string(), pa.large_string()):
        words = WordTokenizer(PATH, cached=20)
        for some in [odd, *([t] for t in odd), parts]:
            array = pa.array([None, "before", *some], kind).slice(2)
            assert [ids.tolist() for ids in words.encode(array)] == [reference(t) for t in some]


def test_remembered_is_bounded_and_right():
    cache = Remembered(10)
    for k in range(100):
        for key in cache.missing([k, k // 2]):
            cache.young[key] = key * 7
        assert cache.young[k] == k * 7 and cache.young[k // 2] == k // 2 * 7
        assert len(cache.young) <= 13


def pieces_of(docs, **options):
    return packing.pack(docs, tokenizer=PATH, **options).collect()


def check_pieces(rows, texts, reference, window):
    """Every id in one piece, sequences without gaps, and no padding but in powers of two."""
    documents = defaultdict(list)
    for r in rows:
        documents[r.doc_id].append(r)
        assert r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    want = Counter()
    for doc_id, text in texts:
        ids = [*reference(text), 1]
        want.update((doc_id, k, x, len(ids)) for k, x in enumerate(ids))
    got = Counter()
    for r in rows:
        got.update((r.doc_id, r.start + k, int(x), r.doc_tokens) for k, x in enumerate(np.frombuffer(r.ids, "<u4")))
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and (at == window or at & (at - 1) == 0)


@pytest.mark.parametrize("window, open_windows", [(64, 3), (2048, 32), (8, 1)])
def test_pack(spark, odd, reference, window, open_windows):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    for parts in (1, 5):
        rows = pieces_of(odd.repartition(parts), window=window, open_windows=open_windows)
        check_pieces(rows, texts, reference, window)


def test_remainders_are_merged_in_rounds(spark, reference, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 2)
    docs = spark.range(40).selectExpr("id as doc_id", "repeat('some words here ', cast(id as int)) as text").repartition(11)
    check_pieces(pieces_of(docs, window=128), [(r.doc_id, r.text) for r in docs.collect()], reference, 128)


def test_pack_empty(empty):
    assert pieces_of(empty) == []


def test_windows_take_the_best_fit():
    windows = packing.Windows(10, 2)
    shape = lambda pieces: [(p[0], p[1], len(p[2])) for p in pieces]
    for doc_id, length in ((1, 6), (2, 5)):
        assert list(windows.add(doc_id, np.arange(length))) == []
    # Neither holds 8 and no third may be open: the fullest is filled up, the rest fits the other.
    assert [shape(w) for w in windows.add(3, np.arange(8))] == [[(1, 0, 6), (3, 0, 4)]]
    assert [shape(pieces) for _, pieces in windows.open] == [[(2, 0, 5), (3, 4, 4)]]
    assert list(windows.add(4, np.arange(3))) == []                       # a new window: 9 and 3 do not fit
    assert [shape(w) for w in windows.add(5, np.arange(1))] == [[(2, 0, 5), (3, 4, 4), (5, 0, 1)]]   # the tighter one
    assert [(shape(w), full) for w, full in windows.merge()] == [([(4, 0, 3)], False)]


def test_best_fit_decreasing_equals_a_search_over_all_windows():
    rng = np.random.default_rng(5)
    for window in (1, 7, 64):
        lengths = rng.integers(1, window + 1, 300)
        place, made = token_output.best_fit_decreasing(lengths, window)
        room: list[int] = []
        for k in np.argsort(-lengths, kind="stable"):
            fits = [r for r in room if r >= lengths[k]]
            if fits:
                room[room.index(min(fits))] -= lengths[k]
            else:
                room.append(window - lengths[k])
        used = np.bincount(place, lengths, made)
        assert made == len(room) and sorted(window - used) == sorted(room)


@pytest.mark.parametrize("kind, block_tokens", [("<u2", 4_000_000), ("<u4", 500)])
def test_matrices_round_trip(odd, reference, kind, block_tokens, tmp_path):
    rows = token_output.matrices(odd, tokenizer=PATH, window=256, kind=kind, block_tokens=block_tokens)
    token_output.write(rows, str(tmp_path / "out"))
    rows = odd.sparkSession.read.parquet(str(tmp_path / "out")).collect()
    ids, positions = token_output.matrix(rows, "input_ids", kind), token_output.matrix(rows, "position_ids", "<u4")
    assert ids.shape == (len(rows), 256) and len({r.sequence_id for r in rows}) == len(rows)
    got = Counter()
    for k, r in enumerate(rows):
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.tokens and not ids[k, r.tokens:].any()
        for doc_id, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[k, a:b].tolist() == list(range(b - a))
            got.update((doc_id, start + n, x) for n, x in enumerate(ids[k, a:b].tolist()))
    want = Counter((r.doc_id, n, x) for r in odd.collect() for n, x in enumerate([*reference(r.text), 1]))
    assert got == want


def test_matrices_empty(empty):
    assert token_output.matrices(empty, tokenizer=PATH).collect() == []
