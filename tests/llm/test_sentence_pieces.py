from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from warmtrace.llm import queries, sentence_pieces

MODEL = public_tokenizers.path(queries.PIECES)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def test_any_text_equals_the_library(library):
    encoder = sentence_pieces.PieceEncoder(MODEL, cached=50)
    random.seed(3)
    letters = list(" ▁  aeth\t\n日é0<>x\x00.,'1①²½_́ 😀Ω") + ["  ", "the ", "<s>", "</s>", "<0x0A>", "².", "ing"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 70))) for _ in range(3000)] + ["x1" * 100_000, " " * 999, "no" * 50_000]
    for at in range(0, len(texts), 100):
        some = texts[at:at + 100]
        assert [np.frombuffer(b, "<i4").tolist() for b in encoder.encode(some)] == library.encode(some)


def test_without_cuts_gives_the_same(library):
    encoder = sentence_pieces.PieceEncoder(MODEL)
    text = "Some words, and  spaces. 日本語 ▁ and\nlines 12.5 x"
    assert encoder.agenda("▁" + text.replace(" ", "▁")) == library.encode(text)


def test_a_wrong_id_is_noticed():
    encoder = sentence_pieces.PieceEncoder(MODEL)
    encoder.ids["▁the"] += 1
    with pytest.raises(ValueError, match="library"):
        list(encoder.encode(["the end"]))


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_sentence_pieces(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_round_trip_and_odd_rows(spark, odd, empty):
    marked = odd.withColumns({"ids": F.lit("own"), "decoded": F.lit(1)})
    found = sentence_pieces.encode(marked, model=MODEL, end=False)
    assert found.columns == [c for c in marked.columns if c not in ("text", "ids")] + ["ids"]
    back = sentence_pieces.decode(found, model=MODEL)
    want = sorted((str(r.doc_id), r.text or "", r.n_chars or -1, r.score) for r in odd.collect())
    assert sorted((str(r.doc_id), r.text, r.n_chars or -1, r.score) for r in back.collect()) == want
    assert sentence_pieces.encode(empty, model=MODEL).collect() == []
    ends = sentence_pieces.encode(odd.where("text is null"), model=MODEL, decoded=True).collect()
    assert [(r.ids, r.decoded) for r in ends] == [([2], "")] * 2
    nulls = spark.createDataFrame([(None,), ([],), ([2],)], "ids array<int>")
    assert [r.text for r in sentence_pieces.decode(nulls, model=MODEL).collect()] == [None, "", ""]
