from __future__ import annotations

import re
import weakref

import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from compare import compare, connect
from warmtrace.llm import language_id, queries, tokens

SF = "/root/testdata/sf0.001"


def test_stages_over_the_tables(spark):
    """Each stage's rows by rules of their own: what goes, what stays, and what is changed."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES[:-1]:
        out = cp.materialise(stage(spark, docs, SF))
        assert out.columns == columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert after.keys() <= before.keys() and out.count() == len(after)
        gone = [before[i] for i in before.keys() - after.keys()]
        if name == "language_id":
            assert all(not re.search("[a-z]", r.text or "", re.I) for r in gone)
        if name == "benchmark_decontamination":
            assert all(not any(item in (r.text or "").lower() for item in items) for r in after.values())
            assert len(gone) < 0.2 * len(before)
        if name == "secret_scan":
            assert not gone and not any(re.search("[0-9a-f]{24}|token = \"[0-9a-z]", r.text or "") for r in after.values())
        docs = out
    pieces = cp.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()} <= ids


def test_odd_rows_pass_all_stages(spark, odd, empty):
    docs = odd
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert (1, "The cat sat on the mat and the dog lay by the door.") in kept
    assert not {i for i, _ in kept} & {2, 3, 4, 7} and sum(i == 8 for i, _ in kept) == 2
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_all_operators_are_registered():
    names = entry.queries()
    assert [n for n, _ in cp.STAGES] and "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


@pytest.mark.parametrize("name", sorted(cp.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, cp.QUERIES[name], cp.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", ["op3_decontamination", "op5_token_output", "op6_quality", "op8_lm", "op9_licenses"])
def test_query_covers_its_table(spark, name):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    rows = cp.QUERIES[name](spark, SF).collect()
    found = {i for r in rows for i in r.doc_ids} if name.startswith("op5") else {r.doc_id for r in rows}
    assert found <= docs and (found == docs or name.startswith("op3"))


def test_a_worker_keeps_what_one_stage_needs():
    """The automata of the language stage are gone when the tokenizer of the packing stage is there, and the other way round."""
    samples = (("de", ("der Hund und die Katze",)), ("en", ("the dog and the cat",)))
    automata = weakref.ref(language_id._languages(samples))
    assert language_id._languages(samples) is automata()
    words = weakref.ref(tokens.word_tokenizer(public_tokenizers.path(queries.TOKENIZER)))
    assert automata() is None and tokens.word_tokenizer(public_tokenizers.path(queries.TOKENIZER)) is words()
    language_id._languages(samples)
    assert words() is None
