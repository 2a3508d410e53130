"""From raw documents to packed sequences: five stages, one operator each.

Every stage works on all that its predecessor kept, and its decisions take effect.  All but the last
return the columns of ``documents``.  A stage written as Parquet and read again is the next one's input.

A document goes where its language cannot be told (no letters, or hardly a letter pair known to any
learned language), where an earlier document of its group of linked fingerprints stays, or where a benchmark item leaked
into it.  Secrets are masked, no document goes for them.  All other documents stay, whatever nulls,
clashing columns or repeated rows there are; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warmtrace.llm import decontaminate, language_id, packing, queries, secret_scan, simhash
from warmtrace.llm.common import materialise, table

# A text that costs more bits a letter than this in its best language is in none of them, unless labelled
# text of that language that is held out costs about as much: then it may cost half as much again.
MOST_BITS, MOST_TIMES = 8.0, 1.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is labelled somewhere; a null ``lang`` is filled in.  Without labels all stay."""
    samples, held = language_id.sample(docs.select("text", "lang"), held_out=20)
    if not samples:
        return docs
    found = language_id.identify(docs, samples)
    most = F.lit(MOST_BITS)
    for name, bits in language_id.usual_bits(spark, samples, held).items():
        if MOST_TIMES * bits > MOST_BITS:
            most = F.when(F.col("lang_pred") == name, MOST_TIMES * bits).otherwise(most)
    known = found.where((F.col("lang_pred") != "und") & (F.col("bits_per_symbol") <= most))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints link the one with the smallest id; rows and bits as in ``op2_simhash``."""
    return simhash.one_of_each(docs, words=3, radius=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text."""
    masked = secret_scan.masked(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint")))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 ids, the ids with them."""
    return packing.pack(docs, tokenizer=public_tokenizers.path(queries.TOKENIZER))


STAGES = [("language_id", identify_language), ("simhash_near_dedup", drop_near_duplicates),
          ("benchmark_decontamination", drop_leaks), ("secret_scan", mask_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# Suffix automata, bit counts over shingles and alignments have no SQL; the stages are tested one by one.
ORACLE_SQL = None

QUERIES = {**queries.QUERIES, "pipeline": run}
ORACLES = dict(queries.ORACLES)
