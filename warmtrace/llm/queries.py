"""The operators of this subpackage as queries over the given tables, and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warmtrace.llm import (collocations, conversation_trie, decontaminate, language_id, licenses, neighbours, packing, quality,
                           secret_scan, sentence_pieces, simhash, suffix_tree_lm, token_output)
from warmtrace.llm.common import materialise, remainder, table

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, words=3, seed=42)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))



def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "matched", "first_word", "words", F.sha2("passage", 256).alias("passage_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    samples = language_id.learn(docs.where(~held_out).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), samples)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_output.matrices(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path(TOKENIZER))
    return rows.select("sequence_id", "doc_ids", "starts", "cu_seqlens", "tokens", F.crc32("input_ids").alias("ids_crc32"),
                       F.crc32("position_ids").alias("positions_crc32"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    measured = materialise(quality.features(docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text")))
    trusted = (labels.where((remainder("doc_id", 5) != 0) & F.col("quality").isNotNull())
               .groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1"))
    model = quality.learn(measured.where("not held_out"), trusted)
    return quality.score(measured, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, neighbours=5)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 10) == 0
    model, counts = suffix_tree_lm.learn(docs.where(~held_out).select("text"))
    found = suffix_tree_lm.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, counts)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit(""), "source", "doc_id").alias("path"), "text")
    return licenses.scan(files).select("doc_id", "path", "license", "license_score", "found", "license_path", "line")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind_number"] < len(secret_scan.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, rule.kind))).cast("bigint").alias(f"n_{rule.kind}")
        for rule in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentence_pieces.encode(docs, model=public_tokenizers.path(PIECES), decoded=True)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation c with the first crc32(c) % 4 turns of conversation c - c % 20 in the place of its own."""
    base = F.col("conv_id").cast("bigint") - F.col("conv_id").cast("bigint") % 20
    found = conversation_trie.sequences(conversations.select("conv_id", "turn", "role", "text", base.alias("base")), "base")
    # At most twenty conversations have one base, and it is there once.
    begun = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 3)), True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    turns = F.concat(F.slice(F.coalesce("begun", F.array()), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return found.withColumn("begun", begun).select("conv_id", turns.alias("turns"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(rebuilt(table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, share=50, top=2000)


# crc32 of a number's digits, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))))"""

TRIE_SQL = f"""
    WITH own AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    headed AS (SELECT own.conv_id, own.turns, coalesce(base.turns, []) AS begun, {CRC32.replace('conv_id', 'own.conv_id')} % 4 AS h
        FROM own LEFT JOIN own AS base ON base.conv_id = own.conv_id - own.conv_id % 20),
    remade AS (SELECT conv_id, list_concat(begun[1:h], turns[h + 1:]) AS turns FROM headed),
    prefixes AS (SELECT conv_id, len(turns) = d AS ends, d, turns[1:d] AS path FROM remade, unnest(range(0, len(turns) + 1)) AS t(d)),
    nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
        (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d][2], '[^\x20\x09-\x0D]+')) END AS own_saved
        FROM prefixes GROUP BY path, d),
    children AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
    counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
    sums AS (SELECT path[1:up] AS path, sum(own_saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
        FROM counted, unnest(range(0, d + 1)) AS t(up) GROUP BY 1)
    SELECT c.conv_id, c.d AS depth, parent.conv_id AS parent_conv_id, c.n_convs, c.n_children, sums.n_leaves, sums.saved_tokens, c.ends_sha256
    FROM counted c JOIN sums USING (path) LEFT JOIN nodes parent ON c.d > 0 AND parent.path = c.path[1:c.d - 1]"""

COLLOCATIONS_SQL = """
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    listed AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
    words AS (SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed),
    runs AS (SELECT lang, w, w || ' ' || lead(w) OVER p AS two, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS three
        FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)),
    counted AS MATERIALIZED (SELECT lang, w AS phrase, 1 AS k, count(*) AS a FROM runs GROUP BY lang, w
        UNION ALL SELECT lang, two, 2, count(*) FROM runs WHERE two IS NOT NULL GROUP BY lang, two
        UNION ALL SELECT lang, three, 3, count(*) FROM runs WHERE three IS NOT NULL GROUP BY lang, three),
    totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
    several AS (SELECT *, string_split(phrase, ' ') AS words FROM counted WHERE k > 1 AND a >= 10),
    inner_ones AS (SELECT lang, unnest([words[1] || ' ' || words[2], words[2] || ' ' || words[3]]) AS phrase, a FROM several WHERE k = 3),
    longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ones GROUP BY ALL),
    kept AS (SELECT several.* FROM several LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * longer < 50 * a, true)),
    cuts AS (SELECT lang, phrase, a, 1 AS cut, words[1] AS left_part, array_to_string(words[2:], ' ') AS right_part FROM kept
        UNION ALL SELECT lang, phrase, a, 2, words[1] || ' ' || words[2], words[3] FROM kept WHERE k = 3),
    scored AS (SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
        FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.left_part JOIN counted y ON y.lang = c.lang AND y.phrase = c.right_part),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def _secrets_sql() -> str:
    """Lists of every rule's matches with what is skipped before them, and sums of their lengths."""
    steps, kinds = [], []
    for n, rule in enumerate(secret_scan.RULES):
        pattern = f"(?s).*?({rule.pattern})".replace("'", "''")
        steps.append(f"""SELECT doc_id, row_id, {n} AS kind_number, '{rule.kind}' AS kind, UNNEST(range(1, len(skipped) + 1)) AS i,
            skipped, found, tested FROM (SELECT doc_id, row_id, regexp_extract_all(text, '{pattern}', 0) AS skipped,
            regexp_extract_all(text, '{pattern}', 1) AS found, regexp_extract_all(text, '{pattern}', {1 + rule.group}) AS tested
            FROM texts)""")
        kinds.append(f"WHEN {n} THEN {rule.least}")
    return f"""
        WITH texts AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
        matches AS ({' UNION ALL '.join(steps)}),
        spans AS (SELECT row_id, kind_number, kind, ends - length(found[i]) AS start, ends FROM
            (SELECT *, list_sum(list_transform(skipped[1:i], lambda x: length(x))) AS ends FROM matches)
            WHERE length(tested[i]) >= CASE kind_number {' '.join(kinds)} END),
        listed AS (SELECT row_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || start || ':' || ends, ',' ORDER BY start, kind_number) AS spans,
            string_agg(kind || ':' || start || ':' || ends, ',' ORDER BY start, kind_number)
                FILTER (kind_number < {len(secret_scan.BASE)}) AS base
            FROM (SELECT row_id, kind_number, kind, start::BIGINT AS start, ends::BIGINT AS ends FROM spans) GROUP BY row_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM texts LEFT JOIN listed USING (row_id)"""


QUERIES = {"op1_packing": op1_packing, "op2_simhash": op2_simhash,
           "op3_decontamination": op3_decontamination, "op4_language": op4_language, "op5_token_output": op5_token_output,
           "op6_quality": op6_quality, "op7_neighbours": op7_neighbours,
           "op8_lm": op8_lm, "op9_licenses": op9_licenses,
           "op10_secrets": op10_secrets, "op11_sentence_pieces": op11_sentence_pieces,
           "op12_conversation_trie": op12_conversation_trie, "op13_collocations": op13_collocations}
ORACLES: dict[str, str] = {"op10_secrets": _secrets_sql(), "op12_conversation_trie": TRIE_SQL, "op13_collocations": COLLOCATIONS_SQL}
