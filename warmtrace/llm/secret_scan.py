"""Secret scans through a trigram inverted index, with DataFrame functions only.

Every rule's regular expression gives a Boolean query of trigrams that its matches contain.  One pass
over the texts writes the postings of the trigrams that some query names; intersecting them gives the
candidate documents of each rule, and only those are searched with the expression itself.  Rules
without a mandatory trigram search every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmtrace.llm.common import own
from warmtrace.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches are the leftmost, not overlapping ones of ``pattern``; those whose ``group`` is shorter than ``least`` fail."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
# Published forms of credentials.
MORE = (
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "sk_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", "://[^\\s:@/]+:[^\\s:@/]+@"),
)
RULES = BASE + MORE
SPANS = "array<struct<start:int,kind_number:int,end:int,kind:string,text:string>>"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id: which of ``trigrams`` are in the lower-cased text of which documents."""
    there = F.array(*[F.when(F.contains("_lower", F.lit(t)), F.lit(t)) for t in trigrams])
    return (docs.select("doc_id", F.lower("text").alias("_lower"))
            .select("doc_id", F.explode(F.array_compact(there)).alias("trigram")))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """doc_id, kinds: for each document the rules whose trigram query it satisfies; None without such a rule.

    Rows of one id share their postings: that can only add candidates.
    """
    clauses = [(rule.kind, n, sorted(clause)) for rule in rules
               for n, clause in enumerate(sorted(trigram_query(rule.pattern), key=sorted)) if clause]
    if not clauses:
        return None
    # One row for each trigram of a clause: as many as the rules have, whatever the table.
    needed = docs.sparkSession.createDataFrame(
        [(t, kind, n, 1 << bit, (1 << len(c)) - 1) for kind, n, c in clauses for bit, t in enumerate(c)],
        "trigram string, kind string, clause int, bit bigint, whole bigint")
    found = postings(docs, sorted({t for _, _, c in clauses for t in c})).join(F.broadcast(needed), "trigram")
    met = found.groupBy("doc_id", "kind", "clause", "whole").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = whole").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _running(numbers: Column, whole: Column, step) -> Column:
    """The running total (by ``step``) of an array, by doubling: no loop over pairs of its entries."""
    doublings = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(whole, F.lit(1)))).cast("int")),
                            lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(doublings, numbers, lambda acc, d: F.transform(
        acc, lambda x, i: F.when(i >= d, step(x, F.get(acc, i - d))).otherwise(x)))


def _matches(rule: Rule, kind_number: int, p: str) -> tuple[Column, Column, Column]:
    """The searched pattern, where matches end, and the spans: running totals of matches with what is skipped before.

    ``\\G`` holds a match to the end of the one before: these are the leftmost matches, none overlapping.
    """
    pattern = F.lit(f"(?s)\\G.*?({rule.pattern})")
    ends = _running(F.col(p + "lengths"), F.size(p + "lengths"), lambda a, b: a + b)
    kept = F.filter(
        F.transform(F.col(p + "ends"), lambda end, i: F.struct(
            (end - F.char_length(F.get(p + "found", i))).alias("start"), F.lit(kind_number).alias("kind_number"),
            end.alias("end"), F.lit(rule.kind).alias("kind"), F.get(p + "found", i).alias("text"),
            F.char_length(F.get(p + "tested", i)).alias("tested"))),
        lambda s: s["tested"] >= rule.least)
    return pattern, ends, F.transform(kept, lambda s: s.dropFields("tested"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "spans") -> DataFrame:
    """The columns of ``docs`` and the column ``into``: all matches as (start, kind_number, end, kind, text), in that order.

    Positions count code points, ends are exclusive.  Null and empty texts have no spans; the text of a
    row is searched whole.  A null id is an id like any other, and rows of one id are searched each on
    its own.  An empty table gives no rows.  ``docs`` needs doc_id and text; a column named ``into``
    is replaced, no other is looked at.
    """
    found, p = candidates(docs, rules), own(docs)
    out = docs.drop(into)
    if found is None:
        out = out.withColumn(p + "kinds", F.array().cast("array<string>"))
    else:
        found = found.select(F.col("doc_id").alias(p + "candidate"), F.col("kinds").alias(p + "kinds"))
        out = out.join(found, F.col("doc_id").eqNullSafe(F.col(p + "candidate")), "left").drop(p + "candidate")
    spans = F.array().cast(SPANS)
    names = []
    for n, rule in enumerate(rules):
        pattern, ends, kept = _matches(rule, n, p)
        wanted = (F.array_contains(p + "kinds", rule.kind) if all(trigram_query(rule.pattern)) else F.lit(True))
        hit = F.coalesce(wanted, F.lit(False)) & F.rlike("text", F.lit(rule.pattern))
        names.append(f"{p}spans{n}")
        out = out.withColumn(p + "hit", hit).withColumns({
            p + "lengths": F.when(F.col(p + "hit"), F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.char_length)),
            p + "found": F.when(F.col(p + "hit"), F.regexp_extract_all("text", pattern, F.lit(1))),
            p + "tested": F.when(F.col(p + "hit"), F.regexp_extract_all("text", pattern, F.lit(1 + rule.group)))})
        out = out.withColumn(p + "ends", ends).withColumn(names[-1], F.coalesce(kept, spans)).drop(
            *[p + c for c in ("hit", "lengths", "found", "tested", "ends")])
    return out.withColumn(into, F.array_sort(F.concat(*names))).drop(p + "kinds", *names)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every stretch of overlapping spans replaced by ``mark``; all rows stay, null texts too."""
    spans, reached, parts, kept_ = (own(docs) + n for n in ("masked", "reach", "pieces", "kept"))
    found = scan(docs, rules, spans)
    reach = _running(F.transform(spans, lambda s: s["end"]), F.size(spans), F.greatest)
    pieces = F.transform(spans, lambda s, i: F.struct(
        s["start"].alias("start"), F.when(i == 0, 0).otherwise(F.get(reached, i - 1)).alias("before")))
    kept = F.transform(F.filter(parts, lambda p: p["start"] >= p["before"]), lambda p: F.concat(
        F.substring("text", p["before"] + 1, p["start"] - p["before"]), F.lit(mark)))
    rest = F.substring(F.col("text"), F.element_at(reached, -1) + 1, F.char_length("text"))
    text = F.when(F.size(spans) == 0, F.col("text")).otherwise(F.concat(F.array_join(kept_, ""), rest))
    return (found.withColumn(reached, reach).withColumn(parts, pieces).withColumn(kept_, kept)
            .withColumn("text", text).select(*docs.columns))
