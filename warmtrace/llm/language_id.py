"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton: a state machine that knows every substring.
A text is cut into phrases, each the longest match from where the last one ended.  The language whose
automaton needs the fewest phrases, weighed by the bits that name a place in its text, wins.

Only letters count, in lower case, and a run of anything else is one space.  Texts are parsed in blocks
of ``BLOCK`` symbols, many blocks side by side: a phrase ends where its block does, in every language alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warmtrace.llm.common import freeing, held, own, slices

Samples = tuple[tuple[str, tuple[str, ...]], ...]

BLOCK = 256
# The bounds of what is learned: labelled rows and letters of a language.
SAMPLE_ROWS, SAMPLE_LETTERS = 800, 40_000
# So many symbols have a code of their own, the rarer ones two codes each.
SINGLE = 192
SNIPPET = 400
# More languages than this are refused, not dropped: each takes about 15 MB in a worker.
MOST_LANGUAGES = 60


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point: 1 a letter, 2 a mark that goes with one, else 0."""
    first = (unicodedata.category(chr(x))[0] for x in range(0x110000))
    return np.fromiter(({"L": 1, "M": 2}.get(k, 0) for k in first), np.uint8, 0x110000)


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, 0 for a run without letters; where each text begins; has it a letter."""
    kind = pa.large_string() if pa.types.is_large_string(texts.type) else pa.string()
    lower = pc.utf8_lower(pc.fill_null(texts, pa.scalar("", kind)))
    # A space after each text ends its last word.
    points = np.frombuffer("".join(t + " " for t in lower.to_pylist()).encode("utf-32-le", "replace"), "<u4")
    first = np.concatenate([[0], np.cumsum(pc.utf8_length(lower).to_numpy(zero_copy_only=False) + 1)])
    kinds = _kinds()[points]
    word = kinds > 0
    kept = word.copy()
    kept[1:] |= word[:-1]
    if len(first) > 1:
        kept[first[:-1]] |= word[first[:-1]]
        kept[first[1:-1]] &= word[first[1:-1]]
    letters = np.concatenate([[0], np.cumsum(kinds == 1)])
    place = np.concatenate([[0], np.cumsum(kept)])
    return np.where(word, points, 0)[kept], place[first], letters[first[1:]] > letters[first[:-1]]


class Alphabet:
    """Codes of all symbols of the samples: one for each frequent symbol, two in a row for each other; 0 for the rest."""

    def __init__(self, sample: list[np.ndarray], single: int = SINGLE):
        symbol, count = np.unique(np.concatenate([np.zeros(0, np.uint32), *sample]), return_counts=True)
        symbol = symbol[np.lexsort((symbol, -count))]
        rare = np.arange(max(0, len(symbol) - single))
        side = int(np.ceil(np.sqrt(len(rare))))
        self.first, self.second = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
        self.first[symbol[:single]] = np.arange(1, min(single, len(symbol)) + 1)
        if side:
            self.first[symbol[single:]] = single + 1 + rare // side
            self.second[symbol[single:]] = single + 1 + side + rare % side
        self.width = 1 + min(single, len(symbol)) + 2 * side
        self.double = side > 0

    def codes(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of the symbols, and where each text begins among them."""
        one = self.first[points]
        if not self.double:
            return one, first
        two = self.second[points]
        place = np.concatenate([[0], np.cumsum(1 + (two > 0))])
        out = np.zeros(place[-1], np.uint16)
        out[place[:-1]] = one
        out[place[1:][two > 0] - 1] = two[two > 0]
        return out, place[first]


class Automaton:
    """The suffix automaton of sequences of codes as tables; state 0 is the start, and code 0 matches nothing.

    A state with one arrow keeps it beside it, a state with more has a row of ``branch``; row 0 has no arrows.
    """

    def __init__(self, sample: list[np.ndarray], width: int):
        self.width = width
        self.length = max(2, sum(map(len, sample)))
        follow: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for snippet in sample:
            last = 0
            for code in snippet.tolist():
                last = self._extend(follow, link, size, last, code)
        self.only = np.zeros(len(follow), np.uint16)
        self.to, self.row = np.zeros(len(follow), np.int32), np.zeros(len(follow), np.int32)
        many = [state for state, arrows in enumerate(follow) if len(arrows) > 1 or not state]
        self.branch = np.full((len(many) + 1) * self.width, -1, np.int32)
        for n, state in enumerate(many, 1):
            self.row[state] = n
            for code, to in follow[state].items():
                self.branch[n * self.width + code] = to
        for state, arrows in enumerate(follow):
            if len(arrows) == 1:
                self.only[state], self.to[state] = next(iter(arrows.items()))

    @staticmethod
    def _extend(follow, link, size, last, code) -> int:
        def split(p: int, q: int) -> int:
            copy = len(follow)
            follow.append(dict(follow[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            link[q] = copy
            while p >= 0 and follow[p].get(code) == q:
                follow[p][code] = copy
                p = link[p]
            return copy

        if code in follow[last]:   # another snippet has it already
            q = follow[last][code]
            return q if size[q] == size[last] + 1 else split(last, q)
        state = len(follow)
        follow.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and code not in follow[p]:
            follow[p][code] = state
            p = link[p]
        if p >= 0:
            q = follow[p][code]
            link[state] = q if size[q] == size[p] + 1 else split(p, q)
        return state

    def phrases(self, codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many phrases each block takes; the blocks are ordered from long to short."""
        count, state = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int32)
        start = self.branch[self.width:2 * self.width]
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        for step, n in enumerate(active):
            code = codes[begins[:n] + step]
            now = state[:n]
            after = self.branch[self.row[now] * self.width + code]
            after = np.where((self.only[now] == code) & (code > 0), self.to[now], after)
            stuck = np.nonzero(after < 0)[0]
            count[stuck] += now[stuck] > 0
            again = start[code[stuck]]
            count[stuck] += again < 0
            after[stuck] = np.maximum(again, 0)
            state[:n] = after
        return count + (state > 0)


class Languages:
    """The automata of all languages, and the parse of many texts at once."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        points, first, _ = symbols(pa.array([t for n in self.names for t in samples[n]], pa.string()))
        self.alphabet = Alphabet([points])
        codes, first = self.alphabet.codes(points, first)
        parts = iter([codes[a:b] for a, b in zip(first, first[1:])])
        self.automata = [Automaton([next(parts) for _ in samples[n]], self.alphabet.width) for n in self.names]

    def parse(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits by text and language, symbols of each text, and whether it has a letter."""
        points, first, lettered = symbols(texts)
        codes, begin = self.alphabet.codes(points, first)
        size = np.diff(begin)
        blocks = -(-size // BLOCK)
        text = np.repeat(np.arange(len(size)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lengths = np.minimum(size[text] - nth * BLOCK, BLOCK)
        order = np.argsort(-lengths, kind="stable")
        begins, lengths, text = (begin[:-1][text] + nth * BLOCK)[order], lengths[order], text[order]
        bits = np.empty((len(size), len(self.names)))
        for n, automaton in enumerate(self.automata):
            found = automaton.phrases(codes, begins, lengths)
            bits[:, n] = np.bincount(text, found, len(size)) * np.log2(automaton.length)
        return bits, np.diff(first), lettered


def _languages(samples: Samples) -> Languages:
    """Built once in each worker: the samples are small, the automata are not.  Others go before these are built."""
    return held(("languages", samples), lambda: Languages({name: list(texts) for name, texts in samples}))


def learn(labelled: DataFrame, **options) -> Samples:
    """The samples of ``sample`` with nothing held out."""
    return sample(labelled, **options)[0]


def sample(labelled: DataFrame, *, label: str = "lang", text: str = "text", rows: int = SAMPLE_ROWS,
           letters: int = SAMPLE_LETTERS, held_out: int = 0) -> tuple[Samples, Samples]:
    """A sample of each language, at most ``rows`` rows and ``letters`` characters of each, and what is held out.

    The rows are chosen and ordered by hashes, all alike; each gives a stretch of ``SNIPPET`` characters at a
    hashed place, and equal stretches count once.  Rows with a null label, null or empty text are left out.
    Every tenth stretch is held out until there are ``held_out`` of a language.
    """
    h = F.xxhash64(F.lit(1), *labelled.columns)
    usable = labelled.select(F.col(label).cast("string").alias("label"), h.alias("h"), F.col(text).alias("text")).where(
        F.col("label").isNotNull() & (F.length("text") > 0))
    # Of a frequent label only rows with small hashes are ordered: about four times as many as are taken.
    often = (labelled.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).count()
             .limit(MOST_LANGUAGES + 1).collect())
    if len(often) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    if not often:
        return (), ()
    most = F.create_map(*[F.lit(x) for r in often for x in (r["label"], 4.0 * rows * (1 << 32) / r["count"])])
    near = usable.where(F.pmod("h", F.lit(1 << 32)) < F.element_at(most, F.col("label")))
    start = F.pmod("h", F.greatest(F.char_length("text") - SNIPPET, F.lit(1))) + 1
    cut = near.select("label", "h", F.substring(F.col("text"), start.cast("int"), F.lit(SNIPPET)).alias("text"))
    # Copies of a text have one hash; they are put together before they meet in a task.
    cut = cut.groupBy("label", "h").agg(F.min("text").alias("text"))
    ordered = cut.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))).where(F.col("n") <= rows)
    taken: dict[str, dict[str, bool]] = {}
    size: dict[str, int] = {}
    for row in ordered.orderBy("label", "n").select("label", "text").toLocalIterator():
        texts = taken.setdefault(row["label"], {})
        if size.get(row["label"], 0) < letters and row["text"] not in texts:
            apart = len(texts) % 10 == 9 and len(texts) < 10 * held_out
            texts[row["text"]] = apart
            size[row["label"]] = size.get(row["label"], 0) + (0 if apart else len(row["text"]))
    learned, held = (tuple((name, tuple(t for t, apart in texts.items() if apart == side)) for name, texts in sorted(taken.items()))
                     for side in (False, True))
    return learned, held


def usual_bits(spark: SparkSession, samples: Samples, held: Samples) -> dict[str, float]:
    """What text that is held out costs in its own language, in bits a symbol; languages without such text have none."""
    rows = [(name, text) for name, texts in held for text in texts]
    found = identify(spark.createDataFrame(rows, "label string, text string"), samples).where("label = lang_pred")
    return {r["label"]: r["bits"] for r in found.groupBy("label").agg(F.avg("bits_per_symbol").alias("bits")).collect()}


def identify(docs: DataFrame, samples: Samples, *, text_column: str = "text") -> DataFrame:
    """The columns of ``docs`` and lang_pred, score, bits_per_symbol.

    ``lang_pred`` is the language with the fewest weighed phrases over the whole text, of equal ones the
    first by name; ``und`` where the text is null or has no letter, or where nothing was learned.
    ``score`` is the share of that language when each weighs two to the minus of its bits, from
    1 / languages to 1; 0 for ``und``.  ``bits_per_symbol`` is its cost.  Rows, repeated ones too, stay
    as they are; columns of these three names are replaced; an empty table gives no rows.
    """
    made = ["lang_pred", "score", "bits_per_symbol"]
    kept = [c for c in docs.columns if c not in made]
    plain = docs.select(*kept, F.col(text_column).cast("string").alias(own(docs) + "read"))
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("bits_per_symbol", "double")
    names = sorted(n for n, _ in samples)

    def predict(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _languages(samples) if samples else None
        for batch in source:
            for some in slices(batch, batch.schema.names[-1]):
                yield _predicted(some, languages)

    def _predicted(some: pa.RecordBatch, languages: Languages | None) -> pa.RecordBatch:
        if languages is None:
            found = ["und"] * len(some), np.zeros(len(some)), np.zeros(len(some))
        else:
            bits, size, lettered = languages.parse(some.column(len(kept)))
            best = bits.argmin(1)
            least = bits.min(1)
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1)
            found = ([names[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, share, 0.0),
                     np.where(lettered, least / np.maximum(size, 1), 0.0))
        columns = [some[c] for c in kept] + [pa.array(found[0], pa.string()), pa.array(found[1]), pa.array(found[2])]
        return pa.RecordBatch.from_arrays(columns, names=kept + made)

    return plain.mapInArrow(freeing(predict), schema)
