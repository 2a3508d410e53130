"""A quality classifier from positive and unlabelled texts.

Trusted positives and a sample of unlabelled web text are compared; no negative label is read.  The
share of good text among the unlabelled, the class prior, is estimated where the positives' scores
are densest relative to the unlabelled ones.  The classifier then minimises the non-negative unbiased
risk: the positives' loss, and the unlabelled ones' loss as negatives less the part that the positives
among them make up, which is held at zero or above.

Features are counted over whole texts: shares of kinds of characters, words and lines, and how much of
a text repeats itself.  Each feature is cut at its quantiles, so the linear model can bend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from warmtrace.llm.common import factorised, hashed_sample, slices

# The bounds of what is learned from: rows of positives, and of unlabelled text.
SAMPLE_ROWS = 15_000
BINS = 16
_ASCII = {"letter": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t",
          "line": "\n", "stop": ".", "comma": ",", "bar": "|", "shout": "!?", "sign": "#$%&*+=<>@^_~/\\{}[]", "quote": "\"'`()-:;"}
NAMES = [f"share_{k}" for k in _ASCII] + [
    "share_other", "log_words", "word_length", "different_words", "most_frequent", "same_as_last", "repeats_2", "repeats_4",
    "short_words", "long_words", "signs_at_end", "one_sign_words", "line_words", "same_lines"]


def _character_shares(texts: pa.Array) -> np.ndarray:
    kinds = np.full(256, len(_ASCII), np.uint8)
    for k, characters in enumerate(_ASCII.values()):
        kinds[list(characters.encode())] = k
    raw = texts.cast(pa.large_binary()).to_pylist()
    flat = kinds[np.frombuffer(b"".join(raw), np.uint8)]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.repeat(np.arange(len(raw)), size)
    width = len(_ASCII) + 1
    counts = np.bincount(text * width + flat, minlength=len(raw) * width).reshape(-1, width)
    return counts / np.maximum(size, 1)[:, None]


def _different(text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of every different (text, key), and how often it occurs; fewer than 2^16 texts.

    Keys count by 47 mixed bits: one text would need millions of them for a likely clash.
    """
    mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)
    both = np.sort((text.astype(np.uint64) << np.uint64(47)) | mixed)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    return (both[first] >> np.uint64(47)).astype(np.int64), np.diff(np.append(first, len(both)))


def _repeated(text: np.ndarray, keys: np.ndarray, texts: int) -> np.ndarray:
    """How many entries of each text occur earlier in it."""
    return np.bincount(text, minlength=texts) - np.bincount(_different(text, keys)[0], minlength=texts)


def measure(texts: pa.Array) -> np.ndarray:
    """The features of each text, in the order of ``NAMES``; a null text is an empty one."""
    kind = pa.large_string() if pa.types.is_large_string(texts.type) else pa.string()
    texts = pc.fill_null(texts, pa.scalar("", kind))
    n = len(texts)
    first, codes, seen = factorised(texts)
    words = np.diff(first)
    text = np.repeat(np.arange(n), words)
    codes = codes.astype(np.int64)
    per = np.maximum(words, 1)
    length = pc.utf8_length(seen).to_numpy(zero_copy_only=False)
    sign_end = pc.match_substring_regex(seen, "[^\\pL\\pN.,;:'\")]$").to_numpy(zero_copy_only=False)
    bare = pc.match_substring_regex(seen, "^[^\\pL\\pN]+$").to_numpy(zero_copy_only=False)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(text, flag[codes], n) / per

    owner, times = _different(text, codes)
    different = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
    ngrams = []
    for size in (2, 4):
        count = max(0, len(codes) - size + 1)
        key = np.zeros(count, np.int64)
        for k in range(size):
            key = key * 1_000_003 + codes[k:k + count] + 1
        inside = text[:count] == text[size - 1:size - 1 + count]
        whole = np.maximum(words - size + 1, 1)
        ngrams.append(_repeated(text[:count][inside], key[inside], n) / whole)
    lines = pc.split_pattern(texts, "\n")
    line = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    same = _repeated(np.repeat(np.arange(n), count), line, n) / np.maximum(count, 1)
    return np.column_stack([
        _character_shares(texts), np.log1p(words), np.bincount(text, length[codes], n) / per, different / per, top / per,
        np.bincount(text, again, n) / per, *ngrams, share(length <= 2), share(length >= 14), share(sign_end), share(bare),
        np.log1p(words / np.maximum(count, 1)), same])


def features(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``features``: one row for each row."""
    kept = [c for c in docs.columns if c not in ("text", "features")]
    schema = docs.select(*kept).schema.add("features", ArrayType(FloatType()))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for some in slices(batch):
                found = measure(some["text"]).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * len(NAMES), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*[some[c] for c in kept], lists], names=[*kept, "features"])

    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


@dataclass
class Model:
    cuts: np.ndarray       # features x quantiles
    weights: np.ndarray    # one for each feature and bin, the last for all texts
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        """For each row the place of each feature's bin among the weights."""
        return np.stack([np.searchsorted(c, x[:, k], "right") + k * BINS for k, c in enumerate(self.cuts)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(1) + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def _fit(model: Model, good: np.ndarray, web: np.ndarray, risk, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> None:
    """Adam over all sampled rows; ``risk`` gives the derivatives by the margins of both samples."""
    places = model.bins(good), model.bins(web)
    size = len(model.weights)
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        margins = [model.weights[p].sum(1) + model.weights[-1] for p in places]
        slope = np.zeros(size)
        for p, d in zip(places, risk(*margins)):
            slope += np.bincount(p.ravel(), np.repeat(d, p.shape[1]), size)
            slope[-1] += d.sum()
        slope += decay * model.weights
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        model.weights -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def class_prior(good: np.ndarray, web: np.ndarray, slack: float = 0.05) -> float:
    """The share of positives among the unlabelled: the least ratio of both samples above a score.

    ``good`` and ``web`` are scores of a classifier that tells the samples apart.  Where no negative
    scores as high, the ratio of what lies above is the prior; ``slack`` holds off thin tails.  The
    sampling error is taken off: too high a prior calls bad text good.
    """
    cuts = np.unique(np.quantile(good, np.linspace(0, 0.9, 91)))
    above_good = np.array([(good >= c).mean() for c in cuts])
    above_web = np.array([(web >= c).mean() for c in cuts])
    error = np.sqrt(np.log(40) / 2 / max(1, len(web))) + np.sqrt(np.log(40) / 2 / max(1, len(good)))
    best = int(np.argmin((above_web + slack * error * 10) / above_good))
    return float(np.clip(above_web[best] / above_good[best] - np.sqrt(np.log(40) / 2 / max(1, len(web))), 0.01, 0.99))


def fit(good: np.ndarray, web: np.ndarray) -> Model:
    """The classifier of two samples of features: trusted positives, and unlabelled texts."""
    both = np.concatenate([good, web]) if len(good) + len(web) else np.zeros((1, len(NAMES)))
    cuts = np.stack([np.quantile(both[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(both.shape[1])])
    model = Model(cuts, np.zeros(cuts.shape[0] * BINS + 1), 0.5)
    if not len(good) or not len(web):
        return model

    def apart(g: np.ndarray, u: np.ndarray):
        return -_sigmoid(-g) / len(g), _sigmoid(u) / len(u)

    # Half of each sample tells the samples apart, the other half gives the prior.
    _fit(model, good[::2], web[::2], apart)
    rest = (good[1::2], web[1::2]) if len(good) > 1 and len(web) > 1 else (good, web)
    prior = class_prior(model.margin(rest[0]), model.margin(rest[1]))

    def risk(g: np.ndarray, u: np.ndarray):
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, g).mean()
        as_positive = -prior * _sigmoid(-g) / len(g)
        if negative >= 0:
            return as_positive - prior * _sigmoid(g) / len(g), _sigmoid(u) / len(u)
        # The estimate has gone below what a risk can be: step back from it.
        return prior * _sigmoid(g) / len(g), -_sigmoid(u) / len(u)

    model = Model(cuts, np.zeros(cuts.shape[0] * BINS + 1), prior)
    _fit(model, good, web, risk)
    return model


def learn(measured: DataFrame, positives: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` rows of each sample: those with the smallest hashes of their id.

    ``measured`` has doc_id and features of all rows to learn from, ``positives`` the doc_id of trusted ones.
    Rows of one id are taken or left together, but for the last ones.
    """
    def sample(df: DataFrame, seed: int) -> np.ndarray:
        picked = hashed_sample(df, rows, F.xxhash64(F.lit(seed), "doc_id")).select("features").collect()
        return np.array([r["features"] for r in picked], np.float32).reshape(-1, len(NAMES))

    named = measured.select("doc_id", "features").where("doc_id is not null")
    return fit(sample(named.join(positives.select("doc_id").distinct(), "doc_id", "left_semi"), 1), sample(named, 2))


def score(measured: DataFrame, model: Model) -> DataFrame:
    """The columns of ``measured`` but ``features``, and ``score``: how likely a text is good, 0 to 1.

    A null or empty text has features and a score like any other.  With nothing learned all scores are 0.5.
    Every row, repeated ones too, has a row; an empty table gives none.
    """
    kept = [c for c in measured.columns if c not in ("features", "score")]
    schema = measured.select(*kept).schema.add("score", DoubleType())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = batch["features"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(model.score(x))], names=[*kept, "score"])

    return measured.select(*kept, "features").mapInArrow(run, schema)
