"""Token ids of whole texts with a public tokenizer whose file is a parameter."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from warmtrace.llm.common import held

# A worker remembers the ids of at most twice this many different pieces of text, about 100 bytes each.
CACHED = 300_000
# Pieces whose normal form is their lower case: Latin-1 letters, one digit, or ASCII punctuation but the apostrophe.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
# Kinds of bytes: white space, letters, digits, punctuation, apostrophes, and all others, next to which nothing is cut.
SPACE, LETTER, DIGIT, MARK, APOSTROPHE, OTHER = range(6)


def _kinds() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[33:127] = MARK
    out[[32, *range(9, 14)]] = SPACE
    out[list(range(65, 91)) + list(range(97, 123))] = LETTER
    out[48:58] = DIGIT
    out[39] = APOSTROPHE
    return out


def _cuts() -> np.ndarray:
    """Whether a piece begins at a byte, by the kinds of the byte before and of this one."""
    out = np.zeros((8, 8), bool)
    out[SPACE, [LETTER, DIGIT, MARK, APOSTROPHE, OTHER]] = True
    # Every digit is a piece; marks and apostrophes are one, and an apostrophe may belong to the letters behind it.
    out[DIGIT, [LETTER, DIGIT, MARK, APOSTROPHE]] = out[[LETTER, MARK, APOSTROPHE], DIGIT] = True
    out[LETTER, [MARK, APOSTROPHE]] = out[MARK, LETTER] = True
    return out.ravel()


KINDS, CUTS = _kinds(), _cuts()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The pieces of many texts that the tokenizer's own rules surely keep apart.

    Gives for text ``i`` the codes ``codes[first[i]:first[i + 1]]``, and the different pieces as UTF-8 in the
    order of their codes.  A piece is letters, marks or a digit, or longer where other characters are in it.
    A-Z are in lower case unless a combining mark is there: some letters have composed forms in lower case only.
    A null text has no pieces.
    """
    large = pa.types.is_large_string(texts.type)
    texts = pc.fill_null(texts, pa.scalar("", pa.large_string() if large else pa.string()))
    _, offsets, values = texts.buffers()
    if not len(texts) or values is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_binary())
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds.astype(np.int64) - bounds[0]
    if not ((data == 0xCC) | (data == 0xCD)).any():
        data = LOWER[data]
    kinds = KINDS[data]
    # Two bytes, of which the first is C3: Latin-1 letters, but for two signs.
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    lead = lead[(after >> 6 == 2) & (after != 0x97) & (after != 0xB7)]
    kinds[lead] = kinds[lead + 1] = LETTER
    begins = np.empty(len(data), bool)
    begins[1:] = CUTS[kinds[:-1] << 3 | kinds[1:]]
    starts = bounds[:-1][bounds[:-1] < len(data)]
    begins[starts] = kinds[starts] != SPACE
    first = np.searchsorted(np.flatnonzero(begins), bounds)
    kept = kinds != SPACE
    data = data[kept]
    ends = np.append(np.flatnonzero(begins[kept]), len(data))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return first, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


class Remembered:
    """A bounded dictionary: when the young half is full, the half not used since the last time goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys) -> list:
        """The keys without a value; the others are surely in ``young`` afterwards."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    out.append(key)
        return out


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    For byte-level tokenizers that lower-case, split words, digits and punctuation from each other and
    drop white space before the merges: the ids of a text are then the ids of its ``pieces``, one after
    another.  Each piece is encoded once by the ``tokenizers`` library and remembered; strings of
    special tokens are ordinary text.
    """

    def __init__(self, path: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.known = Remembered(cached)
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null text has none, as an empty one."""
        first, codes, words = pieces(texts)
        words = words.to_numpy(zero_copy_only=False).tolist()
        self._learn(self.known.missing(words))
        raw = list(map(self.known.young.__getitem__, words))
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids, begins = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(size) - size
        sizes = size[codes]
        ends = np.cumsum(sizes)
        place = np.repeat(begins[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        flat, bounds = ids[place], np.concatenate([[0], ends])[first].tolist()
        for begin, end in zip(bounds, bounds[1:]):
            yield flat[begin:end]

    def _learn(self, new: list[bytes]) -> None:
        plain, ids, ends, rest = [], [], [0], []
        for piece in new:
            text = piece.decode("utf-8", "replace")
            if PLAIN.fullmatch(text):
                # The library's model alone takes a word in its normal form and byte letters.
                word = text.lower() if text.isascii() else text.lower().translate(self.letters)
                ids += [t.id for t in self.model.tokenize(word)]
                ends.append(4 * len(ids))
                plain.append(piece)
            else:
                rest.append((piece, text))
        raw = np.array(ids, "<u4").tobytes()
        self.known.young.update((piece, raw[begin:end]) for piece, begin, end in zip(plain, ends, ends[1:]))
        for begin in range(0, len(rest), 20_000):
            some = rest[begin:begin + 20_000]
            found = self.tokenizer.encode_batch_fast([text for _, text in some], add_special_tokens=False)
            self.known.young.update((piece, np.array(e.ids, "<u4").tobytes()) for (piece, _), e in zip(some, found))


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker and file: what it remembers serves later tasks too."""
    return held(("word_tokenizer", path), lambda: WordTokenizer(path))
