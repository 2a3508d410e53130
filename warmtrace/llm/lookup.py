"""64-bit hashes of words, and tables looked up by 64-bit hashes, for whole arrays at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHORT = 64   # bytes of words that are hashed side by side, eight bytes a step; longer ones are hashed one by one


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """An unsigned 64-bit hash of the bytes of each string or binary value; there are no nulls."""
    import xxhash

    if not len(words):
        return np.zeros(0, np.uint64)
    wide = pa.types.is_large_string(words.type) or pa.types.is_large_binary(words.type)
    _, borders, data = words.buffers()
    borders = np.frombuffer(borders, np.int64 if wide else np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    first, size = borders[:-1], np.diff(borders)
    raw = np.zeros(borders[-1] - borders[0] + 8, np.uint8)
    if data is not None:
        raw[:-8] = np.frombuffer(data, np.uint8)[borders[0]:borders[-1]]
    first = first - borders[0]
    # The eight bytes from every place on, the first one the lowest.
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    part = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = mixed(size.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    left = np.flatnonzero((size > 0) & (size <= SHORT))
    for at in range(0, SHORT, 8):
        if not len(left):
            break
        block = eight[first[left] + at] & part[np.minimum(size[left] - at, 8)]
        out[left] = mixed(out[left] * np.uint64(0x9E3779B97F4A7C15) + mixed(block + np.uint64(0x632BE59BD9B4E019)))
        left = left[size[left] > at + 8]
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[first[i]:first[i] + size[i]])
    return out


@dataclass
class Lookup:
    """Different 64-bit keys in order, with the first place of each class of leading bits: few steps find a key."""

    keys: np.ndarray
    starts: np.ndarray
    deep: int

    @classmethod
    def of(cls, keys: np.ndarray) -> "Lookup":
        """``keys`` are int64, ascending."""
        bits = max(1, len(keys).bit_length() - 1)
        starts = np.searchsorted(cls._leading(keys, bits), np.arange((1 << bits) + 1)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
        return cls(keys, starts, int(np.diff(starts).max(initial=0)))

    @staticmethod
    def _leading(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of ``wanted``, -1 where absent."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys) or not len(wanted):
            return out
        bits = (len(self.starts) - 1).bit_length() - 1
        at, left = self.starts[self._leading(wanted, bits)].astype(np.int64), np.arange(len(wanted))
        for _ in range(self.deep):
            here = self.keys[np.minimum(at, len(self.keys) - 1)]
            hit = here == wanted[left]
            out[left[hit]] = at[hit]
            on = here < wanted[left]
            left, at = left[on], at[on] + 1
            inside = at < len(self.keys)
            left, at = left[inside], at[inside]
        return out


@dataclass
class Words:
    """Numbers of known words: their places in ``words``, which has no word twice."""

    words: pa.Array
    hashes: Lookup
    order: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> "Words":
        """Of two words with the same hash the later one is found by no hash, and so is unknown."""
        array = pa.array(words, pa.large_binary())
        keys, order = np.unique(word_hashes(array).view(np.int64), return_index=True)
        return cls(array, Lookup.of(keys), order)

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, -1 for unknown ones, and the hashes of all."""
        hashes = word_hashes(words)
        at = self.hashes.find(hashes.view(np.int64))
        number = np.where(at >= 0, self.order[np.maximum(at, 0)], -1) if len(self.order) else at
        met = np.flatnonzero(number >= 0)
        if len(met):
            same = pc.equal(pc.take(words, pa.array(met)).cast(pa.large_binary()), pc.take(self.words, pa.array(number[met])))
            number[met[~same.to_numpy(zero_copy_only=False)]] = -1
        return number, hashes
