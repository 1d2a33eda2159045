"""Word hashes, window hashes and window minima over whole batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_MASK = (1 << 64) - 1
#: Words whose hashes a task keeps at hand.
_KEPT_WORDS = 250_000
#: Words handled at a time; one longer text is handled alone.
CHUNK_WORDS = 200_000


class WordHashes(dict):
    """64-bit hash of each word, worked out once while it stays in the table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed permutation)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hash of any run of words from one pass over them: polynomial prefix sums modulo 2^64."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(base, n), out=self.prefix[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of words[start:end]; equal words at other places hash alike."""
        return mixed((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        n = len(self.prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.prefix[width:] - self.prefix[:n]) * self.inverse[:n] + np.uint64(width))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def binary(column: pa.Array) -> Iterator[bytes | None]:
    """The texts as UTF-8, one at a time."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py()


def chunks(texts: Iterable[bytes | None], split) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Neighbouring texts as word lists, about CHUNK_WORDS at a time, with the index of the first."""
    first, held, words = 0, [], 0
    for i, text in enumerate(texts):
        held.append(split(text))
        words += len(held[-1])
        if words >= CHUNK_WORDS:
            yield first, held
            first, held, words = i + 1, [], 0
    if held:
        yield first, held


def spaced(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.split() if text else []


def spaced_lower(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split() if text else []
