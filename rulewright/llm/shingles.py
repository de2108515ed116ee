"""Word shingles of UTF-8 text as sets of 64-bit hashes, vectorised over many documents.

A word is a run of bytes other than space and tab to carriage return, after
lower-casing A-Z. A document's set holds its distinct runs of ``width`` words;
a document with fewer words has the whole sequence as its one shingle; without
words the set is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on at a time; the arrays of a chunk take some 200 times as many.
CHUNK_BYTES = 1 << 17

_U = np.uint64
#: Words are polynomials of their bytes at two bases, modulo a prime: modulo a power of two, words that differ can be alike at every base.
_PRIME = (1 << 31) - 1
_BASES = (1_283_542_109, 777_918_253)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed)) | _U(1)


def _byte_values() -> np.ndarray:
    """A value from 1 to the prime less 1 for each byte and base; A-Z count as a-z."""
    values = (constants(512, 7) % _U(_PRIME - 1)).astype(np.int64).reshape(2, 256) + 1
    lower = np.arange(256)
    lower[65:91] += 32
    return values[:, lower]


_VALUE = _byte_values()


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainder by the Mersenne prime of numbers from 0 to below 2^62, by shifts."""
    x = (x & _PRIME) + (x >> 31)
    return x - np.where(x >= _PRIME, _PRIME, 0)


class _Powers:
    """Powers of the bases and of their inverses, grown on demand."""

    held: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, base: int, n: int) -> np.ndarray:
        powers = cls.held.get(base)
        while powers is None or len(powers) < n:
            powers = np.ones(1, np.int64) if powers is None else np.concatenate((powers, _mod(powers * pow(base, len(powers), _PRIME))))
            cls.held[base] = powers
        return powers[:n]


def word_bounds(data: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a buffer."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = separators[data]
    marks = np.flatnonzero(blank[1:] != blank[:-1])
    return marks[0::2], marks[1::2]


def span_hashes(data: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Hashes of byte spans of one buffer; equal bytes give equal hashes wherever they lie."""
    out = [np.zeros(len(start), np.int64) for start, _ in spans]
    for base, value in zip(_BASES, _VALUE, strict=True):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_mod(value[data] * _Powers.of(base, len(data))), out=total[1:])  # below 2^62 up to 2^31 bytes
        down = _Powers.of(pow(base, -1, _PRIME), len(data) + 1)
        for i, (start, end) in enumerate(spans):
            out[i] = out[i] << 31 | _mod(_mod(total[end] - total[start]) * down[start])
    return [mix(x.astype(_U)) for x in out]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a buffer."""
    start, end = word_bounds(data)
    return start, span_hashes(data, [(start, end)])[0]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first index, offsets, values) by chunks of documents.

    ``values[offsets[i]:offsets[i + 1]]`` are the sorted distinct shingle
    hashes of document ``first + i``.
    """
    k = constants(width + 1, 11)
    for first, last in _chunks(texts):
        part = texts[first:last]
        n = len(part)
        data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        lengths = np.fromiter(map(len, part), np.int64, n) + 1
        begins = np.concatenate(([0], np.cumsum(lengths)))
        start, word = _words(data)
        at = np.searchsorted(start, begins)
        count = np.diff(at)
        made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        offsets = np.concatenate(([0], np.cumsum(made)))
        out = np.zeros(offsets[-1], _U)
        full = np.flatnonzero(count >= width)
        if len(full):
            reps = made[full]
            where = np.repeat(at[full], reps) + _ramp(reps)
            acc = word[where] * k[0]
            for j in range(1, width):
                acc += word[where + j] * k[j]
            out[np.repeat(offsets[full], reps) + _ramp(reps)] = mix(acc)
        for i in np.flatnonzero((count > 0) & (count < width)):
            w = np.append(word[at[i] : at[i + 1]], _U(count[i]))
            out[offsets[i]] = mix((w * np.append(k[: count[i]], k[width])).sum(keepdims=True))[0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a > 1:
                out[a:b].sort()
        fresh = np.ones(len(out), bool)
        if len(out):
            fresh[1:] = out[1:] != out[:-1]
            fresh[offsets[:-1][made > 0]] = True
        kept = np.concatenate(([0], np.cumsum(fresh)))
        yield first, kept[offsets], out[fresh]


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. count - 1 for each count, joined."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
