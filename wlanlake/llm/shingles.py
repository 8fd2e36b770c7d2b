"""Words and word windows of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: odd numbers, fixed so that hashes agree between runs
_BASES = (0x9E6C63D0876A9A47, 0xB492B66FBE98F273)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, _U)
    if n:
        steps[0] = 1
    return np.multiply.accumulate(steps)


def words(texts: list[bytes], lower: bool = True, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and where each text's words begin (one more entry than texts).

    A word is a run of bytes that are not ``breaks``: white space (x20, x09 to x0D) unless others are given,
    which must hold the line feed. Its hash comes from differences of running polynomial sums over all
    bytes, to two bases, so there is no step for each word.
    """
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = ~breaks[buffer]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    letters = (_LOWER[buffer] if lower else buffer).astype(_U) + _U(1)
    got = mix((ends - starts).astype(_U))
    with np.errstate(over="ignore"):
        for base in _BASES:
            sums = np.concatenate([[_U(0)], np.cumsum(letters * _powers(base, len(letters)), dtype=_U)])
            back = _powers(pow(base, -1, 1 << 64), len(letters) + 1)
            got = mix(got + (sums[ends] - sums[starts]) * back[starts])
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return got, np.searchsorted(starts, begin)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window of ``length`` words at every place where one fits."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    got = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k in range(length):
            got = mix(got * _U(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return got


def in_parts(texts: list[bytes], most: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes together (or one longer text), with the first one's place."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def shingle_sets(texts: list[bytes], length: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's windows; a shorter text is one window, an empty one none."""
    for _, part in in_parts(texts):
        hashes, begin = words(part)
        every = windows(hashes, length)
        for s, e in zip(begin[:-1], begin[1:]):
            if e - s >= length:
                yield np.unique(every[s : e - length + 1])
            elif e > s:
                yield windows(hashes[s:e], int(e - s)) ^ _U(e - s)
            else:
                yield np.zeros(0, _U)
