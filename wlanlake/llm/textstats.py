"""Figures of whole texts and of their lines, for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from wlanlake.llm.shingles import windows, words

WINDOW = 5


def _mask(characters: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[np.frombuffer(characters, np.uint8)] = True
    return mask


_SPACE = _mask(b"\x20\x09\x0a\x0b\x0c\x0d")
_CLASSES = {
    "symbols": _mask(b"#*$%&|<>"),
    "upper": _mask(bytes(range(65, 91))),
    "letters": _mask(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5))),
    "digits": _mask(b"0123456789"),
    "bangs": _mask(b"!"),
    "bars": _mask(b"|"),
    "stops": _mask(b".?!"),
    "points": np.arange(256) & 0xC0 != 0x80,
}


@dataclass
class Stats:
    """Of each text: figures named as its fields; of each line: ``lines``, with ``line_begin`` by text."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    distinct_words: np.ndarray
    twins: np.ndarray
    sums: dict[str, np.ndarray]
    lines: dict[str, np.ndarray]
    line_begin: np.ndarray


def covered(window_hashes: np.ndarray) -> np.ndarray:
    """Which words lie in a window that the text has twice or more, given its windows in order."""
    n = len(window_hashes)
    if n < 2:
        return np.zeros(n + WINDOW - 1 if n else 0, bool)
    _, inverse, counts = np.unique(window_hashes, return_inverse=True, return_counts=True)
    steps = np.zeros(n + WINDOW, np.int64)
    again = np.flatnonzero(counts[inverse] > 1)
    steps[again] += 1
    np.subtract.at(steps, again + WINDOW, 1)
    return np.cumsum(steps)[: n + WINDOW - 1] > 0


def text_stats(texts: list[bytes]) -> Stats:
    """Words are runs of bytes other than x20 and x09 to x0D; lines end with a line feed."""
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    hashes, begin = words(texts, lower=False)
    every = windows(hashes, WINDOW)
    inside = ~_SPACE[buffer]
    starts = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)) == 1)
    repeated = np.zeros(len(hashes), bool)
    distinct = np.zeros(len(texts), np.int64)
    dup_lines = np.zeros(len(texts), np.int64)
    dup_flags: list[bool] = []
    for k, text in enumerate(texts):
        s, e = begin[k], begin[k + 1]
        distinct[k] = len(np.unique(hashes[s:e]))
        if e - s > WINDOW:
            repeated[s:e] = covered(every[s : e - WINDOW + 1])
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            again = line in seen and bool(line.strip())
            seen.add(line)
            dup_flags.append(again)
            dup_lines[k] += again
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    text_begin = np.concatenate([[0], ends])
    feeds = np.concatenate([np.flatnonzero(buffer == 10), [len(buffer)]])
    line_start = np.concatenate([[0], feeds[:-1] + 1])
    twin = np.zeros(len(hashes), bool)
    twin[1:] = hashes[1:] == hashes[:-1]
    marks = {name: mask[buffer] for name, mask in _CLASSES.items()}
    marks["points"] = marks["points"] & inside
    so_far = {name: np.concatenate([[0], np.cumsum(m)]) for name, m in marks.items()}
    of_words = {name: np.concatenate([[0], np.cumsum(m)]) for name, m in (("twins", twin), ("repeated", repeated))}
    lower, upper = np.minimum(text_begin[:-1], len(buffer)), np.minimum(text_begin[1:], len(buffer))
    sums = {name: s[upper] - s[lower] for name, s in so_far.items()}
    first, last = np.searchsorted(starts, line_start), np.searchsorted(starts, feeds)
    lines = {name: s[feeds] - s[line_start] for name, s in so_far.items()}
    lines["words"] = last - first
    lines |= {name: s[last] - s[first] for name, s in of_words.items()}
    lines["dup"] = np.array(dup_flags, bool)
    final = np.where(feeds > line_start, buffer[np.maximum(feeds - 1, 0)] if len(buffer) else 0, 0)
    lines["closed"] = _CLASSES["stops"][final]
    return Stats(
        n_words=begin[1:] - begin[:-1],
        word_chars=sums["points"],
        n_symbols=sums["symbols"],
        n_dup_lines=dup_lines,
        n_repeat_words=of_words["repeated"][begin[1:]] - of_words["repeated"][begin[:-1]],
        distinct_words=distinct,
        twins=of_words["twins"][begin[1:]] - of_words["twins"][begin[:-1]],
        sums=sums,
        lines=lines,
        line_begin=np.searchsorted(line_start, text_begin),
    )


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)
