"""Token ids by a public tokenizer, with the ids of words kept in memory between rows."""

from __future__ import annotations

import gc
import operator
import re

import numpy as np

# Unaccented and accented Latin letters that lower-case one to one and need no normalising, then punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes are themselves, others follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Encodes whole texts like ``Tokenizer.encode(text, add_special_tokens=False)``.

    For tokenizers that drop white space, lower-case, and then take each word by itself: the ids of a
    text are those of its words, so words that were seen need no new call. Words of plain letters are
    spelt in the vocabulary's letters and go to the model many at a time; the end mark of the last token
    of each tells them apart. Any other word goes through the whole tokenizer. Memory is bounded: the
    words are forgotten when there are ``most`` of them, and texts are taken a few megabytes at a time.
    """

    def __init__(self, path: str, most: int = 400_000, at_once: int = 2_000_000):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words_only = Tokenizer.from_file(path)
        self.words_only.normalizer = None
        self.words_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        mark = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
        self.letters = _byte_letters()
        self.most, self.at_once = most, at_once
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn_pieces(self, pieces: list[str], each: int = 200) -> None:
        spelt = [p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        lines = [" ".join(spelt[k : k + each]) for k in range(0, len(spelt), each)]
        if not lines:
            return
        got = self.words_only.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, "<u4") for x in got])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            raise ValueError("a word has no end mark: this tokenizer does not take words one by one")
        raw, stops = ids.tobytes(), (stops * 4).tolist()
        self.pieces.update(zip(pieces, [raw[i:j] for i, j in zip([0, *stops], stops)]))

    def _learn(self, words: list[bytes]) -> None:
        plain, heads, tails, other = [], [], [], []
        for w, text in zip(words, b"\n".join(words).decode("utf-8", "replace").split("\n")):
            found = _PLAIN.fullmatch(text)
            if found and "<|" not in text:
                plain.append(w)
                heads.append(found[1].lower())
                tails.append(found[2])
            else:
                other.append((w, text))
        parts = {*heads, *tails}
        # Looks the parts up one by one, where issubset would first copy all keys into a set.
        if parts.difference(self.pieces):
            if len(self.pieces) + len(parts) > self.most:
                self.pieces.clear()
            self.pieces[""] = b""
            self._learn_pieces(list(parts.difference(self.pieces)))
        known = self.pieces.__getitem__
        self.words.update(zip(plain, map(operator.add, map(known, heads), map(known, tails))))
        for w, text in other:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            self.words[w] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts, each as little-endian unsigned 32-bit integers."""
        watching = gc.isenabled()
        gc.disable()  # a million small strings, none in a cycle, would be walked again and again
        try:
            return self._encode(texts)
        finally:
            if watching:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= self.at_once):
                size += len(texts[end])
                end += 1
            split = [t.split() for t in texts[at:end]]
            every = set().union(*split)
            new = every.difference(self.words)
            if new:
                if len(self.words) + len(new) > self.most:
                    self.words.clear()
                    new = every
                self._learn(list(new))
            out += [b"".join(map(self.words.__getitem__, words)) for words in split]
            at = end
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, which outlives a task."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def texts_of(batch, column: str = "text") -> list[bytes]:
    """A text column of an Arrow batch as UTF-8; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
