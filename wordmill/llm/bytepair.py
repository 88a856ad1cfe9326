"""Byte-level BPE ids from the tokenizers library, each distinct word encoded once.

The library splits a text into words by a fixed pattern and encodes each word by
itself, so the ids of a text are the ids of its words in turn. The vocabulary's
added tokens (its end mark) are no words: as the library does by default, they are
found first, each is its one id, and the text between them is cut to words. Words are found
here by the same pattern: for plain Latin text in a form for which Python's own
engine has the same character classes, else by the pattern as published. The
library encodes the words that a worker hasn't met yet, many in one call. Of each
call of `encode`, one whole text is compared with the library's own ids of it; a
difference is an error, never a wrong row.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import filterfalse

import numpy as np

# Characters for which the plain form equals the published pattern.
_LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LATIN}]*")
_WORDS = re.compile(rf" ?[{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
_LARGEST = 250_000  # words a worker keeps, and as many from before that it falls back on


class Mismatch(AssertionError):
    """Ids joined from words differ from the library's ids of the whole text."""


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.widths = np.array([len(name) for name in names])  # bytes of each token: a character of its name is a byte
        self.published = regex.compile(public_tokenizers.PATTERN).findall
        added = self.tokenizer.get_added_tokens_decoder()
        odd = [t.content for t in added.values() if t.single_word or t.lstrip or t.rstrip or t.normalized]
        if odd:
            raise ValueError(f"added tokens that also take or need their neighbours: {odd}")
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.known: dict[str, bytes] = dict(self.added)  # no word contains an added token
        self.older: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        return _WORDS.findall(text) if _PLAIN.fullmatch(text) else self.published(text)

    def words(self, text: str) -> list[str]:
        """The words of a text and, between them, the added tokens that it holds."""
        if not any(mark in text for mark in self.added):
            return self._cut(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self._cut(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self._cut(text[at:])

    def _learn(self, fresh: list[str]) -> None:
        """Words of a space and letters follow each other in one call: the pattern
        parts them again, and the bytes of the tokens tell where. Others go one by one."""
        known, runs, rest = self.known, [], []
        for w in fresh:
            (runs if w[0] == " " and w[1:].isalpha() else rest).append(w)
        parts = [runs[k : k + 1000] for k in range(0, len(runs), 1000)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum([len(w.encode()) for w in part])
            at = (4 * (np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1)).tolist()
            data = ids.tobytes()
            known.update(zip(part, [data[a:b] for a, b in zip([0, *at], at, strict=False)], strict=True))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > _LARGEST:
            self.older, self.known = self.known, dict(self.added)
        cut, fresh = [self.words(t) for t in texts], set()
        has = self.known.__contains__
        for words in cut:
            fresh.update(filterfalse(has, words))
        if fresh:
            again = fresh & self.older.keys()
            self.known.update((w, self.older[w]) for w in again)
            self._learn(list(fresh - again))
        known = self.known.__getitem__
        out = [b"".join(map(known, c)) for c in cut]
        self._check(texts, out)
        return out

    def _check(self, texts: list[str], out: list[bytes]) -> None:
        """Of the texts of a call, the one in the middle is encoded whole."""
        if texts:
            k = len(texts) // 2
            if array("I", self.tokenizer.encode(texts[k], add_special_tokens=False).ids).tobytes() != out[k]:
                raise Mismatch(f"text {k} of the batch")

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        return np.array([len(x) // 4 for x in self.encode(texts)], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
