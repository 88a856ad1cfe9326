"""Tokenizers.

Each tokenizer is a scanner: from a text to (term, start, end, position) in
characters. Scanners run in Arrow batches and give byte offsets. Those that are
one pattern also have a native form, used where offsets aren't asked for: the
terms come from one regular expression in the JVM, offsets are null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tokens import TOKENS, token
from .registry import tokenizer

Found = tuple[str, int, int, int]
Scanner = Callable[[str], list[Found]]
WORD = r"\p{IsAlphabetic}\p{N}"  # letters and numbers, in Java's and the regex module's names


@dataclass(frozen=True)
class Tokenizer:
    scan: Scanner
    native: Callable[[Column], Column] | None = None  # text -> array of terms

    def __call__(self, text: Column, offsets: bool = True) -> Column:
        if self.native is not None and not offsets:
            nothing = F.lit(None).cast("int")
            return F.when(text.isNotNull(), F.transform(self.native(text), lambda t, i: token(t, nothing, nothing, i)))
        return _scanned(self.scan)(text)


def _byte_starts(text: str) -> np.ndarray | None:
    if text.isascii():
        return None
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))])


#: Tokens that a worker holds before it hands them on. Those of one text stay together.
HELD = 50_000


class Held:
    """Texts' tokens as flat columns, no object for each token, until they are handed on as one Arrow array."""

    def __init__(self):
        self.lengths: list[int | None] = []
        self.terms: list[str] = []
        self.numbers: list[np.ndarray] = []  # of each text: starts, ends and positions

    def add(self, text: str | None, scan: Scanner) -> None:
        found = None if text is None else scan(text)
        self.lengths.append(None if found is None else len(found))
        if found:
            terms, *numbers = zip(*found, strict=True)
            self.terms += terms
            self.numbers.append(made := np.array(numbers, np.int32))
            if (at := _byte_starts(text)) is not None:
                made[:2] = at[made[:2]]

    def array(self) -> pa.Array:
        numbers = np.concatenate(self.numbers, axis=1) if self.numbers else np.zeros((3, 0), np.int32)
        parts = [pa.array(self.terms, pa.string()), *map(pa.array, numbers)]
        ends = np.cumsum([0, *(n or 0 for n in self.lengths)]).astype(np.int32)
        gone = pa.array([n is None for n in self.lengths])
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["term", "start_offset", "end_offset", "position"]), mask=gone)


def _scanned(scan: Scanner):
    @F.arrow_udf(TOKENS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            held = Held()
            for text in texts:
                held.add(text.as_py(), scan)
                if len(held.terms) >= HELD:
                    yield held.array()
                    held = Held()
            if held.lengths:
                yield held.array()

    return run


def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace("IsAlphabetic", "Alphabetic").replace("IsLowercase", "Lowercase").replace("IsUppercase", "Uppercase"), regex.V1)


def by_pattern(pattern: str, change: Callable[[str], str] = lambda t: t, native_change: Callable[[Column], Column] | None = None, max_bytes: int | None = None) -> Tokenizer:
    """Every match that isn't empty is a token."""
    made = _pattern(pattern)

    def scan(text: str) -> list[Found]:
        spans = [(m.start(), m.end()) for m in made.finditer(text) if m.end() > m.start()]
        if max_bytes:
            spans = [(a, b) for a, b in spans if len(text[a:b].encode()) <= max_bytes]
        return [(change(text[a:b]), a, b, k) for k, (a, b) in enumerate(spans)]

    def native(text: Column) -> Column:
        terms = F.filter(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda t: (t != "") if max_bytes is None else (t != "") & (F.octet_length(t) <= max_bytes))
        return F.transform(terms, native_change) if native_change else terms

    return Tokenizer(scan, native)


def words(text: str) -> list[tuple[int, int]]:
    """White-space words as spans."""
    return [m.span() for m in regex.finditer(r"\S+", text)]


def spread(spans: list[list[tuple[int, int]]], text: str, same: bool) -> list[Found]:
    """Groups of spans: all of a group at one position, or each at its own."""
    out: list[Found] = []
    position = 0
    for group in spans:
        for a, b in group:
            out.append((text[a:b], a, b, position))
            position += not same
        position += same
    return out


# One pattern.

CJK_SINGLE = r"[\p{IsHan}\p{IsHiragana}]"
STANDARD = rf"(?!{CJK_SINGLE})[\p{{L}}\p{{M}}\p{{N}}_](?:(?!{CJK_SINGLE})[\p{{L}}\p{{M}}\p{{N}}_]|(?<=\p{{L}})['’.:·](?=\p{{L}})|(?<=\p{{N}})[.,;'](?=\p{{N}}))*"


@tokenizer()
def standard(cjk_runs: bool = False) -> Tokenizer:
    """Words: letters, marks, numbers and _, joined by an apostrophe, period or colon
    between letters and by a period or comma between numbers. Ideographs and
    hiragana stand alone, or with cjk_runs in runs."""
    return by_pattern(f"{CJK_SINGLE}{'+' if cjk_runs else ''}|{STANDARD}")


@tokenizer()
def whitespace() -> Tokenizer:
    return Tokenizer(lambda text: [(text[a:b], a, b, k) for k, (a, b) in enumerate(words(text))], lambda c: F.regexp_extract_all(c, F.lit(r"(?U)(\S+)"), F.lit(1)))


@tokenizer()
def letter() -> Tokenizer:
    return by_pattern(r"\p{IsAlphabetic}+")


@tokenizer()
def lowercase() -> Tokenizer:
    return by_pattern(r"\p{IsAlphabetic}+", str.lower, F.lower)


@tokenizer()
def keyword() -> Tokenizer:
    return Tokenizer(lambda text: [(text, 0, len(text), 0)], lambda c: F.array(c))


@tokenizer()
def simple_pattern(pattern: str = r"[\p{L}\p{N}_]+") -> Tokenizer:
    return by_pattern(pattern)


def _splits(pattern: str) -> Tokenizer:
    made = _pattern(pattern)

    def scan(text: str) -> list[Found]:
        ends = [(m.start(), m.end()) for m in made.finditer(text)]
        gaps = zip([0, *(b for _, b in ends)], [*(a for a, _ in ends), len(text)], strict=True)
        return [(text[a:b], a, b, k) for k, (a, b) in enumerate((a, b) for a, b in gaps if b > a)]

    return Tokenizer(scan, lambda c: F.filter(F.split(c, pattern, -1), lambda t: t != ""))


@tokenizer()
def simple_pattern_split(pattern: str = r"[\s\p{Z}]+") -> Tokenizer:
    return _splits(pattern)


@tokenizer()
def pattern(pattern: str = r"[^\p{L}\p{M}\p{N}_]+", group: int = -1) -> Tokenizer:
    """Text between matches (group -1), or a group of every match, empty ones too."""
    if group < 0:
        return _splits(pattern)
    made = _pattern(pattern)
    scan = lambda text: [(m[group], m.start(group), m.end(group), k) for k, m in enumerate(m for m in made.finditer(text) if m[group] is not None)]
    return Tokenizer(scan, lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))


#: Punctuation beyond ASCII.
PUNCTUATION = r"!-/:-@\[-`{-~\x{A1}\x{A7}\x{B6}\x{BF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{2E00}-\x{2E7F}\x{3000}-\x{303F}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}"


def _java_only(p: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), p)


PUNCTUATION = _java_only(PUNCTUATION)
@tokenizer()
def char_group(chars: str = "", classes: tuple[str, ...] = ("whitespace",)) -> Tokenizer:
    """Text between characters of a set or of classes: whitespace, letter, digit, punctuation, symbol."""
    parts = {"whitespace": r"\s\p{Z}", "letter": r"\p{IsAlphabetic}", "digit": r"\p{N}", "punctuation": PUNCTUATION}
    sets = re.sub(r"([\\\]\[^&~|-])", r"\\\1", chars) + "".join(parts[c] for c in classes if c != "symbol")
    options = ([f"[{sets}]"] if sets else []) + ([rf"[^{WORD}\s\p{{Z}}]"] if "symbol" in classes else [])
    both = "|".join(options)
    return _splits(f"(?:{both})+" if both else r"(?!)")


EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
ANY_URL = r"(?i:https?|ftp|file)://[^\s<>\[\]{}|\\^`\x00-\x1f\x7f]+"


@tokenizer()
def classic(max_token_length: int = 255) -> Tokenizer:
    """Letters, numbers and _, joined by . ' ’ @ before a letter, - before either, and . or , between digits."""
    core = rf"[{WORD}_](?:[{WORD}_]|[.'’@](?=\p{{IsAlphabetic}})|-(?=[{WORD}])|(?<=[0-9])[.,](?=[0-9]))*"
    return by_pattern(core, max_bytes=max_token_length)


@tokenizer()
def uax_url_email(max_token_length: int = 255) -> Tokenizer:
    return by_pattern(f"{ANY_URL}|{EMAIL}|[{WORD}]+", max_bytes=max_token_length)


@tokenizer()
def thai() -> Tokenizer:
    """Thai runs and other runs of letters and numbers."""
    return by_pattern(rf"[\u0E00-\u0E7F]+|(?:(?![\u0E00-\u0E7F])[{WORD}])+")


#: Ideographs that stand alone.
IDEOGRAPHS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0xF900, 0xFAFF)))


@tokenizer()
def chinese_char() -> Tokenizer:
    return by_pattern(rf"[{IDEOGRAPHS}]|(?:(?![{IDEOGRAPHS}])[{WORD}])+")


MYANMAR = "\u1000-\u109f\uaa60-\uaa7f"


@tokenizer()
def burmese() -> Tokenizer:
    """Myanmar syllables: a consonant starts one unless a virama or asat stands before it; other text by white space and punctuation."""
    rest = rf"(?![{MYANMAR}])[^\s\p{{Z}}!-/:-@\[-`{{-~\u104a-\u104f]"
    syllable = rf"(?![\u104a-\u104f])[{MYANMAR}](?:(?![\u104a-\u104f])(?:(?<=[\u1039\u103a])[\u1000-\u1021]|(?![\u1000-\u1021])[{MYANMAR}]))*"
    return by_pattern(f"{syllable}|(?:{rest})+")


@tokenizer()
def wildcard(lowercase: bool = False) -> Tokenizer:
    made = rf"[{WORD}*?_]+"
    return by_pattern(made, str.lower, F.lower) if lowercase else by_pattern(made)


@tokenizer()
def punctuation(preserve_numbers: bool = True) -> Tokenizer:
    whole = r"(?<![0-9.,])\d{1,}(?:,\d{3}(?!\d))+(?:\.\d+)?(?![.,]?\d)|(?<![0-9.,])[0-9]+\.[0-9]+(?![.,]?[0-9])|"
    return by_pattern((whole if preserve_numbers else "") + f"[{WORD}]+")


EMOJI_START = "".join(
    f"{chr(a)}-{chr(b)}"
    for a, b in ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x2600, 0x27BF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FAFF), (0x231A, 0x231B), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x2B05, 0x2B07), (0x2B1B, 0x2B1C))
) + "\u2b50\u2b55"  # fixed values: code points that begin an emoji
EMOJI_MORE = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x25AA, 0x25AB), (0x25FB, 0x25FE), (0x2934, 0x2935), (0xFE00, 0xFE0F))) + "\u25b6\u25c0\u3030\u303d\u3297\u3299\u200d"
EMOJI_NEXT = "\u20e3" + chr(0x1F3FB) + "-" + chr(0x1F3FF) + chr(0xE0020) + "-" + chr(0xE007F)


@tokenizer()
def emoji(include_text: bool = True) -> Tokenizer:
    text = rf"|[{WORD}][{WORD}']*" if include_text else ""
    return by_pattern(f"[{EMOJI_START}{EMOJI_MORE}][{EMOJI_START}{EMOJI_MORE}{EMOJI_NEXT}]*{text}")


#: Ranges that form one script.
SCRIPT_RUNS = ["A-Za-zÀ-ɏḀ-ỿ", "0-9", "Ѐ-ԯ", "Ͱ-Ͽ", "\u0600-\u06ff\u0750-\u077f", "\u0590-\u05ff", "\u0900-\u097f", "\u4e00-\u9fff\u3400-\u4dbf", "\u3040-\u309f", "\u30a0-\u30ff", "\uac00-\ud7af", "\u0e00-\u0e7f"]


@tokenizer()
def script_boundary(split_cjk: bool = False, merge_numbers: bool = False) -> Tokenizer:
    listed = "".join(SCRIPT_RUNS)
    other = rf"(?:(?![{listed}])\p{{IsAlphabetic}})"
    digits = "0-9" if merge_numbers else ""
    runs = [f"[{r}]" if split_cjk and r.startswith("\u4e00") else f"[{digits}]*[{r}][{r}{digits}]*" if digits else f"[{r}]+" for r in SCRIPT_RUNS]
    return by_pattern("|".join([*runs, f"{other}+"]))


@tokenizer()
def microblog(strip_prefixes: bool = False) -> Tokenizer:
    made = _pattern(
        rf"(?:https?://|www\.)\S*|(?P<mark>[@][{WORD}_.]+|[#][{WORD}_]+)|[{EMOJI_START}](?:\u200d.?|[\ufe0f\ufe0e\U0001F3FB-\U0001F3FF])*|(?P<word>[{WORD}'][{WORD}'-]*)"
    )

    def scan(text: str) -> list[Found]:
        spans = []
        for m in made.finditer(text):
            a, b = m.span()
            if m["word"]:
                b -= len(m["word"]) - len(m["word"].rstrip("'-"))
            spans.append((a + bool(m["mark"] and strip_prefixes), b))
        return [(text[a:b], a, b, k) for k, (a, b) in enumerate((a, b) for a, b in spans if b > a)]

    return Tokenizer(scan)


# White-space words and their parts.

Parts = Callable[[str], list[tuple[int, int]]]


def _by_word(parts: Parts, same: bool) -> Tokenizer:
    """parts: spans within a word."""

    def scan(text: str) -> list[Found]:
        out: list[Found] = []
        position = 0
        for a, b in words(text):
            for x, y in parts(text[a:b]):
                out.append((text[a + x : a + y], a + x, a + y, position))
                position += not same
            position += same
        return out

    return Tokenizer(scan)


IDENTIFIER_PARTS = _pattern(r"\p{IsUppercase}+(?!\p{IsLowercase})|\p{IsUppercase}?[\p{IsLowercase}]+|[0-9]+|[^\p{IsUppercase}\p{IsLowercase}0-9_]+|\p{IsUppercase}")


@tokenizer()
def camel_case(preserve_original: bool = False) -> Tokenizer:
    def parts(word: str) -> list[tuple[int, int]]:
        if word.isascii() and word.isalpha() and word[1:].islower():  # one part
            return [(0, len(word))]
        found = [m.span() for m in IDENTIFIER_PARTS.finditer(word)]
        return [(0, len(word))] if len(found) <= 1 else found

    if not preserve_original:
        return _by_word(parts, same=False)

    def scan(text: str) -> list[Found]:
        out: list[Found] = []
        position = 0
        for a, b in words(text):
            found = parts(text[a:b])
            if len(found) > 1:
                out.append((text[a:b], a, b, position))
            for x, y in found:
                out.append((text[a + x : a + y], a + x, a + y, position))
                position += 1
        return out

    return Tokenizer(scan)


@tokenizer()
def structured_id(preserve_original: bool = True, delimiters: str = "-_.:") -> Tokenizer:
    split = re.compile(f"[^{re.escape(delimiters)}]+")

    def scan(text: str) -> list[Found]:
        out: list[Found] = []
        position = 0
        for a, b in words(text):
            word = text[a:b]
            found = [m.span() for m in split.finditer(word)]
            if found == [(0, len(word))]:
                out.append((word, a, b, position))
                position += 1
                continue
            if preserve_original:
                out.append((word, a, b, position))
            for x, y in found:
                out.append((word[x:y], a + x, a + y, position))
                position += 1
        return out

    return Tokenizer(scan)


@tokenizer()
def elision(articles: str = "l m t qu n s j d c jusqu quoiqu lorsqu puisqu") -> Tokenizer:
    from .folding import ELISIONS

    known = set(ELISIONS.get(articles, articles).split())

    def parts(word: str) -> list[tuple[int, int]]:
        m = re.match("([^'’]*)['’]", word)
        start = m.end() if m and m[1].lower() in known else 0
        return [(start, len(word))] if start < len(word) else []

    return Tokenizer(lambda text: [(text[a:b], a, b, k) for k, (a, b) in enumerate((a + x, a + y) for a, b in words(text) for x, y in parts(text[a:b]))])


@tokenizer()
def reverse() -> Tokenizer:
    return Tokenizer(
        lambda text: [(text[a:b][::-1], a, b, k) for k, (a, b) in enumerate(words(text))], lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(?U)(\S+)"), F.lit(1)), F.reverse)
    )


@tokenizer()
def truncate(max_length: int = 256, preserve_original: bool = False) -> Tokenizer:
    """Words cut to so many bytes, at a character."""

    def scan(text: str) -> list[Found]:
        out: list[Found] = []
        for k, (a, b) in enumerate(words(text)):
            raw = text[a:b].encode()
            if len(raw) > max_length and preserve_original:
                out.append((text[a:b], a, b, k))
            term = raw[:max_length].decode(errors="ignore")
            out.append((term, a, a + len(term), k))
        return out

    return Tokenizer(scan)


@tokenizer()
def sliding_window(min_size: int = 3, max_size: int = 5, preserve_original: bool = True, max_tokens: int = 10_000) -> Tokenizer:
    def parts(word: str) -> list[tuple[int, int]]:
        n = len(word)
        return ([(0, n)] if preserve_original else []) + [(a, a + k) for k in range(min_size, min(max_size, n) + 1) for a in range(n - k + 1)]

    inner = _by_word(parts, same=True)
    return Tokenizer(lambda text: inner.scan(text)[:max_tokens])


@tokenizer()
def compound_word(dictionary: tuple[str, ...] = (), min_sub: int = 3, max_sub: int = 20, min_word: int = 5) -> Tokenizer:
    """A word, and its dictionary words, longest first from the left, when there are two or more."""
    known = {w.lower() for w in dictionary}
    usual = sorted({len(w) for w in known if min_sub <= len(w) <= max_sub}, reverse=True)

    def parts(word: str) -> list[tuple[int, int]]:
        found, at, n = [], 0, len(word)
        sizes = range(max_sub, min_sub - 1, -1) if "İ" in word else usual  # no other character has a lower case of another length
        while sizes and n >= min_word and at < n:
            end = next((at + k for k in sizes if at + k <= n and word[at : at + k].lower() in known), 0)
            if end:
                found.append((at, end))
            at = end or at + 1
        return [(0, len(word)), *(found if len(found) >= 2 else [])]

    return _by_word(parts, same=True)


@tokenizer()
def hyphenated(preserve_original: bool = True, min_part_length: int = 1) -> Tokenizer:
    made = _pattern(rf"[{WORD}-][{WORD}'-]*")

    def scan(text: str) -> list[Found]:
        groups = []
        for m in made.finditer(text):
            word = m[0].strip("-") if m[0].startswith("-") or m[0].endswith("-") else m[0]
            a = m.start() + len(m[0]) - len(m[0].lstrip("-"))
            if not word:
                continue
            if "-" not in word:
                groups.append([(a, a + len(word))])
                continue
            group, at = [(a, a + len(word))] if preserve_original else [], a
            for part in word.split("-"):
                if len(part) >= min_part_length:
                    group.append((at, at + len(part)))
                at += len(part) + 1
            groups.append(group)
        return spread(groups, text, same=True)

    return Tokenizer(scan)


# Whole texts and their parts.


@tokenizer()
def edge_ngram(min_gram: int = 1, max_gram: int = 2) -> Tokenizer:
    def scan(text: str) -> list[Found]:
        return [(text[:n], 0, n, n - min_gram) for n in range(min_gram, min(max_gram, len(text)) + 1)]

    return Tokenizer(scan, lambda c: F.when(F.length(c) < min_gram, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(min_gram), F.least(F.lit(max_gram), F.length(c))), lambda n: F.left(c, n))))


@tokenizer()
def ngram(min_gram: int = 1, max_gram: int = 2, token_chars: tuple[str, ...] = ()) -> Tokenizer:
    """Character n-grams, all of one size first; with token_chars, of the runs of those classes."""
    kinds = {"letter": r"\p{IsAlphabetic}", "digit": r"\p{N}", "whitespace": r"\s\p{Z}", "punctuation": PUNCTUATION, "symbol": r"\p{S}"}
    runs = _pattern("[" + "".join(kinds[k] for k in token_chars) + "]+") if token_chars else None

    def scan(text: str) -> list[Found]:
        spans = [m.span() for m in runs.finditer(text)] if runs else [(0, len(text))]
        found = [(a + k, a + k + n) for a, b in spans for n in range(min_gram, max_gram + 1) for k in range(b - a - n + 1)]
        return [(text[a:b], a, b, k) for k, (a, b) in enumerate(found)]

    return Tokenizer(scan)


@tokenizer()
def path_hierarchy(separator: str = "/", replacement: str | None = None, skip: int = 0, reverse: bool = False) -> Tokenizer:
    """Every prefix of a path that ends before a separator, and the whole."""
    put = replacement if replacement is not None else separator

    def scan(text: str) -> list[Found]:
        ends = [k for k, c in enumerate(text) if c == separator and k > 0] + ([len(text)] if text and not text.endswith(separator) else [])
        found = [(text[:e].replace(separator, put), 0, e) for e in ends][skip:]
        return [(t, a, e, k) for k, (t, a, e) in enumerate(found[::-1] if reverse else found)]

    return Tokenizer(scan)


@tokenizer()
def fingerprint(max_tokens: int = 100, separator: str = " ") -> Tokenizer:
    """One token: the first of the sorted distinct words, in lower case."""
    made = _pattern(f"[{WORD}]+")

    def scan(text: str) -> list[Found]:
        found = sorted(set(made.findall(text.lower())))[:max_tokens]
        return [(separator.join(found), 0, len(text), 0)] if found else []

    def native(c: Column) -> Column:
        found = F.regexp_extract_all(F.lower(c), F.lit(f"([{WORD}]+)"), F.lit(1))
        return F.when(F.size(found) > 0, F.array(F.array_join(F.slice(F.array_sort(F.array_distinct(found)), 1, max_tokens), separator))).otherwise(F.array().cast("array<string>"))

    return Tokenizer(scan, native)


@tokenizer()
def tab_separated(trim_fields: bool = True, skip_empty: bool = True) -> Tokenizer:
    def scan(text: str) -> list[Found]:
        out: list[Found] = []
        at = 0
        for field in text.split("\t"):
            term = field.strip() if trim_fields else field
            a = at + (len(field) - len(field.lstrip()) if trim_fields and term else 0)
            if term or not skip_empty:
                out.append((term, a, a + len(term), len(out)))
            at += len(field) + 1
        return out

    def native(c: Column) -> Column:
        fields = F.split(c, "\t", -1)
        fields = F.transform(fields, lambda f: F.regexp_replace(f, r"(?U)^\s+|\s+$", "")) if trim_fields else fields
        return F.filter(fields, lambda f: f != "") if skip_empty else fields

    return Tokenizer(scan, native)


SENTENCE = _pattern("(?s)\\S.*?(?:[。！？]|[.!?⁈⁉](?=[\\s\"']|$)|\\s*$)")


@tokenizer()
def sentence(min_length: int = 1) -> Tokenizer:
    def scan(text: str) -> list[Found]:
        spans = [(m.start(), m.start() + len(m[0].rstrip())) for m in SENTENCE.finditer(text)]
        return [(text[a:b], a, b, k) for k, (a, b) in enumerate((a, b) for a, b in spans if b - a >= min_length)]

    return Tokenizer(scan)


@tokenizer()
def url(preserve_original: bool = False) -> Tokenizer:
    """Scheme, host labels, port, path segments, query keys and values, fragment of one URL."""
    whole = re.compile(r"(?s)(?:(?P<scheme>.*?)://)?(?P<host>[^/?#]*?)(?::(?P<port>[0-9]+))?(?P<path>/[^?#]*)?(?:\?(?P<query>[^#]*))?(?:#(?P<fragment>.*))?")

    def scan(text: str) -> list[Found]:
        bare = text.strip()
        if not bare:
            return []
        base = text.index(bare)
        m = whole.fullmatch(bare)
        spans = [(0, len(bare))] if preserve_original else []
        for name, split in (("scheme", None), ("host", r"[^.]+"), ("port", None), ("path", "[^/]+"), ("query", "[^&=]+"), ("fragment", None)):
            if m and m[name]:
                spans += [(m.start(name) + p.start(), m.start(name) + p.end()) for p in re.finditer(split, m[name])] if split else [m.span(name)]
        return [(bare[a:b], base + a, base + b, k) for k, (a, b) in enumerate(spans)]

    return Tokenizer(scan)


@tokenizer()
def email(preserve_original: bool = True, split_local: bool = True, split_domain: bool = True) -> Tokenizer:
    made = _pattern(rf"(?P<local>[{WORD}.+\-_!#$%&'*/=?^`{{|}}~]+)(?:@(?P<domain>[{WORD}.-]*))?")

    def scan(text: str) -> list[Found]:
        groups = []
        for m in made.finditer(text):
            domain = m["domain"]
            if domain is None or "." not in domain or len(domain.encode()) <= 2:
                groups.append([m.span()])
                continue
            group = [m.span()] if preserve_original else []
            for name, split, use in (("local", "[^.+]+", split_local), ("domain", "[^.]+", split_domain)):
                group.append(m.span(name))
                if use:
                    group += [(m.start(name) + p.start(), m.start(name) + p.end()) for p in re.finditer(split, m[name])]
            groups.append(group)
        return spread(groups, text, same=True)

    return Tokenizer(scan)


@tokenizer()
def code(split_dots: bool = True, include_operators: bool = False) -> Tokenizer:
    """Contents of string literals, numbers, identifiers, and operators where asked for."""
    dot = "" if split_dots else "."
    strings = "|".join(rf"{q}((?:[^\\{q}]+|\\.)*+)(?:{q}|\\?$)" for q in "\"'`")
    made = _pattern(rf"(?s)([+\-*/%=!<>&|^~]+)|(0[xX][0-9a-fA-F]*|[0-9][0-9._]*)|([{WORD}_{dot}]+)|{strings}")

    def scan(text: str) -> list[Found]:
        spans = [m.span(kind) for m in made.finditer(text) if (kind := m.lastindex) != 1 or include_operators]
        return [(text[a:b], a, b, k) for k, (a, b) in enumerate((a, b) for a, b in spans if b > a)]

    return Tokenizer(scan)


@tokenizer()
def log(extract_kv_pairs: bool = True) -> Tokenizer:
    """Quoted and bracketed contents, words, and of a=b both sides at the next position."""
    made = _pattern(r"(?s)(?P<q>[\"'])(?P<text>(?:\\.|(?!(?P=q)).)*)(?P=q)?|\[(?P<box>[^\]]*)\]?|(?P<word>[^\s\[\"]+)")

    def scan(text: str) -> list[Found]:
        out: list[Found] = []
        position = 0
        for m in made.finditer(text):
            name = "word" if m["word"] is not None else "box" if m["box"] is not None else "text"
            a, b = m.span(name)
            if a == b:
                continue
            out.append((text[a:b], a, b, position))
            position += 1
            eq = text.find("=", a, b)
            if name == "word" and extract_kv_pairs and a < eq < b - 1:
                out += [(text[a:eq], a, eq, position), (text[eq + 1 : b], eq + 1, b, position)]
        return out

    return Tokenizer(scan)


@tokenizer()
def json_field(include_keys: bool = False, include_numbers: bool = False) -> Tokenizer:
    """String values as written; tolerant of broken JSON. Keys are strings where an object expects one."""
    made = re.compile(r'(?s)"(?P<text>(?:\\u.{0,4}|\\.|[^"\\])*)"|(?P<mark>[{}\[\]:,])|(?P<num>[0-9-][0-9.eE+-]*)')

    def scan(text: str) -> list[Found]:
        stack: list[bool | None] = []  # for an object: whether a key comes next; None for an array
        spans = []
        for m in made.finditer(text):
            expects_key = bool(stack and stack[-1])
            if m["mark"]:
                c = m["mark"]
                if c in "{[":
                    stack.append(True if c == "{" else None)
                elif c in "}]":
                    stack = stack[:-1]
                elif stack and stack[-1] is not None:
                    stack[-1] = c == ","
                continue
            if m["num"] is not None:
                if include_numbers and not expects_key:
                    spans.append(m.span("num"))
                    if stack and stack[-1] is not None:
                        stack[-1] = True
                continue
            if m["text"] and (include_keys or not expects_key):
                spans.append(m.span("text"))
            if stack and stack[-1] is not None:
                stack[-1] = not stack[-1]
        return [(text[a:b], a, b, k) for k, (a, b) in enumerate(spans)]

    return Tokenizer(scan)


@tokenizer()
def markdown(include_urls: bool = False, include_code: bool = True) -> Tokenizer:
    """Words of the text without its markup; offsets are of the source."""
    word = _pattern(f"[{WORD}][{WORD}']*")
    marks = re.compile(r"(?s)```[^\n]*\n(?P<block>.*?)(?:```|$)|(?P<ticks>`{1,2})(?P<span>.*?)(?:(?P=ticks)|$)|\]\((?P<url>[^)]*)\)?|[*_]+")

    def scan(text: str) -> list[Found]:
        keep = np.ones(len(text), bool)  # characters that count as text
        joint = np.zeros(len(text), bool)  # emphasis marks: gone without parting a word
        for m in marks.finditer(text):
            a, b = m.span()
            inner = next((n for n, use in (("block", include_code), ("span", include_code), ("url", include_urls)) if m[n] is not None and use), None)
            keep[a:b] = False
            if inner:
                keep[slice(*m.span(inner))] = True
            elif m[0][0] in "*_":
                joint[a:b] = True
        places = [k for k in range(len(text)) if not joint[k]]
        shown = "".join(text[k] if keep[k] else " " for k in places)
        return [(m[0], places[m.start()], places[m.end() - 1] + 1, k) for k, m in enumerate(word.finditer(shown))]

    return Tokenizer(scan)


@tokenizer()
def phone_number(preserve_original: bool = True, emit_normalized: bool = True) -> Tokenizer:
    """Phone numbers with their digit groups and their digits alone, at one position; other runs of letters and numbers."""
    made = _pattern(rf"(?P<phone>[+(0-9][0-9+\-() .]*)|[{WORD}]+")

    def fits(s: str) -> bool:
        digits = sum(c in "0123456789" for c in s)
        if not 7 <= digits <= 15 or digits / len(s) <= 0.5 or re.fullmatch(r"\d{4}-\d\d-\d\d|\d+\.\d+\.\d+\.\d+", s):
            return False
        return bool(re.search("[+( .-]", s)) or digits >= 10

    def scan(text: str) -> list[Found]:
        out: list[Found] = []
        position = 0
        for m in made.finditer(text):
            a, b = m.span()
            if m["phone"]:
                b = a + len(re.sub("[^0-9]+$", "", m[0]))
                if a == b:
                    continue
            term = text[a:b]
            if m["phone"] and fits(term):
                if preserve_original:
                    out.append((term, a, b, position))
                out += [(p[0], a + p.start(), a + p.end(), position) for p in re.finditer("[0-9+]+", term)]
                if emit_normalized:
                    out.append((re.sub("[^0-9]", "", term), a, b, position))
            else:
                out.append((term, a, b, position))
            position += 1
        return out

    return Tokenizer(scan)
