"""Normalizers: from a text column to a text column."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import normalizer

Normalizer = Callable[[Column], Column]


@normalizer()
def trim() -> Normalizer:
    return lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@normalizer()
def collapse_whitespace() -> Normalizer:
    return lambda c: F.regexp_replace(c, r"(?U)\s+", " ")


@normalizer()
def lowercase() -> Normalizer:
    return F.lower


@normalizer()
def uppercase() -> Normalizer:
    return F.upper


@normalizer()
def mapping(rules: tuple[tuple[str, str], ...] = ()) -> Normalizer:
    """Rules one after another; later ones see what earlier ones made."""

    def run(c: Column) -> Column:
        for old, new in rules:
            c = F.replace(c, F.lit(old), F.lit(new)) if old else c
        return c

    return run


@normalizer()
def pattern_replace(pattern: str = r"[^\p{L}\p{M}\p{N}_\s]", replacement: str = "") -> Normalizer:
    re.compile(re.sub(r"\\p\{\w+\}|\(\?U\)|&&", "", pattern))  # a broken pattern fails here, not in a task
    return lambda c: F.regexp_replace(c, "(?U)" + pattern, replacement)


#: Tags that part words, and entities that are decoded.
BLOCK_TAGS = "p div br hr h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre section article header footer"
ENTITIES = "amp lt gt quot apos nbsp copy reg trade mdash ndash hellip laquo raquo"


def _entity(m: re.Match) -> str:
    name = m[1]
    if name.startswith("#"):
        digits, base = (name[2:], 16) if name[1:2] in ("x", "X") else (name[1:], 10)
        try:
            code = int(digits, base)
        except ValueError:
            return m[0]
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]
    if name == "nbsp":
        return " "
    return html.unescape(m[0]) if name in ENTITIES.split() else m[0]


def stripped_html(text: str, escaped_tags: frozenset[str] = frozenset()) -> str:
    """Tags go, block tags leave one space where the output doesn't end in one; entities are decoded."""
    blocks, out, length = set(BLOCK_TAGS.split()), [], 0
    for part in re.finditer(r"(?s)<(?P<name>/?[^> /]*)[^>]*>?|&(?P<entity>[^;]{0,10});|[^<&]+|&", text):
        piece = part[0]
        if part["name"] is not None:
            name = part["name"].lstrip("/").lower()
            if name not in escaped_tags:
                piece = " " if name in blocks and length and not out[-1].endswith(" ") else ""
        elif part["entity"] is not None:
            piece = re.sub("(?s)&(.*);", _entity, piece)
        if piece:
            out.append(piece)
            length += len(piece)
    return "".join(out)


def _by_text(fn: Callable[[str], str]) -> Normalizer:
    def apply(c: Column) -> Column:
        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield texts.map(lambda t: None if t is None else fn(t))

        return run(c)

    return apply


@normalizer()
def html_strip(escaped_tags: tuple[str, ...] = ()) -> Normalizer:
    kept = frozenset(t.lower() for t in escaped_tags)
    return _by_text(lambda t: stripped_html(t, kept))


def _form(name: str) -> Callable[[], Normalizer]:
    return lambda: _by_text(lambda t: t if t.isascii() else unicodedata.normalize(name, t))


for _name in ("NFC", "NFD", "NFKC", "NFKD"):
    normalizer(f"unicode_{_name.lower()}")(_form(_name))
