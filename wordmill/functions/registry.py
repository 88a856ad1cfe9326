"""Named components: tokenizers, normalizers, token filters, analyzers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

FILTERS: dict[str, Callable[..., Any]] = {}
NORMALIZERS: dict[str, Callable[..., Any]] = {}
TOKENIZERS: dict[str, Callable[..., Any]] = {}
ANALYZERS: dict[str, Callable[..., Any]] = {}


def _into(kind: dict[str, Callable[..., Any]], names: tuple[str, ...]):
    def keep(make: Callable[..., Any]) -> Callable[..., Any]:
        for name in names or (make.__name__,):
            kind[name] = make
        return make

    return keep


def token_filter(*names: str):
    """Register a factory of a token filter (default name: its own)."""
    return _into(FILTERS, names)


def normalizer(*names: str):
    return _into(NORMALIZERS, names)


def tokenizer(*names: str):
    return _into(TOKENIZERS, names)


def analyzer(*names: str):
    return _into(ANALYZERS, names)
