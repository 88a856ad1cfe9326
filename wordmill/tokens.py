"""The token column and the few shapes that all token filters have.

A token column is array<struct<term, start_offset, end_offset, position>>;
offsets are bytes of the normalised text. A filter is a function from one token
column to another, so a chain of filters is one column expression, row-local:
it needs no shuffle and runs unchanged on streams. Null stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = "array<struct<term:string,start_offset:int,end_offset:int,position:int>>"
STRINGS = "array<string>"

TermFn = Callable[[Column], Column]
Filter = Callable[[Column], Column]


def none() -> Column:
    """No strings."""
    return F.array().cast(STRINGS)


def one(term: Column) -> Column:
    return F.array(term)


def string(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def let(value: Column, body: TermFn) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def token(term: Column, start: Column, end: Column, position: Column) -> Column:
    return F.struct(term.alias("term"), start.cast("int").alias("start_offset"), end.cast("int").alias("end_offset"), position.cast("int").alias("position"))


def like(t: Column, term: Column) -> Column:
    """A token at the place of t."""
    return token(term, t["start_offset"], t["end_offset"], t["position"])


def rewrite(fn: TermFn, drop_empty: bool = False) -> Filter:
    """Each term replaced."""

    def run(tokens: Column) -> Column:
        out = F.transform(tokens, lambda t: like(t, fn(t["term"])))
        return F.filter(out, lambda t: t["term"] != "") if drop_empty else out

    return run


def drop(pred: TermFn) -> Filter:
    """Tokens whose term satisfies pred go; the rest keep their positions."""
    return lambda tokens: F.filter(tokens, lambda t: ~F.coalesce(pred(t["term"]), F.lit(False)))


def keep_tokens(pred: TermFn) -> Filter:
    """As drop, but by the whole token, and those satisfying pred stay."""
    return lambda tokens: F.filter(tokens, pred)


def expand(fn: TermFn) -> Filter:
    """Each term becomes all of fn(term): an array of strings at its place."""
    return lambda tokens: F.flatten(F.transform(tokens, lambda t: F.transform(fn(t["term"]), lambda x: like(t, x))))


def inject(extras: TermFn, term: TermFn | None = None) -> Filter:
    """Tokens stay (changed by term, if given), extras(old term) follow at their place."""
    return expand(lambda x: F.concat(one(term(x) if term else x), extras(x)))


def tag(value: TermFn, when: TermFn | None = None, unless: str | None = None, term: TermFn | None = None) -> Filter:
    """One more token follows where `when` holds and the term doesn't start with `unless`."""

    def choose(x: Column) -> Column:
        ok = when(x) if when else F.lit(True)
        if unless:
            ok = ok & ~F.startswith(x, F.lit(unless))
        old = one(x)
        return F.when(F.coalesce(ok, F.lit(False)), F.array(term(x) if term else x, value(x))).otherwise(old)

    return expand(choose)


def chain(*filters: Filter) -> Filter:
    def run(tokens: Column) -> Column:
        for f in filters:
            tokens = f(tokens)
        return tokens

    return run


def table(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def look_up(entries: dict[str, str], key: Column) -> Column:
    """The entry of key, or null."""
    return F.try_element_at(table(entries), key) if entries else F.lit(None).cast("string")


def is_one_of(term: Column, words) -> Column:
    words = sorted(set(words))
    return term.isin(*words) if words else F.lit(False)


class Memo(dict):
    """fn(term), computed once for each distinct term in a worker."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, term: str):
        if len(self) > 200_000:
            self.clear()
        self[term] = out = self.fn(term)
        return out


def _by_term(fn: Callable, kind: str):
    """An Arrow function over arrays of terms."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo(fn)
        for terms in batches:
            yield terms.map(lambda own: None if own is None else [memo[t] for t in own])

    return run


def python_terms(fn: Callable[[str], str | None]) -> Filter:
    """For rules that columns can't express: terms go to Arrow batches by the
    array, and fn runs once per distinct term in a worker. None drops the token."""

    def apply(tokens: Column) -> Column:
        new = _by_term(fn, STRINGS)(F.transform(tokens, lambda t: t["term"]))
        out = F.transform(F.arrays_zip(tokens.alias("t"), new.alias("x")), lambda z: like(z["t"], z["x"]))
        return F.filter(out, lambda t: t["term"].isNotNull())

    return apply


def python_expand(fn: Callable[[str], list[str]]) -> Filter:
    """As python_terms, but each term becomes all of fn(term)."""

    def apply(tokens: Column) -> Column:
        new = _by_term(fn, f"array<{STRINGS}>")(F.transform(tokens, lambda t: t["term"]))
        return F.flatten(F.transform(F.arrays_zip(tokens.alias("t"), new.alias("x")), lambda z: F.transform(z["x"], lambda x: like(z["t"], x))))

    return apply


# Views of a token column.


def terms(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["term"])


def unique_terms(tokens: Column) -> Column:
    """Distinct terms in order of their first occurrence."""
    return F.array_distinct(terms(tokens))


def take(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n) if n > 0 else F.slice(tokens, 1, 0)


def skip(tokens: Column, n: int) -> Column:
    return F.filter(tokens, lambda t, i: i >= n)


def count_matching(tokens: Column, pred: TermFn) -> Column:
    return F.size(F.filter(tokens, pred))


def max_position(tokens: Column) -> Column:
    """Null without tokens."""
    return F.array_max(F.transform(tokens, lambda t: t["position"]))


def total_span(tokens: Column) -> Column:
    """(least start, greatest end), null without tokens."""
    start, end = F.array_min(F.transform(tokens, lambda t: t["start_offset"])), F.array_max(F.transform(tokens, lambda t: t["end_offset"]))
    return F.when(F.size(tokens) > 0, F.struct(start.alias("start_offset"), end.alias("end_offset")))
