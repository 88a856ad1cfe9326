"""N-grams, shingles and filters over the whole stream of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tokens import TOKENS, Filter, expand, is_one_of, keep_tokens, let, like, none, one, terms, token
from .registry import token_filter


def _grams(t: Column, least: int, most: int) -> Column:
    """All substrings of least to most characters, shorter ones first."""
    top = F.least(F.lit(most), F.length(t))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))
    return F.when(F.length(t) < least, none()).otherwise(F.flatten(F.transform(F.sequence(F.lit(least), top), of)))


@token_filter()
def ngram(min_gram: int = 1, max_gram: int = 2, preserve_original: bool = False) -> Filter:
    """Terms too short for any n-gram go, or stay with preserve_original."""
    least, most = max(1, min_gram), max(max_gram, min_gram)
    if not preserve_original:
        return expand(lambda t: _grams(t, least, most))
    return expand(lambda t: F.when(t == "", none()).otherwise(F.concat(_grams(t, least, most), one(t))))


@token_filter()
def edge_ngram(min_gram: int = 1, max_gram: int = 1, preserve_original: bool = False) -> Filter:
    least, most = max(1, min_gram), max(max_gram, min_gram)

    def prefixes(t: Column) -> Column:
        made = F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(t))), lambda n: F.left(t, n))
        whole = F.when(F.length(t) > most, one(t)).otherwise(none())
        short = F.when((t != "") & F.lit(preserve_original), one(t)).otherwise(none())
        return F.when(F.length(t) < least, short).otherwise(F.concat(made, whole) if preserve_original else made)

    return expand(prefixes)


#: The characters of each kind that form bigrams.
CJK = {
    "han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B81F}\x{F900}-\x{FAFF}",
    "hiragana": r"\x{3040}-\x{309F}",
    "katakana": r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}",
    "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
}


@token_filter()
def cjk_bigram(output_unigrams: bool = False, kinds: tuple[str, ...] = tuple(CJK)) -> Filter:
    """Bigrams of the CJK runs within a term; other characters of such a term go."""
    chars = "[" + "".join(CJK[k] for k in kinds) + "]"
    pairs = lambda r: F.when(F.length(r) < 2, none()).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2)))

    def cut(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(f"({chars}+)"), F.lit(1))
        two = F.flatten(F.transform(runs, pairs))
        if output_unigrams:
            return F.concat(F.regexp_extract_all(t, F.lit(f"({chars})"), F.lit(1)), two)
        return F.concat(two, F.filter(runs, lambda r: F.length(r) == 1))

    return expand(lambda t: F.when(t.rlike(chars), cut(t)).otherwise(one(t)))


@token_filter()
def keyword_repeat() -> Filter:
    return expand(lambda t: F.array(t, t))


@token_filter()
def limit(max_token_count: int = 1) -> Filter:
    return lambda tokens: F.slice(tokens, 1, max_token_count)


@token_filter()
def unique(only_on_same_position: bool = False) -> Filter:
    """First occurrences only: of each term, or of each term at each position."""
    if only_on_same_position:
        return remove_duplicates()
    return lambda tokens: let(tokens, lambda ts: let(_first_at(terms(ts)), lambda first: F.filter(ts, lambda t, i: F.get(first, i))))


def _first_at(keys: Column) -> Column:
    """For each element whether it is the first of its kind: by sorting, not by pairwise search."""
    ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    marked = let(ordered, lambda o: F.transform(o, lambda x, j: F.struct(x["i"].alias("i"), ((j == 0) | (F.get(o, F.greatest(j - 1, F.lit(0)))["k"] != x["k"])).alias("first"))))
    return F.transform(F.sort_array(marked), lambda x: x["first"])


@token_filter()
def remove_duplicates() -> Filter:
    """A term repeated at the same position goes."""
    keys = lambda ts: F.transform(ts, lambda t: F.struct(t["position"].alias("p"), t["term"].alias("t")))
    return lambda tokens: let(tokens, lambda ts: let(_first_at(keys(ts)), lambda first: F.filter(ts, lambda t, i: F.get(first, i))))


def joined(ts: Column, first: Column, size: int, separator: str) -> Column:
    """The token made of `size` tokens from number `first` (from 0) on."""
    start, end = F.get(ts, first), F.get(ts, first + (size - 1))
    return token(F.concat_ws(separator, *[F.get(ts, first + k)["term"] for k in range(size)]), start["start_offset"], end["end_offset"], start["position"])


@token_filter()
def shingle(min_size: int = 2, max_size: int = 2, separator: str = " ", output_unigrams: bool = True) -> Filter:
    """After each token the shingles that end with it."""
    sizes = range(max(2, min_size), max(max_size, min_size) + 1)

    def ending(ts: Column, i: Column) -> Column:
        nothing = F.array().cast(TOKENS)
        return F.concat(*[F.when(i + 1 >= n, F.array(joined(ts, F.greatest(i - n + 1, F.lit(0)), n, separator))).otherwise(nothing) for n in sizes])

    def run(ts: Column) -> Column:
        each = F.transform(ts, lambda t, i: F.concat(F.array(t), ending(ts, i)) if output_unigrams else ending(ts, i))
        return F.flatten(each)

    return lambda tokens: let(tokens, run)


@token_filter()
def fixed_shingle(size: int = 2, separator: str = " ") -> Filter:
    """Shingles of one size in place of the tokens."""

    def run(ts: Column) -> Column:
        return F.when(F.size(ts) < size, F.array().cast(TOKENS)).otherwise(F.transform(F.sequence(F.lit(0), F.size(ts) - size), lambda i: joined(ts, i, size, separator)))

    return lambda tokens: let(tokens, run)


@token_filter()
def common_grams(words: tuple[str, ...] = (), ignore_case: bool = False, separator: str = "_") -> Filter:
    """After a token its pair with the one before, where either is a common word."""
    known = [w.lower() for w in words] if ignore_case else list(words)
    common = lambda t: is_one_of(F.lower(t["term"]) if ignore_case else t["term"], known)

    def run(ts: Column) -> Column:
        def grams(t: Column, i: Column) -> Column:
            before = F.get(ts, F.greatest(i - 1, F.lit(0)))
            pair = token(F.concat(before["term"], F.lit(separator), t["term"]), before["start_offset"], t["end_offset"], before["position"])
            return F.when((i > 0) & (common(before) | common(t)), F.array(t, pair)).otherwise(F.array(t))

        return F.flatten(F.transform(ts, grams))

    return lambda tokens: let(tokens, run)


@token_filter()
def common_grams_query(separator: str = "_") -> Filter:
    """Pairs stay, and single terms that no pair follows."""
    pair = lambda t: F.contains(t["term"], F.lit(separator))

    def run(ts: Column) -> Column:
        return F.filter(ts, lambda t, i: pair(t) | ~F.coalesce(pair(F.get(ts, i + 1)), F.lit(False)))

    return lambda tokens: let(tokens, run)


@token_filter()
def concatenate_graph(separator: str = " ", max_bytes: int = 256) -> Filter:
    """Each token becomes all terms so far; too long ones go."""

    def run(ts: Column) -> Column:
        lengths = F.transform(ts, lambda t: F.octet_length(t["term"]))
        cap = let(lengths, lambda n: F.aggregate(n, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda a, x: F.struct((a["sum"] + x + 1).alias("sum"), (a["n"] + F.when(a["sum"] + x <= max_bytes, 1).otherwise(0)).alias("n")), lambda a: a["n"]))
        first = F.get(ts, F.lit(0))
        made = lambda c: F.transform(F.slice(ts, 1, c), lambda t, i: token(F.array_join(terms(F.slice(ts, F.lit(1), i + 1)), separator), first["start_offset"], t["end_offset"], first["position"]))
        return let(cap, made)

    return lambda tokens: let(tokens, run)


def concatenate_tokens(tokens: Column, separator: str = " ") -> Column:
    """One token of all terms at position 0; null without tokens."""
    made = lambda ts: token(F.array_join(terms(ts), separator), F.get(ts, F.lit(0))["start_offset"], F.element_at(ts, -1)["end_offset"], F.lit(0))
    return let(tokens, lambda ts: F.when(F.size(ts) > 0, made(ts)))


@token_filter()
def fingerprint(separator: str = " ", max_bytes: int = 1024) -> Filter:
    """One token of the sorted distinct terms; none when it would be too long."""

    def run(ts: Column) -> Column:
        text = F.array_join(F.array_sort(F.array_distinct(terms(ts))), separator)
        whole = token(text, F.get(ts, F.lit(0))["start_offset"], F.element_at(ts, -1)["end_offset"], F.lit(0))
        return F.when(ts.isNotNull(), F.when((F.size(ts) == 0) | (F.octet_length(text) > max_bytes), F.array().cast(TOKENS)).otherwise(F.array(whole)))

    return lambda tokens: let(tokens, run)


def _running_max(values: Column) -> Column:
    """The greatest of the values so far; those out of order are met in rounds, each looking twice as far back."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1)
    back = lambda i, k: i - F.pow(F.lit(2), k).cast("int")
    met = F.aggregate(rounds, values, lambda a, k: F.transform(a, lambda x, i: F.when(back(i, k) >= 0, F.greatest(x, F.get(a, F.greatest(back(i, k), F.lit(0))))).otherwise(x)))
    return F.when(F.sort_array(values) == values, values).otherwise(met)


@token_filter()
def fix_broken_offsets() -> Filter:
    """Tokens start no earlier than the one before ended, and end no earlier than they start."""

    def run(ts: Column) -> Column:
        # the end of a token is the greatest start or end so far
        running = let(F.transform(ts, lambda t: F.greatest(t["start_offset"], t["end_offset"], F.lit(0))), _running_max)
        return let(running, lambda r: F.transform(ts, lambda t, i: token(t["term"], F.greatest(t["start_offset"], F.when(i > 0, F.get(r, F.greatest(i - 1, F.lit(0)))).otherwise(0)), F.get(r, i), t["position"])))

    return lambda tokens: let(tokens, run)


@token_filter()
def flatten_graph() -> Filter:
    """Sorted by position, longer spans first, and positions renumbered without gaps."""

    def run(ts: Column) -> Column:
        keyed = F.transform(ts, lambda t, i: F.struct(t["position"].alias("p"), (t["start_offset"] - t["end_offset"]).alias("s"), i.alias("i"), t.alias("t")))
        at = lambda xs, j: F.get(xs, F.greatest(j, F.lit(0)))["p"]

        def renumbered(xs: Column) -> Column:
            n = F.size(xs)
            heads = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | ~at(xs, j).eqNullSafe(at(xs, j - 1)))  # the first token of each position
            unplaced = at(xs, F.lit(0)).isNull().cast("int")  # tokens without a position come first and have no number
            group = lambda hs, h, g: F.transform(F.slice(xs, h + 1, F.coalesce(F.get(hs, g + 1), n) - h), lambda x: token(x["t"]["term"], x["t"]["start_offset"], x["t"]["end_offset"], F.when(x["p"].isNotNull(), g - unplaced)))
            return F.when(n > 0, let(heads, lambda hs: F.flatten(F.transform(hs, lambda h, g: group(hs, h, g))))).when(n == 0, F.array().cast(TOKENS))

        return let(F.sort_array(keyed), renumbered)

    return lambda tokens: let(tokens, run)


__all__ = ["keep_tokens", "like"]
