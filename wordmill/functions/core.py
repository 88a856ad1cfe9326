"""Core filters: splitting, synonyms, dictionaries, combinators, keeping and dropping."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tokens import Filter, TermFn, drop, expand, inject, is_one_of, keep_tokens, let, like, look_up, none, one, python_expand, rewrite, string, tag, token
from .registry import token_filter

DIGIT, UP, LOW = r"\p{N}", r"\p{IsUppercase}", r"\p{IsLowercase}"


# Dropping and keeping.


@token_filter("codepoint_count", "length")
def length(least: int = 0, most: int = 2_147_483_647) -> Filter:
    return keep_tokens(lambda t: F.length(t["term"]).between(least, most))


@token_filter()
def drop_if_flagged(prefix: str = "__DROP__") -> Filter:
    return drop(lambda t: F.startswith(t, F.lit(prefix)))


#: What all characters of a term of each type are.
TYPES = {
    "alpha": r"^\p{IsAlphabetic}+$",
    "numeric": r"^[0-9.]+$",
    "alphanumeric": r"^(?=.*\p{IsAlphabetic})(?=.*[0-9])[\p{IsAlphabetic}\p{N}]+$",
    "cjk": r"^[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}]+$",
    "hangul": r"^[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]+$",
    "katakana": r"^[\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}]+$",
    "hiragana": r"^[\x{3040}-\x{309F}]+$",
}


@token_filter()
def keep_types(types: tuple[str, ...] = ("alpha",), exclude: bool = False) -> Filter:
    def fits(t: Column) -> Column:
        out = F.lit(False)
        for name in types:
            out = out | t["term"].rlike(TYPES[name])
        return ~out if exclude else out

    return keep_tokens(fits)


@token_filter()
def keep_words(words: tuple[str, ...] = (), ignore_case: bool = False) -> Filter:
    if ignore_case:
        return keep_tokens(lambda t: is_one_of(F.lower(t["term"]), [w.lower() for w in words]))
    return keep_tokens(lambda t: is_one_of(t["term"], words))


@token_filter()
def limit_token_offset(max_start_offset: int = 2_147_483_647) -> Filter:
    return keep_tokens(lambda t: t["start_offset"] <= max_start_offset)


@token_filter()
def limit_token_position(max_position: int = 2_147_483_647) -> Filter:
    return keep_tokens(lambda t: t["position"] <= max_position)


#: The characters counted for each script, in the order in which ties are settled (the last wins).
SCRIPT_CHARS = {
    "latin": r"[A-Za-z\x{C0}-\x{24F}]",
    "cjk": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]",
    "cyrillic": r"[\x{400}-\x{4FF}]",
    "arabic": r"[\x{600}-\x{6FF}\x{750}-\x{77F}]",
    "greek": r"[\x{370}-\x{3FF}]",
    "hebrew": r"[\x{590}-\x{5FF}]",
    "devanagari": r"[\x{900}-\x{97F}]",
    "thai": r"[\x{E00}-\x{E7F}]",
}


def detect_script(term: Column) -> Column:
    """The script of most characters; numeric and punctuation count too."""
    rest = term
    counts = []
    for name, pattern in SCRIPT_CHARS.items():
        counts.append((name, F.regexp_count(rest, F.lit(pattern))))
        rest = F.regexp_replace(rest, pattern, "")
    counts.append(("numeric", F.regexp_count(rest, F.lit(DIGIT))))
    counts.append(("punctuation", F.regexp_count(F.regexp_replace(rest, DIGIT, ""), F.lit(r"[^\p{IsAlphabetic}]"))))
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, n) in enumerate(counts)]))
    return let(best, lambda b: F.when(b["n"] > 0, b["name"]).otherwise("unknown"))


#: Predicates by name: a term (and perhaps a parameter) to a condition; lengths are bytes.
PREDICATES = {
    "is_script": lambda t, script: detect_script(t) == script,
    "is_not_script": lambda t, script: detect_script(t) != script,
    "min_length": lambda t, n: F.octet_length(t) >= n,
    "max_length": lambda t, n: F.octet_length(t) <= n,
    "is_numeric": lambda t: t.rlike(rf"^{DIGIT}*$"),
    "is_not_numeric": lambda t: ~t.rlike(rf"^{DIGIT}*$"),
    "is_alphabetic": lambda t: t.rlike(r"^\p{IsAlphabetic}*$"),
    "pattern": lambda t, p: t.rlike(p),
}


def _condition(pred) -> TermFn:
    if callable(pred):
        return pred
    name, *args = (pred,) if isinstance(pred, str) else pred
    return lambda t: PREDICATES[name](t, *args)


@token_filter()
def predicate(predicates=()) -> Filter:
    """Tokens stay for which all predicates hold."""
    tests = [_condition(p) for p in predicates]

    def fits(t: Column) -> Column:
        out = F.lit(True)
        for test in tests:
            out = out & test(t["term"])
        return out

    return keep_tokens(fits)


# Combinators.


@token_filter()
def conditional(pred=("min_length", 0), then: Filter = lambda tokens: tokens) -> Filter:
    """Tokens for which pred holds go through another filter."""
    test = _condition(pred)
    return lambda tokens: F.flatten(F.transform(tokens, lambda t: F.when(test(t["term"]), then(F.array(t))).otherwise(F.array(t))))


@token_filter()
def multiplexer(filters: tuple[Filter, ...] = (), preserve_original: bool = True) -> Filter:
    """Results of all filters that differ from the term follow it, or replace it."""

    def run(tokens: Column) -> Column:
        def branches(t: Column) -> Column:
            found = F.concat(*[F.filter(f(F.array(t)), lambda x, i: (i > 0) | (x["term"] != t["term"])) for f in filters])
            if preserve_original:
                return F.concat(F.array(t), found)
            return F.when(F.size(found) > 0, F.transform(found, lambda x, i: F.when(i == 0, like(t, x["term"])).otherwise(x))).otherwise(F.array(t))

        return F.flatten(F.transform(tokens, branches)) if filters else tokens

    return run


# Dictionaries.


@token_filter("lookup", "dictionary_stem", "stemmer_override")
def lookup(known: dict[str, str] | None = None, ignore_case: bool = False) -> Filter:
    """Terms of the dictionary replaced; the first entry of a term counts."""
    table: dict[str, str] = {}
    for k, v in (known or {}).items():
        table.setdefault(k.lower() if ignore_case else k, v)
    return rewrite(lambda t: F.coalesce(look_up(table, F.lower(t) if ignore_case else t), t))


def stem_entries(text: str, separator: str = "\t") -> dict[str, str]:
    """word<tab>stem or word=>stem lines; blank lines and # comments don't count."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        left, found, right = line.partition(separator)
        if found and left.strip() and right.strip() and not line.lstrip().startswith("#"):
            out.setdefault(left.strip(), right.strip())
    return out


def synonym_rules(text: str) -> dict[str, tuple[list[str], bool]]:
    """term -> (replacements, contract). Lines: `a => b, c` or `a, b, c`, # comments."""
    out: dict[str, tuple[list[str], bool]] = {}
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        left, arrow, right = line.partition("=>")
        words = [w for w in map(str.strip, (right if arrow else line).split(",")) if w]
        if arrow and left.strip() and words:
            out[left.strip()] = (words, False)
        elif not arrow and len(words) >= 2:
            out |= {w: ([x for x in words if x != w], False) for w in words}
    return out


@token_filter()
def synonym(rules: str | dict[str, tuple[list[str], bool]] = "", ignore_case: bool = False) -> Filter:
    """Expanding rules add their words after the term, contracting ones put their first in its place."""
    found = synonym_rules(rules) if isinstance(rules, str) else rules
    key = (lambda t: F.lower(t)) if ignore_case else (lambda t: t)
    found = {k.lower() if ignore_case else k: v for k, v in found.items()}
    if not found:
        return lambda tokens: tokens
    table = F.create_map(*[x for k, (words, _) in found.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in words]))])
    short = [k for k, (_, contract) in found.items() if contract]

    def terms(t: Column) -> Column:
        words = F.try_element_at(table, key(t))
        return F.when(words.isNull(), one(t)).when(is_one_of(key(t), short), F.slice(words, 1, 1)).otherwise(F.concat(one(t), words))

    return expand(terms)


@token_filter()
def dictionary_decompounder(words: tuple[str, ...] = (), min_word: int = 5, min_sub: int = 2, max_sub: int = 15, only_longest: bool = False) -> Filter:
    """Dictionary words within a term follow it, each once."""
    known = set(words)

    def parts(term: str) -> list[str]:
        low = term.lower()
        if len(low) < min_word:
            return [term]
        found = dict.fromkeys(low[a:b] for a in range(len(low)) for b in range(a + min_sub, min(a + max_sub, len(low)) + 1) if low[a:b] in known)
        return [term, *(sorted(found, key=lambda w: -len(w.encode()))[:1] if only_longest else found)]

    return python_expand(parts)


@token_filter()
def hyphenation_decompounder(words: tuple[str, ...] = (), min_word: int = 5, min_sub: int = 2, max_sub: int = 15, only_longest: bool = False) -> Filter:
    """A term that is two dictionary words is followed by both."""
    known = {w.lower() for w in words}

    def halves(term: str) -> list[str]:
        low = term.lower()
        if len(low) < max(min_word, 2 * min_sub):
            return [term]
        for cut in range(min_sub, len(low) - min_sub + 1):
            pair = [low[:cut], low[cut:]]
            if all(p in known and min_sub <= len(p.encode()) <= max_sub for p in pair):
                return [term, *pair]
        return [term]

    return python_expand(halves)


# Patterns.


@token_filter()
def pattern_replace(pattern: str = ".*", replacement: str = "$0", every: bool = True) -> Filter:
    """An empty result removes the token."""
    whole = re.sub(r"\$\{?0\}?", "$0", replacement)
    shape = "(?U)" + pattern if every else "(?U)(?s)^(.*?)" + f"(?:{pattern})"
    return rewrite(lambda t: F.regexp_replace(t, shape, whole if every else "$1" + whole), drop_empty=True)


@token_filter()
def pattern_capture(patterns: tuple[str, ...] = (), preserve_original: bool = False) -> Filter:
    """Capture groups of all matches, each text once, in order."""
    import regex

    made = [regex.compile(p) for p in patterns]

    def run(term: str) -> list[str]:
        found = dict.fromkeys(g for p in made for m in p.finditer(term) for g in m.groups() if g)
        return [term, *found] if preserve_original or not found else list(found)

    return python_expand(run)


@token_filter()
def pattern_keyword_marker(pattern: str = ".*", prefix: str = "__KW__") -> Filter:
    return tag(lambda t: string(prefix, t), lambda t: t.rlike("(?U)" + pattern))


@token_filter()
def pattern_typing(rules: tuple[tuple[str, str], ...] = ()) -> Filter:
    """The type of the first pattern that matches."""

    def name(t: Column) -> Column:
        out = F.when(F.lit(False), "")
        for pattern, kind in rules:
            out = out.when(t.rlike("(?U)" + pattern), f"_type:{kind}")
        return out

    return tag(name, lambda t: name(t).isNotNull())


@token_filter("keyword_marker", "protected_words")
def keyword_marker(words: tuple[str, ...] = (), then: Filter | None = None, ignore_case: bool = False) -> Filter:
    """Terms of the list are kept from `then`; without it nothing changes."""
    if then is None:
        return lambda tokens: tokens
    safe = {w.lower() for w in words} if ignore_case else set(words)
    return conditional(lambda t: ~is_one_of(F.lower(t) if ignore_case else t, safe), then)


# Splitting.


@token_filter()
def hyphenated_words() -> Filter:
    return rewrite(lambda t: F.regexp_replace(t, "(?s)(?<=.)-$", ""))


def _before(delimiter: str) -> Filter:
    return rewrite(lambda t: F.substring_index(t, delimiter, 1), drop_empty=True)


@token_filter()
def delimited_payload(delimiter: str = "|") -> Filter:
    return _before(delimiter)


@token_filter()
def delimited_term_freq(delimiter: str = "|") -> Filter:
    return _before(delimiter)


@token_filter()
def delimited_boost(delimiter: str = "|") -> Filter:
    rest = lambda t: F.substring(t, F.locate(delimiter, t) + len(delimiter), F.length(t))
    return tag(lambda t: string("_boost:", rest(t)), lambda t: F.contains(t, F.lit(delimiter)), unless="_boost:", term=lambda t: F.substring_index(t, delimiter, 1))


@token_filter()
def type_as_synonym(prefix: str = "_type:") -> Filter:
    def name(t: Column) -> Column:
        has = lambda p: t.rlike(p)
        alpha, digit, space = has(r"\p{IsAlphabetic}"), has("[0-9]"), has(r"(?U)\s")
        other = has(r"(?U)[^\p{IsAlphabetic}0-9\s]")
        kinds = F.when(t == "", "empty").when(alpha & ~digit & ~other & ~space, "alpha").when(digit & ~alpha & ~other & ~space, "numeric")
        kinds = kinds.when(alpha & digit & ~other & ~space, "alphanumeric").when(other & ~alpha & ~digit & ~space, "punctuation")
        return string(prefix, kinds.when(alpha & space & ~digit & ~other, "phrase").otherwise("mixed"))

    return tag(name)


@token_filter()
def date_recognizer() -> Filter:
    ymd, dmy = r"^(\d{4})([-/])(\d\d)\2(\d\d)$", r"^(\d\d)([-/])(\d\d)\2(\d{4})$"
    plain = r"^(\d{4})()(\d\d)(\d\d)$"

    def iso(t: Column) -> Column:
        out = F.when(F.lit(False), "")
        for pattern, (y, m, d) in ((ymd, (1, 3, 4)), (dmy, (4, 3, 1)), (plain, (1, 3, 4))):
            part = [F.regexp_extract(t, pattern, k) for k in (y, m, d)]
            fits = t.rlike(pattern) & part[0].between("1900", "2100") & part[1].between("01", "12") & part[2].between("01", "31")
            out = out.when(fits, F.concat_ws("-", *part))
        return out

    return tag(iso, lambda t: iso(t).isNotNull() & (iso(t) != t))


def _segments(term: Column, case: bool, numerics: bool) -> Column:
    """Runs of letters and digits; characters that are neither upper, lower nor numeric part them."""
    if not numerics:
        inner = f"(?:{UP}|{LOW}|{DIGIT})+" if not case else f"(?:{UP}|{DIGIT})*(?:{LOW}|{DIGIT})*"
        pattern = f"({inner})"
    else:
        pattern = f"({DIGIT}+|{UP}*{LOW}+|{UP}+)" if case else f"({DIGIT}+|(?:{UP}|{LOW})+)"
    return F.filter(F.regexp_extract_all(term, F.lit(pattern), F.lit(1)), lambda x: x != "")


@token_filter()
def word_delimiter(
    split_on_case_change: bool = True, split_on_numerics: bool = True, generate_word_parts: bool = True, generate_number_parts: bool = True,
    catenate_words: bool = False, catenate_numbers: bool = False, preserve_original: bool = False,
) -> Filter:
    """Parts stand at their own offsets and successive positions."""

    def run(tokens: Column) -> Column:
        return F.flatten(F.transform(tokens, one_token))

    def one_token(t: Column) -> Column:
        parts = _segments(t["term"], split_on_case_change, split_on_numerics)
        return let(parts, lambda p: F.when((F.size(p) == 1) & F.lit(not preserve_original), F.array(t)).otherwise(let(t, lambda u: spread(u, p))))

    def spread(t: Column, parts: Column) -> Column:
        number = lambda x: x.rlike(f"^{DIGIT}+$")

        def step(a: Column, x: Column) -> Column:
            at = F.call_function("locate", x, t["term"], a["next"])
            start = t["start_offset"] + F.octet_length(F.substring(t["term"], 1, at - 1))
            made = token(x, start, start + F.octet_length(x), t["position"] + F.size(a["out"]))
            return F.struct((at + F.length(x)).alias("next"), F.concat(a["out"], F.array(made)).alias("out"))

        empty = F.array().cast("array<struct<term:string,start_offset:int,end_offset:int,position:int>>")
        placed = F.aggregate(parts, F.struct(F.lit(1).alias("next"), empty.alias("out")), step, lambda a: a["out"])
        wanted = F.filter(placed, lambda x: F.when(number(x["term"]), F.lit(generate_number_parts)).otherwise(F.lit(generate_word_parts)))
        out = [F.array(t)] if preserve_original else []
        out.append(wanted)
        for use, test in ((catenate_words, lambda x: ~number(x)), (catenate_numbers, number)):
            if use:
                whole = F.array_join(F.filter(parts, test), "")
                out.append(F.when((whole != "") & (F.size(parts) > 1), F.array(like(t, whole))).otherwise(empty))
        return F.concat(*out)

    return run


@token_filter()
def word_delimiter_graph(
    split_on_case_change: bool = True, split_on_numerics: bool = True, generate_word_parts: bool = True, generate_number_parts: bool = True,
    concatenate_words: bool = False, concatenate_numbers: bool = False, concatenate_all: bool = False, preserve_original: bool = False, stem_english_possessive: bool = True,
) -> Filter:
    """Parts stand at the place of the term."""
    number = lambda x: x.rlike(f"^{DIGIT}+$")

    def terms(t: Column) -> Column:
        bare = F.regexp_replace(t, "['’]s$", "") if stem_english_possessive else t
        cuts = [r"[^\p{IsAlphabetic}\p{N}]+"]
        if split_on_numerics:
            cuts += [rf"(?<=\p{{IsAlphabetic}})(?={DIGIT})", rf"(?<={DIGIT})(?=\p{{IsAlphabetic}})"]
        if split_on_case_change:
            cuts.append(f"(?<={LOW})(?={UP})")
        parts = F.filter(F.split(bare, "|".join(cuts), -1), lambda x: x != "")

        def found(p: Column) -> Column:
            own = F.filter(p, lambda x: F.when(number(x), F.lit(generate_number_parts)).otherwise(F.lit(generate_word_parts)))
            out = [own]
            for use, chosen, least in ((concatenate_words, F.filter(p, lambda x: ~number(x)), 1), (concatenate_numbers, F.filter(p, number), 1), (concatenate_all, p, 1)):
                if use:
                    out.append(F.when(F.size(chosen) > least, F.array(F.array_join(chosen, ""))).otherwise(none()))
            made = F.concat(*out)
            if preserve_original:
                return F.concat(one(t), F.when(F.size(p) > 0, made).otherwise(none()))
            return F.when(F.size(p) <= 1, one(bare)).when(F.size(made) == 0, one(t)).otherwise(made)

        return let(parts, found)

    return expand(terms)


@token_filter()
def phone_number(variants: bool = True) -> Filter:
    """At least four digits and half of the characters digits: all forms in order, the first in the term's place."""

    def forms(t: Column) -> Column:
        bare, plus = F.regexp_replace(t, "[^0-9]", ""), t.rlike(r"(?U)^\s*\+")
        if not variants:
            return one(F.when(plus, F.concat(F.lit("+"), bare)).otherwise(bare))
        nothing = none()
        all_ = F.concat(
            one(F.when(plus, F.concat(F.lit("+"), bare)).otherwise(bare)), F.when(plus, one(bare)).otherwise(nothing),
            F.when(plus & (F.length(bare) > 7), one(F.substring(bare, 2, 2_147_483_647))).otherwise(nothing),
            F.when(plus & (F.length(bare) > 8), one(F.substring(bare, 3, 2_147_483_647))).otherwise(nothing),
            F.when(F.startswith(bare, F.lit("0")), one(F.substring(bare, 2, 2_147_483_647))).otherwise(nothing),
        )
        return F.array_sort(F.array_distinct(all_))

    digits = lambda t: F.regexp_count(t, F.lit("[0-9]"))
    return expand(lambda t: F.when((digits(t) >= 4) & (digits(t) * 2 >= F.length(t)), forms(t)).otherwise(one(t)))


__all__ = ["inject"]
