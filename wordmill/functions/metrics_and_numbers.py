"""Text metrics, numbers and conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tokens import Filter, drop, inject, let, none, one, rewrite, string, tag
from .registry import token_filter

#: Fixed value: what a decimal number may look like.
FLOAT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
OCTET = r"\+?0*(?:25[0-5]|2[0-4]\d|1?\d?\d)"
VOWEL_RUN = "[aeiouy]+"


def number(term: Column) -> Column:
    """The term as a double, null where it is none."""
    return F.when(term.rlike(FLOAT), F.regexp_replace(term, r"^\+", "").try_cast("double"))


@token_filter()
def char_count(prefix: str = "_len:") -> Filter:
    return tag(lambda t: string(prefix, F.length(t).cast("string")), unless=prefix)


@token_filter()
def byte_length() -> Filter:
    return tag(lambda t: string("_bytes:", F.octet_length(t).cast("string")), unless="_bytes:")


@token_filter()
def length_band(short_max: int = 3, medium_max: int = 8) -> Filter:
    def band(t: Column) -> Column:
        n = F.length(t)
        return string("_length_band:", F.when(n <= short_max, "short").when(n <= medium_max, "medium").otherwise("long"))

    return tag(band, unless="_length_band:")


def syllables(term: Column) -> Column:
    low = F.lower(term)
    runs = F.regexp_count(low, F.lit(VOWEL_RUN))
    silent = low.rlike("(?s)^..*[^aeiou]e$") & (F.length(low) > 2) & (runs > 1)
    return F.when(F.length(low) == 0, 0).otherwise(F.greatest(F.lit(1), runs - F.when(silent, 1).otherwise(0)))


@token_filter()
def syllable_count() -> Filter:
    return tag(lambda t: string("_syllables:", syllables(t).cast("string")), unless="_syllables:")


def entropy_bits(term: Column) -> Column:
    """Shannon entropy of the term's bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(term, "UTF-8")), F.lit("(..)"), F.lit(1))

    def total(all_: Column) -> Column:
        n = F.size(all_).cast("double")
        part = lambda b: F.size(F.filter(all_, lambda x: x == b)) / n
        return F.aggregate(F.array_distinct(all_), F.lit(0.0), lambda s, b: s - let(part(b), lambda p: p * F.log2(p)))

    return let(pairs, lambda a: F.when(F.size(a) == 0, 0.0).otherwise(total(a)))


@token_filter()
def entropy() -> Filter:
    name = lambda e: F.when(e < 2.0, "low").when(e < 4.0, "medium").otherwise("high")
    return tag(lambda t: string("_entropy:", let(entropy_bits(t), name)), unless="_entropy:")


@token_filter()
def entropy_filter(max_entropy: float = 4.5) -> Filter:
    return drop(lambda t: entropy_bits(t) > max_entropy)


#: Code point ranges of the first letter, and what they are called.
SCRIPTS = [
    ("\\x00-\\x7f", "latin", "en"),
    ("\\u0400-\\u04ff", "cyrillic", "ru"),
    ("\\u0370-\\u03ff", "greek", "en"),
    ("\\u0600-\\u06ff", "arabic", "ar"),
    ("\\u0590-\\u05ff", "hebrew", "en"),
    ("\\u0900-\\u097f", "devanagari", "hi"),
    ("\\u4e00-\\u9fff", "cjk", "zh"),
    ("\\u3040-\\u309f", "hiragana", "ja"),
    ("\\u30a0-\\u30ff", "katakana", "ja"),
    ("\\uac00-\\ud7af", "hangul", "ko"),
    ("\\u0e00-\\u0e7f", "thai", "th"),
]


def _by_first_letter(term: Column, column: int, nothing: str, other: str) -> Column:
    first = F.regexp_extract(term, r"\p{IsAlphabetic}", 0)
    out = F.when(first == "", nothing)
    for row in SCRIPTS:
        out = out.when(first.rlike(f"^[{row[0]}]"), row[column])
    return out.otherwise(other)


@token_filter()
def script_tag() -> Filter:
    return tag(lambda t: string("_script:", _by_first_letter(t, 1, "unknown", "other")), unless="_script:")


@token_filter()
def language_tag() -> Filter:
    return tag(lambda t: string("_lang:", _by_first_letter(t, 2, "und", "en")), unless="_lang:")


@token_filter()
def uuid_detect() -> Filter:
    h = "[0-9a-fA-F-]"
    return tag(lambda t: F.lit("_type:uuid"), lambda t: t.rlike(f"^{h}{{8}}-{h}{{4}}-{h}{{4}}-{h}{{4}}-{h}{{12}}$"))


# Numbers.

ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(term: Column) -> Column:
    """Sum of the letters' values, less those before a greater one; null for other words."""
    value = lambda c: F.element_at(F.create_map(*[F.lit(x) for p in ROMAN.items() for x in p]), c)

    def total(digits: Column) -> Column:
        signed = F.transform(digits, lambda v, i: F.when(v < F.coalesce(F.get(digits, i + 1), F.lit(0)), -v).otherwise(v))
        return F.aggregate(signed, F.lit(0), lambda a, x: a + x)

    digits = F.transform(F.split(F.upper(term), ""), value)
    return F.when(F.upper(term).rlike("^[IVXLCDM]+$"), let(digits, total))


@token_filter()
def roman_numeral() -> Filter:
    return tag(lambda t: roman_value(t).cast("string"), lambda t: roman_value(t) > 0)


@token_filter()
def ordinal() -> Filter:
    return rewrite(lambda t: F.when(t.rlike("^(?i)[0-9]+(st|nd|rd|th)$"), F.regexp_extract(t, "^[0-9]+", 0)).otherwise(t))


@token_filter()
def number_norm(decimal: str = ".", thousands: str = ",") -> Filter:
    def plain(t: Column) -> Column:
        changed = F.translate(t, decimal + thousands, ".")
        return F.when(t.rlike("[0-9]") & ~F.startswith(t, F.lit("_magnitude:")), changed).otherwise(t)

    return rewrite(plain)


#: Bounds below which a number has a magnitude.
MAGNITUDES = [(1.0, "fraction"), (10.0, "ones"), (100.0, "tens"), (1e3, "hundreds"), (1e6, "thousands"), (1e9, "millions"), (1e12, "billions")]


@token_filter()
def number_magnitude() -> Filter:
    def name(t: Column) -> Column:
        n = F.abs(number(t))
        out = F.when(F.isnan(n), "trillions")
        for bound, word in MAGNITUDES:
            out = out.when(n < bound, word)
        return string("_magnitude:", out.otherwise("trillions"))

    return tag(name, lambda t: number(t).isNotNull())


def _radix(letters: str, digits: str, base: int) -> Filter:
    pattern = f"^0[{letters}]\\+?0*({digits})$"
    value = lambda t: F.conv(F.regexp_extract(t, pattern, 1), base, 10)
    return tag(lambda t: F.when(F.regexp_extract(t, pattern, 1) == "", "0").otherwise(value(t)), lambda t: t.rlike(pattern) & ~t.rlike(f"^0[{letters}]\\+?$"))


@token_filter()
def hex_to_decimal() -> Filter:
    return _radix("xX", "[0-9a-fA-F]{0,16}", 16)


@token_filter()
def binary_to_decimal() -> Filter:
    return _radix("bB", "[01]{0,64}", 2)


@token_filter()
def octal_to_decimal() -> Filter:
    return _radix("oO", "1?[0-7]{0,21}", 8)


@token_filter()
def numeric_range() -> Filter:
    ends = r"^([0-9.]+?)(-|\.\.|~)([0-9.]+)$"

    def sides(t: Column) -> Column:
        out = none()
        for sep in ("~", "\\.\\.", "-"):  # the last to be tried is looked for first
            p = f"(?s)^(.*?){sep}(.*)$"
            left, right = F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)
            fits = t.rlike(p) & left.rlike("^[0-9.]+$") & right.rlike("^[0-9.]+$")
            out = F.when(fits, F.array(left, right)).otherwise(out)
        return F.when(F.startswith(t, F.lit("_bytes:")) | ~t.rlike(ends), none()).otherwise(out)

    return inject(sides)


#: Bytes in each unit.
BYTES = {"b": 1, "kb": 2**10, "kib": 2**10, "mb": 2**20, "mib": 2**20, "gb": 2**30, "gib": 2**30, "tb": 2**40, "tib": 2**40}


@token_filter()
def file_size_norm() -> Filter:
    unit = "([kmgt]i?b|b)$"

    def size(t: Column) -> Column:
        low = F.lower(t)
        scale = F.element_at(F.create_map(*[F.lit(x) for p in BYTES.items() for x in (p[0], float(p[1]))]), F.regexp_extract(low, unit, 1))
        return F.when(low.rlike(unit), F.greatest(F.lit(0.0), number(F.regexp_replace(low, unit, "")) * scale)).cast("bigint")

    return tag(lambda t: string("_bytes:", size(t).cast("string")), lambda t: size(t).isNotNull(), unless="_seconds:")


#: Seconds in each unit.
SECONDS = {"d": 86400, "h": 3600, "m": 60, "s": 1}


@token_filter()
def duration_norm() -> Filter:
    def seconds(t: Column) -> Column:
        parts = F.regexp_extract_all(F.lower(t), F.lit(r"([0-9.]+[^0-9.])"), F.lit(1))

        def total(all_: Column) -> Column:
            each = F.transform(all_, lambda p: F.struct(number(F.regexp_replace(p, "(?s).$", "")).alias("n"), F.try_element_at(F.create_map(*[F.lit(x) for q in SECONDS.items() for x in q]), F.right(p, F.lit(1))).alias("u")))
            sum_ = F.aggregate(F.filter(each, lambda e: e["u"].isNotNull()), F.lit(0).cast("bigint"), lambda a, e: a + F.floor(e["n"] * e["u"]))
            bad = F.exists(each, lambda e: e["n"].isNull())
            return F.when(~bad & F.exists(each, lambda e: e["u"].isNotNull()), sum_)

        return let(parts, total)

    return tag(lambda t: string("_seconds:", seconds(t).cast("string")), lambda t: seconds(t).isNotNull(), unless="_pct:")


@token_filter()
def percent_norm() -> Filter:
    bare = lambda t: F.regexp_replace(t, "%$", "")
    return tag(
        lambda t: string("_pct:", bare(t)),
        lambda t: F.endswith(t, F.lit("%")) & number(bare(t)).isNotNull(),
        term=lambda t: F.format_string("%.4f", number(bare(t)) / 100.0),
    )


@token_filter()
def number_extract() -> Filter:
    plain = lambda t: F.replace(t, F.lit(","), F.lit(""))
    return tag(plain, lambda t: number(plain(t)).isNotNull() & (plain(t) != t))


__all__ = ["FLOAT", "OCTET", "entropy_bits", "number", "one", "roman_value", "syllables"]
