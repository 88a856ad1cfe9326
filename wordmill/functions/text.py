"""Text transforms, encodings and hashes of terms."""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tokens import Filter, TermFn, expand, inject, none, python_terms, rewrite
from .registry import token_filter

UP, LOW = r"\p{IsUppercase}", r"\p{IsLowercase}"


def lower_each(t: Column) -> Column:
    """Lower case character by character: no final sigma, and one character each."""
    return F.lower(F.translate(t, "İΣ", "iσ"))


@token_filter()
def lowercase() -> Filter:
    return rewrite(F.lower)


@token_filter()
def uppercase() -> Filter:
    return rewrite(F.upper)


@token_filter()
def reverse() -> Filter:
    return rewrite(F.reverse)


@token_filter()
def trim() -> Filter:
    return rewrite(lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), drop_empty=True)


@token_filter()
def truncate(length: int = 10) -> Filter:
    return rewrite(lambda t: F.left(t, F.lit(length)))


def _capital(t: Column) -> Column:
    return F.concat(F.upper(F.left(t, F.lit(1))), lower_each(F.substring(t, 2, 2_147_483_647)))


@token_filter()
def capitalization(every: bool = False) -> Filter:
    """The first letter, or that of every word within the term."""
    if not every:
        return rewrite(_capital)
    words = lambda t: F.regexp_extract_all(t, F.lit(r"((?U)\s|[^\s]+)"), F.lit(1))
    return rewrite(lambda t: F.array_join(F.transform(words(t), _capital), ""))


@token_filter()
def sentence_case() -> Filter:
    whole = lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 2_147_483_647)))
    return rewrite(lambda t: F.when(F.startswith(t, F.lit("_mention:")), t).otherwise(whole(t)))


def _joined_case(first_upper: bool) -> TermFn:
    def run(t: Column) -> Column:
        parts = F.split(t, "[_ -]", -1)
        named = F.transform(parts, lambda p, i: F.when((i > 0) | F.lit(first_upper), F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 2_147_483_647))).otherwise(F.concat(lower_each(F.left(p, F.lit(1))), F.substring(p, 2, 2_147_483_647))))
        return F.array_join(named, "")

    return run


@token_filter()
def camel_case() -> Filter:
    return rewrite(_joined_case(False))


@token_filter()
def pascal_case() -> Filter:
    return rewrite(_joined_case(True))


def _parted_case(mark: str, others: str) -> TermFn:
    return lambda t: lower_each(F.regexp_replace(F.regexp_replace(t, f"(?<={LOW})(?={UP})", mark), f"[{others}]", mark))


@token_filter()
def snake_case() -> Filter:
    return rewrite(_parted_case("_", " -"))


@token_filter()
def kebab_case() -> Filter:
    return rewrite(_parted_case("-", "_ "))


@token_filter()
def slugify() -> Filter:
    return rewrite(lambda t: F.regexp_replace(lower_each(F.regexp_replace(t, r"[^\p{IsAlphabetic}\p{N}]+", "-")), "^-+|-+$", ""))


def _split_into(pattern: str, lower: bool = True) -> TermFn:
    """Parts of a term between matches, none of them empty; no parts if there is only one."""

    def run(t: Column) -> Column:
        parts = F.filter(F.split(t, pattern, -1), lambda p: p != "")
        parts = F.transform(parts, lambda p: F.lower(p)) if lower else parts
        return F.when(F.size(parts) > 1, parts).otherwise(none())

    return run


def _split_filter(parts: TermFn, keep_original: bool) -> Filter:
    if keep_original:
        return inject(parts)
    return expand(lambda t: F.when(F.size(parts(t)) > 0, parts(t)).otherwise(F.array(t)))


@token_filter()
def camel_case_split(keep_original: bool = True) -> Filter:
    return _split_filter(_split_into("(?<=[a-z])(?=[A-Z])"), keep_original)


@token_filter()
def identifier_split(keep_original: bool = True) -> Filter:
    return _split_filter(_split_into(f"[_.-]|(?<={LOW})(?={UP})"), keep_original)


@token_filter()
def hashtag_split(keep_original: bool = True) -> Filter:
    def parts(t: Column) -> Column:
        return _split_into(f"(?<=.)(?={UP})")(F.regexp_replace(t, "^#", ""))

    if not keep_original:
        return _split_filter(parts, False)
    body = lambda t: F.lower(F.regexp_replace(t, "^#", ""))
    return inject(lambda t: F.when(F.size(parts(t)) > 0, F.concat(parts(t), F.array(body(t)))).otherwise(none()))


@token_filter()
def word_reverse() -> Filter:
    return rewrite(lambda t: F.array_join(F.transform(F.split(t, " ", -1), F.reverse), " "))


@token_filter()
def pig_latin() -> Filter:
    def run(t: Column) -> Column:
        low = F.lower(t)
        first = F.regexp_extract(low, "^[^aeiou]+(?=[aeiou])", 0)
        head = F.when(first == "", F.left(low, F.lit(1))).otherwise(first)
        moved = F.concat(F.substring(low, F.length(head) + 1, F.length(low)), head, F.lit("ay"))
        return F.when(low == "", low).when(low.rlike("^[aeiou]"), F.concat(low, F.lit("way"))).otherwise(moved)

    return rewrite(run)


@token_filter()
def repeat_char(times: int = 2) -> Filter:
    return rewrite(lambda t: F.regexp_replace(t, "(?s)(.)", "$1" * times))


@token_filter()
def collapse_repeats(max_repeats: int = 1) -> Filter:
    n = max(1, max_repeats)
    return rewrite(lambda t: F.regexp_replace(t, f"(?s)(.)\\1{{{n},}}", "$1" * n))


@token_filter()
def stretched_word_norm(max_repeat: int = 2) -> Filter:
    return rewrite(lambda t: F.regexp_replace(t, f"(?s)(.)\\1{{{max_repeat},}}", "$1" * max_repeat))


@token_filter()
def pad(min_length: int = 8, char: str = "0", left: bool = True) -> Filter:
    fill = F.lpad if left else F.rpad
    return rewrite(lambda t: F.when(F.length(t) >= min_length, t).otherwise(fill(t, min_length, char)))


@token_filter()
def partial_mask(visible_start: int = 2, visible_end: int = 2, char: str = "*") -> Filter:
    seen = visible_start + visible_end

    def run(t: Column) -> Column:
        masked = F.concat(F.left(t, F.lit(visible_start)), F.repeat(F.lit(char), F.length(t) - seen), F.right(t, F.lit(visible_end)))
        return F.when(F.length(t) <= seen, t).otherwise(masked)

    return rewrite(run)


# Encodings and hashes.


@token_filter()
def base64_encode() -> Filter:
    return rewrite(lambda t: F.regexp_replace(F.base64(F.encode(t, "UTF-8")), r"[\r\n]", ""))


def decoded_base64(term: str) -> str:
    """Padding is optional; what isn't valid stays."""
    import base64

    bare = term.rstrip("=")
    if not re.fullmatch("[A-Za-z0-9+/]*", bare):
        return term
    if len(bare) % 4 == 1:
        bare = bare[:-1]
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4)).decode()
    except ValueError:
        return term


@token_filter()
def base64_decode() -> Filter:
    return python_terms(decoded_base64)


@token_filter()
def hex_encode() -> Filter:
    return rewrite(lambda t: F.lower(F.hex(F.encode(t, "UTF-8"))))


@token_filter()
def hex_decode() -> Filter:
    def run(t: Column) -> Column:
        raw = F.unhex(F.when(t.rlike("^([0-9a-fA-F]{2})*$"), t))
        return F.coalesce(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")), t)

    return rewrite(run)


@token_filter()
def url_encode() -> Filter:
    def run(t: Column) -> Column:
        out = F.url_encode(t)
        for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            out = F.replace(out, F.lit(form), F.lit(plain))
        return out

    return rewrite(run)


def decoded_percent(term: str) -> str:
    """Broken escapes stay, and so does a term that isn't UTF-8 when decoded."""
    try:
        return urllib.parse.unquote_to_bytes(term).decode()
    except ValueError:
        return term


@token_filter()
def url_decode() -> Filter:
    return python_terms(decoded_percent)


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


@token_filter()
def rot13() -> Filter:
    plain = _ALPHABET + _ALPHABET.upper()
    turned = _ALPHABET[13:] + _ALPHABET[:13]
    return rewrite(lambda t: F.translate(t, plain, turned + turned.upper()))


def fnv1a(data: bytes, bits: int = 32, start: int | None = None) -> int:
    """FNV-1a of 32 or 64 bits; fixed values: the published offsets and primes."""
    offset, prime = {32: (0x811C9DC5, 0x01000193), 64: (14695981039346656037, 1099511628211)}[bits]
    h = offset if start is None else start
    for b in data:
        h = ((h ^ b) * prime) & ((1 << bits) - 1)
    return h


def murmur3_x86_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3, x86 32-bit, from its published definition."""
    mask = 0xFFFFFFFF

    def rotl(x: int, r: int) -> int:
        return ((x << r) | (x >> (32 - r))) & mask

    def scrambled(k: int) -> int:
        return (rotl((k * 0xCC9E2D51) & mask, 15) * 0x1B873593) & mask

    h, whole = seed, len(data) // 4 * 4
    for at in range(0, whole, 4):
        h = (rotl(h ^ scrambled(int.from_bytes(data[at : at + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= scrambled(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> shift)) * factor) & mask
    return h ^ (h >> 16)


def crc_hex(t: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(F.encode(t, "UTF-8")))), 8, "0")


@token_filter()
def fnv_hash() -> Filter:
    return python_terms(lambda t: f"{fnv1a(t.encode()):08x}")


@token_filter()
def crc32() -> Filter:
    return rewrite(crc_hex)


@token_filter()
def murmur3(seed: int = 0) -> Filter:
    return python_terms(lambda t: f"{murmur3_x86_32(t.encode(), seed):08x}")


@token_filter()
def hash_synonym(algorithm: str = "fnv1a") -> Filter:
    from ..tokens import python_expand

    if algorithm == "crc32":
        return inject(lambda t: F.array(crc_hex(t)))
    made = {"fnv1a": lambda t: f"{fnv1a(t.encode()):08x}", "murmur3": lambda t: f"{murmur3_x86_32(t.encode()):08x}"}[algorithm]
    return python_expand(lambda t: [t, made(t)])


@token_filter()
def minhash(hash_count: int = 1, bucket_count: int = 512) -> Filter:
    """Bucket ids of each term, one for each of hash_count seeds."""
    from ..tokens import python_expand

    starts = [(14695981039346656037 + i * 6364136223846793005) % (1 << 64) for i in range(max(1, hash_count))]
    return python_expand(lambda t: [f"{fnv1a(t.encode(), 64, s) % max(1, bucket_count):016x}" for s in starts])
