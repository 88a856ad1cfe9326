"""Web, network and geography; security and privacy; extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tokens import Filter, TermFn, drop, expand, inject, let, none, python_terms, rewrite, string, tag
from .metrics_and_numbers import OCTET, number
from .registry import token_filter

#: Patterns whose matches are the results.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
URL = r"https?://[^\s<>\[\]{}|\\^`]+"
IPV4 = r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
PHONE = r"[\+]?[(]?[0-9]{1,4}[)]?[-\s./0-9]{6,}"
SHORT_PHONE = r"(?U)\d{3}[-.]?\d{3}[-.]?\d{4}"
MONEY_SIGNS = "$€£¥₹₽₿"
MONEY = rf"(?U)[{MONEY_SIGNS}]\s*\d[\d,]*\.?\d*|\d[\d,]*\.?\d*\s*[{MONEY_SIGNS}]"
SQL_INJECTION = (
    r"(?i)(union\s+select|drop\s+table|insert\s+into|delete\s+from)",
    r"(?i)(or\s+1\s*=\s*1|and\s+1\s*=\s*1|'\s*or\s*')",
    r"(?i)(exec\s*\(|execute\s|xp_cmdshell)",
    r"(--|;)\s*(drop|alter|create|truncate)",
)
XSS = (r"(?i)<script[\s>]", r"(?i)javascript\s*:", r"(?i)on(load|error|click|mouse)\s*=", r"(?i)<iframe[\s>]", r"(?i)eval\s*\(")

_ALL = F.lit
FOUR_OCTETS = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def matches(term: Column, pattern: str) -> Column:
    return F.regexp_extract_all(term, F.lit(f"({pattern})"), F.lit(1))


def after(term: Column, mark: str) -> Column:
    """What follows the first mark."""
    return F.substring(term, F.locate(mark, term) + len(mark), F.length(term))


# Extraction.


@token_filter()
def email_extract() -> Filter:
    return inject(lambda t: matches(t, EMAIL))


@token_filter()
def url_extract() -> Filter:
    return inject(lambda t: matches(t, URL))


@token_filter()
def ip_extract() -> Filter:
    return inject(lambda t: F.filter(matches(t, IPV4), lambda x: x.rlike(FOUR_OCTETS)))


@token_filter()
def phone_extract() -> Filter:
    return inject(lambda t: matches(t, PHONE))


@token_filter()
def hashtag_extract(keep_hash: bool = False) -> Filter:
    return rewrite(lambda t: t if keep_hash else F.regexp_replace(t, "(?s)^#(?=.)", ""))


@token_filter()
def mention_extract(keep_at: bool = False) -> Filter:
    return rewrite(lambda t: t if keep_at else F.regexp_replace(t, "(?s)^@(?=.)", ""))


@token_filter()
def currency_extract() -> Filter:
    signs, amount = f"[^{MONEY_SIGNS}]", "[^0-9.]"
    return tag(lambda t: string("_currency:", F.regexp_replace(t, signs, ""), ":", F.regexp_replace(t, amount, "")), lambda t: t.rlike(MONEY))


@token_filter()
def email_domain() -> Filter:
    return tag(lambda t: after(t, "@"), lambda t: F.contains(t, F.lit("@")) & (after(t, "@") != ""))


# Web, network and geography.


def _host(t: Column) -> Column:
    return F.regexp_extract(F.when(F.contains(t, F.lit("://")), after(t, "://")).otherwise(t), "^[^/]*", 0)


@token_filter()
def domain_extract(include_subdomain: bool = False) -> Filter:
    def run(t: Column) -> Column:
        host = F.regexp_extract(_host(t), "^[^:?]*", 0)
        host = F.regexp_extract(host, "^[^?]*", 0)
        return host if include_subdomain else F.substring_index(host, ".", -2)

    return rewrite(run)


@token_filter()
def tld_extract() -> Filter:
    host = lambda t: F.regexp_extract(_host(t), "^[^:]*", 0)
    return tag(lambda t: string("_tld:", F.substring_index(host(t), ".", -1)), lambda t: F.contains(host(t), F.lit(".")))


@token_filter()
def url_scheme() -> Filter:
    return tag(lambda t: string("_scheme:", F.substring_index(t, "://", 1)), lambda t: F.contains(t, F.lit("://")))


@token_filter()
def url_path() -> Filter:
    def segments(t: Column) -> Column:
        rest = F.when(F.contains(t, F.lit("://")), F.regexp_extract(after(t, "://"), "(?s)/.*$", 0)).when(F.startswith(t, F.lit("/")), t).otherwise("")
        return F.filter(F.split(F.substring_index(rest, "?", 1), "/", -1), lambda x: x != "")

    return inject(segments)


def _octets(t: Column, form: TermFn, sep: str = ".") -> Column:
    return F.array_join(F.transform(F.split(t, r"\.", -1), form), sep)


@token_filter()
def ip_normalization() -> Filter:
    return rewrite(lambda t: F.when(t.rlike(FOUR_OCTETS), _octets(t, lambda p: F.lpad(F.regexp_replace(p, r"^\+?0*(?=\d)", ""), 3, "0"))).otherwise(t))


@token_filter()
def ip_to_numeric() -> Filter:
    def value(t: Column) -> Column:
        parts = F.transform(F.split(t, r"\.", -1), lambda p: F.regexp_replace(p, r"^\+", "").try_cast("bigint"))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)

    return tag(lambda t: value(t).cast("string"), lambda t: t.rlike(FOUR_OCTETS))


@token_filter()
def ip_classify() -> Filter:
    """By the first two octets alone."""

    def name(t: Column) -> Column:
        part = lambda k: F.regexp_replace(F.get(F.split(t, r"\.", -1), F.lit(k)), r"^\+", "").try_cast("int")
        a, b = part(0), part(1)
        out = F.when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private").when(a == 127, "loopback")
        out = out.when((a == 169) & (b == 254), "link_local").when(a.between(224, 239), "multicast").when(a == 0, "unspecified")
        return string("_ip_class:", out.when((a == 255) & (b == 255), "broadcast").otherwise("public"))

    return tag(name, lambda t: t.rlike(rf"(?s)^{OCTET}\.{OCTET}\.[^.]*\.[^.]*$"))


GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed value: the published alphabet


def geohash_of(lat: float, lng: float, precision: int) -> str:
    """Alternating halvings of longitude and latitude, five bits to a digit."""
    bounds, value = [[-180.0, 180.0], [-90.0, 90.0]], 0
    for k in range(5 * precision):
        half, x = bounds[k % 2], (lng, lat)[k % 2]
        middle = (half[0] + half[1]) / 2
        above = x >= middle
        half[not above] = middle
        value = 2 * value + above
    return "".join(GEOHASH_DIGITS[value >> 5 * (precision - 1 - k) & 31] for k in range(precision))


@token_filter()
def geohash(precision: int = 6) -> Filter:
    import re

    from .metrics_and_numbers import FLOAT

    pattern = FLOAT.replace("(?i:inf|infinity|nan)", "0")

    def run(term: str) -> str:
        parts = [p.strip() for p in term.split(",")]
        if len(parts) != 2 or not all(re.match(pattern, p) for p in parts):
            return term
        lat, lng = map(float, parts)
        return geohash_of(lat, lng, precision) if -90 <= lat <= 90 and -180 <= lng <= 180 else term

    return python_terms(run)


@token_filter()
def geohash_prefix(min_precision: int = 2, max_precision: int = 6) -> Filter:
    def prefixes(t: Column) -> Column:
        fits = (F.length(t) >= max_precision) & (F.length(t) > min_precision) & t.rlike(f"^[{GEOHASH_DIGITS}]*$")
        return F.when(fits, F.transform(F.sequence(F.lit(min_precision), F.length(t) - 1), lambda n: F.left(t, n))).otherwise(none())

    return inject(prefixes)


@token_filter()
def url_normalization(remove_www: bool = True, remove_trailing_slash: bool = True, remove_fragment: bool = True) -> Filter:
    def run(t: Column) -> Column:
        out = F.substring_index(t, "#", 1) if remove_fragment else t
        start = F.regexp_extract(out, "(?s)^.*?://[^/]*", 0)
        out = F.concat(F.lower(start), F.substring(out, F.length(start) + 1, F.length(out)))
        out = F.replace(out, F.lit("://www."), F.lit("://")) if remove_www else out
        many = F.endswith(out, F.lit("/")) & (F.regexp_count(out, F.lit("/")) > 3)
        return F.when(many, F.regexp_replace(out, "/$", "")).otherwise(out) if remove_trailing_slash else out

    return rewrite(run)


# Security and privacy.


def _first_seen(s: Column, char: str) -> Column:
    return F.concat(F.left(s, F.lit(1)), F.repeat(F.lit(char), F.greatest(F.length(s) - 1, F.lit(0))))


@token_filter()
def email_mask(char: str = "*") -> Filter:
    def run(t: Column) -> Column:
        local, domain = F.substring_index(t, "@", 1), after(t, "@")
        label = F.substring_index(domain, ".", 1)
        hidden = F.when(F.contains(domain, F.lit(".")), F.concat(_first_seen(label, char), F.substring(domain, F.length(label) + 1, F.length(domain)))).otherwise(domain)
        return F.when(F.contains(t, F.lit("@")), F.concat(_first_seen(local, char), F.lit("@"), hidden)).otherwise(t)

    return rewrite(run)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


@token_filter()
def credit_card_mask(char: str = "*", visible_start: int = 4, visible_end: int = 4) -> Filter:
    def run(t: Column) -> Column:
        def masked(d: Column) -> Column:
            card = F.concat(F.left(d, F.lit(visible_start)), F.repeat(F.lit(char), F.length(d) - visible_start - visible_end), F.right(d, F.lit(visible_end)))
            return F.when(F.length(d).between(13, 19) & F.call_function("luhn_check", d), card).otherwise(t)

        return let(_digits(t), masked)

    return rewrite(run)


@token_filter()
def phone_mask(char: str = "*", visible: int = 4) -> Filter:
    hidden = lambda d: F.concat(F.repeat(F.lit(char), F.length(d) - visible), F.right(d, F.lit(visible)))
    return rewrite(lambda t: let(_digits(t), lambda d: F.when(F.length(d) >= 7, hidden(d)).otherwise(t)))


@token_filter()
def ip_mask(octets_visible: int = 2) -> Filter:
    hidden = lambda t: F.array_join(F.transform(F.split(t, r"\.", -1), lambda p, i: F.when(i < octets_visible, p).otherwise("xxx")), ".")
    return rewrite(lambda t: F.when(t.rlike(FOUR_OCTETS), hidden(t)).otherwise(t))


@token_filter()
def ssn_mask() -> Filter:
    return rewrite(lambda t: F.when(t.rlike(r"(?U)\d{3}-\d{2}-\d{4}"), F.concat(F.lit("***-**-"), F.right(t, F.lit(4)))).otherwise(t))


def any_of(term: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | term.rlike(p)
    return out


@token_filter()
def redact(patterns: tuple[str, ...] = ()) -> Filter:
    return drop(lambda t: any_of(t, patterns))


def redact_emails_and_phones() -> Filter:
    return redact((EMAIL, SHORT_PHONE))


def _threat(name: str, found: TermFn) -> Filter:
    """The tag takes the token's place."""
    return expand(lambda t: F.array(F.when(found(t), F.lit(f"_threat:{name}")).otherwise(t)))


@token_filter()
def sql_injection_detect() -> Filter:
    return _threat("sql_injection", lambda t: any_of(t, SQL_INJECTION))


@token_filter()
def xss_detect() -> Filter:
    return _threat("xss", lambda t: any_of(t, XSS))


@token_filter()
def path_traversal_detect() -> Filter:
    return _threat("path_traversal", lambda t: F.contains(t, F.lit("../")) | F.contains(t, F.lit("..\\")) | F.contains(t, F.lit("%2e%2e")))


# Code, logs and science.

#: Words and levels that get a tag.
PROGRAMMING_WORDS = """
if else for while return function class import export const let var fn pub struct enum impl trait use mod match async await try catch throw
new delete typeof instanceof interface type void null undefined true false self super this
""".split()
LOG_LEVELS = {"fatal": "FATAL CRITICAL CRIT", "error": "ERROR ERR", "warn": "WARN WARNING", "info": "INFO", "debug": "DEBUG DBG", "trace": "TRACE TRC"}
HTTP_CLASSES = {1: "informational", 2: "success", 3: "redirect", 4: "client_error", 5: "server_error"}


@token_filter()
def programming_keyword() -> Filter:
    return tag(lambda t: F.lit("_type:keyword"), lambda t: t.isin(*PROGRAMMING_WORDS))


@token_filter()
def log_level() -> Filter:
    def level(t: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, words in LOG_LEVELS.items():
            out = out.when(F.upper(t).isin(*words.split()), f"_log_level:{name}")
        return out

    return tag(level, lambda t: level(t).isNotNull())


@token_filter()
def key_value_pair(separator: str = "=") -> Filter:
    key, value = lambda t: F.substring_index(t, separator, 1), lambda t: after(t, separator)
    return inject(lambda t: F.when(F.contains(t, F.lit(separator)) & (key(t) != "") & (value(t) != ""), F.array(string("_key:", key(t)), string("_val:", value(t)))).otherwise(none()))


@token_filter()
def semver() -> Filter:
    """Two to four parts of letters, digits and hyphens; a leading v goes."""
    bare = lambda t: F.regexp_replace(t, "^v", "")
    fits = lambda t: bare(t).rlike(r"^[\p{IsAlphabetic}\p{N}-]*(\.[\p{IsAlphabetic}\p{N}-]*){1,3}$")
    part = lambda t, k: F.get(F.split(bare(t), r"\.", -1), F.lit(k))
    return expand(lambda t: F.when(fits(t), F.array(bare(t), string("_major:", part(t, 0)), string("_minor:", part(t, 1)))).otherwise(F.array(t)))


@token_filter()
def http_status() -> Filter:
    pattern = r"^\+?0*([1-5])\d\d$"

    def name(t: Column) -> Column:
        out = F.when(F.lit(False), "")
        for first, word in HTTP_CLASSES.items():
            out = out.when(F.regexp_extract(t, pattern, 1) == str(first), f"_http:{word}")
        return out

    return tag(name, lambda t: t.rlike(pattern))


@token_filter()
def error_code() -> Filter:
    return tag(lambda t: F.lit("_type:error_code"), lambda t: t.rlike("^[A-Z][A-Z0-9_]*[0-9]+$|^[A-Z]{1,5}[-_][0-9]+$"))


@token_filter()
def ansi_strip() -> Filter:
    return rewrite(lambda t: F.regexp_replace(t, "\\x1b\\[[0-9;]*[a-zA-Z]", ""))


@token_filter()
def isbn_norm() -> Filter:
    bare = lambda t: F.regexp_replace(t, "[^0-9Xx]", "")
    return tag(lambda t: F.lit("_type:isbn"), lambda t: F.length(bare(t)).isin(10, 13), term=bare)


@token_filter()
def doi_norm() -> Filter:
    prefix = "^(doi:|https://doi.org/)"
    own = lambda t: F.startswith(t, F.lit("10.")) & F.contains(t, F.lit("/"))
    return tag(lambda t: F.lit("_type:doi"), lambda t: own(t) | t.rlike(prefix), term=lambda t: F.lower(F.regexp_replace(t, prefix, "")))


@token_filter()
def file_extension() -> Filter:
    ext = lambda t: F.regexp_extract(t, r"(?s)\.([\p{IsAlphabetic}\p{N}]+)$", 1)
    return tag(lambda t: string("_ext:", F.lower(ext(t))), lambda t: (ext(t) != "") & (F.octet_length(ext(t)) <= 10))


@token_filter()
def path_component() -> Filter:
    parts = lambda t: F.filter(F.split(t, r"[/\\]", -1), lambda p: p != "")
    return inject(lambda t: F.when(t.rlike(r"[/\\]") & (F.size(parts(t)) > 1), parts(t)).otherwise(none()))


__all__ = ["number"]
