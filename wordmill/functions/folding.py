"""Character folding and language normalization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tokens import Filter, TermFn, drop, expand, inject, none, python_terms, rewrite, token
from .registry import token_filter
from .text import lower_each


def steps(*rules: tuple[str, str]) -> TermFn:
    """Patterns replaced one after another."""

    def run(t: Column) -> Column:
        for pattern, replacement in rules:
            t = F.regexp_replace(t, pattern, replacement)
        return t

    return run


def mapped(source: str, target: str, removed: str = "") -> TermFn:
    """Characters replaced one by one; removed ones go."""
    return lambda t: F.translate(t, source + removed, target)


@token_filter()
def apostrophe() -> Filter:
    """Cut at the first ASCII apostrophe, else at the first U+2019; a leading one removes the token."""
    ascii_, curly = F.lit("'"), F.lit("’")
    return rewrite(lambda t: F.when(F.contains(t, ascii_), F.substring_index(t, "'", 1)).when(F.contains(t, curly), F.substring_index(t, "’", 1)).otherwise(t), drop_empty=True)


@token_filter()
def classic() -> Filter:
    def terms(t: Column) -> Column:
        bare = F.regexp_replace(t, "['’][sS]$", "")
        acronym = t.rlike(r"^[\p{IsAlphabetic}.]*$") & F.contains(t, F.lit(".")) & (F.octet_length(t) >= 3)
        out = F.when(bare != t, bare).when(acronym, F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
        return F.when((out == "") & (t != ""), none()).otherwise(F.array(out))

    return expand(terms)


HARAKAT = "".join(map(chr, range(0x064B, 0x0653)))
TATWEEL = "ـ"


@token_filter()
def arabic_normalization() -> Filter:
    return rewrite(mapped("آأإىة", "ااايه", TATWEEL + HARAKAT))


@token_filter()
def persian_normalization(strict: bool = False) -> Filter:
    more = "" if strict else TATWEEL + HARAKAT
    return rewrite(mapped("یےکۀہ", "ييكهه", "ٔ" + more))


@token_filter()
def sorani_normalization() -> Filter:
    heh = steps("ه‌", "ە"), ("ه$", "ە")

    def run(t: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(t, *("ه‌", "ە")), *heh[1])
        return F.translate(t, "يىكھة" + TATWEEL + HARAKAT + "‌", "ییکهە")

    return rewrite(run)


@token_filter()
def bengali_normalization() -> Filter:
    return rewrite(mapped("ঁড়ঢ়য়ৈৌৡৣ", "ংডঢযেোৠৢ", "়"))


#: Devanagari letters and signs and what they fold to.
HINDI_FROM = "ँऩऱऴक़ख़ग़ज़ड़ढ़फ़य़ऍऎऑऒॲआईऊॠॡऐऔॅॆॉॊीूॄॣैौ"
HINDI_TO = "ंनरळकखगजडढफयएएओओअअइउऋऌएओेेोोिुृॢेो"


@token_filter()
def hindi_normalization() -> Filter:
    """NA (also one folded from NNNA) with virama becomes anusvara; other viramas go."""
    skip = "[़‌‍]*"
    virama = steps((f"[नऩ]{skip}्", "ं"), ("[़‌‍्]", ""))
    return rewrite(lambda t: F.translate(virama(t), HINDI_FROM, HINDI_TO))


#: First code points of the decimal digit blocks.
DIGIT_BLOCKS = """
0660 06F0 07C0 0966 09E6 0A66 0AE6 0B66 0BE6 0C66 0CE6 0D66 0DE6 0E50 0ED0 0F20 1040 1090 17E0 1810 1946 19D0 1A80 1A90 1B50 1BB0 1C40 1C50
A620 A8D0 A900 A9D0 A9F0 AA50 ABF0 FF10
""".split()


@token_filter()
def decimal_digit() -> Filter:
    source = "".join(chr(int(b, 16) + k) for b in DIGIT_BLOCKS for k in range(10))
    return rewrite(lambda t: F.when(t.rlike(r"[^\x00-\x7f]"), F.translate(t, source, "0123456789" * len(DIGIT_BLOCKS))).otherwise(t))


ELISIONS = {
    "french": "l m t qu n s j d c jusqu quoiqu lorsqu puisqu",
    "italian": "c l all dall dell nell sull coll pell gl agl dagl degl negl sugl un m t s v d",
    "catalan": "d l m n s t",
}  # fixed values: articles before an apostrophe


@token_filter()
def elision(articles: str | list[str] = "l d qu m n s t") -> Filter:
    """A leading article and its apostrophe go; start_offset moves past them."""
    words = ELISIONS.get(articles, articles) if isinstance(articles, str) else articles
    words = words.replace(",", " ").split() if isinstance(words, str) else words

    def one(t: Column) -> Column:
        head = F.regexp_extract(t["term"], "(?s)^[^'’]*['’](?=.)", 0)
        article = F.lower(F.regexp_replace(head, "['’]$", ""))
        cut = token(F.substring(t["term"], F.length(head) + 1, F.length(t["term"])), t["start_offset"] + F.octet_length(head), t["end_offset"], t["position"])
        return F.when((head != "") & article.isin(*words), cut).otherwise(t)

    return lambda tokens: F.transform(tokens, one)


@token_filter()
def german_normalization() -> Filter:
    """Umlauts to their vowels; e goes after a and o, and after u unless a vowel or q stands before it."""
    digraph = steps(("([ao])e|(?<![aeiouyqäöü])(u)e", "$1$2"), ("ß", "ss"))
    return rewrite(lambda t: F.translate(digraph(t), "äöü", "aou"))


@token_filter()
def greek_lowercase() -> Filter:
    accented = "ςΆάΈέΉήΊΪίϊΐΎΫύϋΰΌόΏώ"
    return rewrite(lambda t: lower_each(F.translate(t, accented, "σααεεηηιιιιιυυυυυοοωω")))


@token_filter()
def turkish_lowercase() -> Filter:
    return rewrite(lambda t: lower_each(F.translate(F.replace(t, F.lit("İ"), F.lit("i")), "İ", "ı")))


@token_filter()
def irish_elision() -> Filter:
    return rewrite(lambda t: F.when(F.length(t) < 3, t).otherwise(F.regexp_replace(t, "^([dDmMbB]'|[nth]-)", "")))


@token_filter()
def irish_lowercase() -> Filter:
    """Eclipsed capitals keep their eclipsis as they are lowered."""
    return rewrite(F.lower)


def _pairs(*rules: tuple[str, str, str, str]) -> TermFn:
    """(first letters, second letters, lower result, upper result): marks pairs from
    left to right, then names the marked letters."""

    def run(t: Column) -> Column:
        for k, (first, second, _, _) in enumerate(rules):
            t = F.regexp_replace(t, f"([{first}])[{second}]", f"$1{chr(0xE000 + k)}")
        for k, (first, _, low, up) in enumerate(rules):
            for letter in first:
                t = F.replace(t, F.lit(letter + chr(0xE000 + k)), F.lit(up if letter.isupper() else low))
        return t

    return run


@token_filter()
def norwegian_normalization() -> Filter:
    pairs = _pairs(("aA", "aA", "å", "Å"))
    return rewrite(lambda t: F.translate(pairs(t), "äÄöÖ", "æÆøØ"))


@token_filter()
def scandinavian_normalization() -> Filter:
    pairs = _pairs(("aA", "aAoO", "å", "Å"), ("aA", "eE", "æ", "Æ"), ("oO", "eEoO", "ø", "Ø"))
    return rewrite(lambda t: F.translate(pairs(t), "äÄöÖ", "æÆøØ"))


@token_filter()
def scandinavian_folding() -> Filter:
    pairs = _pairs(("aA", "aAeEoO", "a", "A"), ("oO", "eEoO", "o", "O"))
    return rewrite(lambda t: F.translate(pairs(t), "åäæÅÄÆøöØÖ", "aaaAAAooOO"))


@token_filter()
def romanian_normalization() -> Filter:
    return rewrite(mapped("ŞşŢţ", "ȘșȚț"))


@token_filter()
def russian_yo_normalization() -> Filter:
    return rewrite(mapped("ёЁ", "еЕ"))


SERBIAN_LETTERS = "абвгдежзијклмнопрстћуфхцчш"  # fixed values: those that stand for one letter
SERBIAN_PLAIN, SERBIAN_MARKED = "abvgdezzijklmnoprstcufhccs", "abvgdežzijklmnoprstćufhcčš"


@token_filter()
def serbian_normalization() -> Filter:
    """Cyrillic and letters with marks to plain ASCII letters."""
    double = {"ђ": "dj", "љ": "lj", "њ": "nj", "џ": "dz", "đ": "dj"}

    def run(t: Column) -> Column:
        for letter, two in double.items():
            t = F.replace(F.replace(t, F.lit(letter), F.lit(two)), F.lit(letter.upper()), F.lit(two.capitalize()))
        source, target = SERBIAN_LETTERS + "žčćš", SERBIAN_PLAIN + "zccs"
        return F.translate(t, source + source.upper(), target + target.upper())

    return rewrite(run)


@token_filter()
def serbian_normalization_regular() -> Filter:
    """Cyrillic to Latin letters with their marks, one for one."""
    source, target = SERBIAN_LETTERS + "ђљњџі", SERBIAN_MARKED + "đlndi"
    return rewrite(mapped(source + source.upper(), target + target.upper()))


def _fold(term: str) -> str:
    from .ascii_table import fold

    return fold(term)


@token_filter("asciifolding")
def ascii_folding(preserve_original: bool = False) -> Filter:
    from ..tokens import python_expand

    if preserve_original:
        return python_expand(lambda t: [t] if (f := _fold(t)) == t else [t, f])
    return python_terms(_fold)


@token_filter()
def cjk_width() -> Filter:
    """Full-width ASCII to ASCII, half-width katakana to full width, with voicing marks joined."""
    return python_terms(folded_width)


#: What the half-width forms from U+FF65 on stand for.
KATAKANA = "・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゙゚"


def folded_width(term: str) -> str:
    out: list[str] = []
    joins = "ウカキクケコサシスセソタチツテトハヒフヘホ"
    for c in term:
        code = ord(c)
        if 0xFF01 <= code <= 0xFF5E:
            out.append(chr(code - 0xFEE0))
        elif 0xFF65 <= code <= 0xFF9F:
            wide = KATAKANA[code - 0xFF65]
            before = out[-1] if out else ""
            if wide == "゙" and before in joins and before and out[-1] != "":
                out[-1] = "ヴ" if before == "ウ" else chr(ord(before) + 1)
            elif wide == "゚" and before and before in "ハヒフヘホ":
                out[-1] = chr(ord(before) + 2)
            else:
                out.append(wide)
        else:
            out.append(c)
    return "".join(out)


__all__ = ["drop", "inject", "mapped", "steps"]
