"""Stemmers as suffix rules: each is a few steps, each step at most one rule.

A step is a list of (more_than, pattern, replacement): the first rule whose
pattern ends the term, where the term has more characters than more_than, is
applied. Steps compile to one CASE expression each, so a stemmer stays a column
expression. Lengths are characters, for every language.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tokens import Filter, TermFn, let, python_expand, python_terms, rewrite
from .registry import FILTERS, token_filter

Step = list[tuple[int, str, str]]

#: Name -> (steps, least): the rules of a stemmer as ANSI expressions over {t}, for engines other than Spark.
SQL: dict[str, tuple[list[str], int]] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _told(fn: TermFn, *steps: str) -> TermFn:
    """fn, which also knows its rules as SQL; patterns that look around have none."""
    if not any("(?<" in s for s in steps):
        fn.sql = list(steps)
    return fn


def step(*rules: tuple[int, str, str], start: bool = False) -> TermFn:
    """The first rule that fits; patterns stand at the end, or at the start, of the term."""

    def run(t: Column) -> Column:
        out = None
        for more, pattern, replacement in rules:
            anchored = f"^(?:{pattern})" if start else f"(?:{pattern})$"
            fits = (F.length(t) > more) & t.rlike(anchored)
            value = F.regexp_replace(t, anchored, replacement)
            out = F.when(fits, value) if out is None else out.when(fits, value)
        return out.otherwise(t)

    cases = []
    for more, pattern, replacement in rules:
        anchored = _quoted(f"^(?:{pattern})" if start else f"(?:{pattern})$").replace("{", "{{").replace("}", "}}")
        cases.append(f"when length({{t}}) > {more} and regexp_matches({{t}}, {anchored}) then regexp_replace({{t}}, {anchored}, {_quoted(re.sub(r'[$]([0-9])', r'\\\1', replacement))})")
    return _told(run, f"case {' '.join(cases)} else {{t}} end")


def endings(*groups: tuple[int, str]) -> TermFn:
    """Steps that only strip: (more_than, endings of one length)."""

    def run(t: Column) -> Column:
        out = None
        for more, words in groups:
            found = words.split()
            n = len(found[0])
            assert all(len(w) == n for w in found), found
            fits, value = (F.length(t) > more) & F.right(t, F.lit(n)).isin(*found), F.left(t, F.length(t) - n)
            out = F.when(fits, value) if out is None else out.when(fits, value)
        return out.otherwise(t)

    cases = [f"when length({{t}}) > {more} and right({{t}}, {len(words.split()[0])}) in ({', '.join(map(_quoted, words.split()))}) then left({{t}}, length({{t}}) - {len(words.split()[0])})" for more, words in groups]
    return _told(run, f"case {' '.join(cases)} else {{t}} end")


def in_turn(*parts: TermFn) -> TermFn:
    """One step after another, each computed once."""

    def run(t: Column) -> Column:
        if not parts:
            return t
        return let(parts[0](t), in_turn(*parts[1:])) if len(parts) > 1 else parts[0](t)

    if all(hasattr(p, "sql") for p in parts):
        run.sql = [s for p in parts for s in p.sql]
    return run


def stemmer(name: str, fn: TermFn, least: int = 0) -> None:
    """Register name_stem-like filters; terms of fewer characters than least stay."""

    def make() -> Filter:
        return rewrite(lambda t: F.when(F.length(t) < least, t).otherwise(fn(t)) if least else fn(t))

    make.__name__ = name
    token_filter(name)(make)
    if hasattr(fn, "sql"):
        SQL[name] = fn.sql, least


def translated(old: str, new: str) -> TermFn:
    return _told(lambda t: F.translate(t, old, new), f"translate({{t}}, '{old}', '{new}')")


# Fixed values in all rules below: the endings, what replaces them and the lengths that they need.

stemmer("polish_stem", endings(
    (7, "ności ością ienie aniem ający"), (6, "ości nych iego owej owym anie enie eniu aniu iach kami"),
    (5, "ach ami emu owi ych ego nej nym cie arz nik iem ość"), (4, "ie ej em ze ię ek ce mi ka ki ko ny na ne om ów"), (3, "a e i o u y ę ą"),
), 4)
stemmer("ukrainian_stem", endings(
    (7, "ність ності"), (6, "ного ному ення ання ство ості ість"), (5, "ого ому ові ами ять ати ити ють ені ані"),
    (4, "ів ок ки ко ці ти ні на ну не но ем ій ям ях"), (3, "а е и і о у я ю ь"),
), 4)
stemmer("armenian_stem", endings((7, "ներին ներից ներով"), (6, "ների ները ովին ությ"), (5, "ներ ովը իցը ում"), (4, "ին ով ից ոմ եր ըն"), (3, "ա ե ի ո ւ")), 4)
stemmer("croatian_stem", endings(
    (7, "ovski evski inski"), (6, "enog skog skom skih skim anje enje anja enja osti ista iste isti"),
    (5, "ama ima oga ome omu ost nju nje nog nom noj nih nim eni ani ati iti uju aje uje ije ica ice ici"),
    (4, "om og im ih em oj an in en ni na no ti ju ci ka ke ki ko ku"), (3, "a e i o u"),
), 4)
stemmer("lithuanian_stem", endings(
    (7, "acija imams iamas"), (6, "amas imas umas iais omis amis ėmis iaus"),
    (5, "ams oms ėms ius aus oje ėje yje ais iam imi umu umi ame ėse ose yse ies ens ėti oti yti ati iti"),
    (4, "as is us ys os ės ai ei ui am om im um ėm ti"), (3, "a ą e ę ė i į o u ų ū y"),
), 4)
stemmer("swedish_stem", endings(
    (7, "elser ernas arnas ornas andes arens andet"), (6, "else arne erna orna ande aren arna ades ings"),
    (5, "are ast ade ing arn ens het igt lig els iga"), (4, "ar er or en et an ad as at ig al"), (3, "a e s t"),
), 4)
stemmer("estonian_stem", endings(
    (6, "mine mise line lise tele teks tena test tega"), (5, "sse ste sta des tes tel tud nud dud lik"),
    (4, "le lt ks st na ga ta te de se id il is"), (3, "d e i s t"),
), 4)
stemmer("slovak_stem", endings((6, "osti enie anie ovia"), (5, "ách ami iam ích ému ého ých ými kov"), (4, "om ov ou em mi ám ím ej ým"), (3, "a e i o u y á é í ó ú ý")), 4)
stemmer("slovenian_stem", endings((6, "nost stvo anje enje"), (5, "ama ami oma ega emu imi ost ati iti ejo"), (4, "om em ih im ov ev mi ah am je ni na no"), (3, "a e i o u")), 4)
stemmer("finnish_light_stem", endings(
    (7, "tten nnen"), (6, "ssa ssä sta stä lla llä lta ltä lle tta ttä ksi ine"), (5, "na nä en in an ön on ät öt it et ia iä ta tä ja jä"), (4, "a ä n t i e"),
), 4)
stemmer("hungarian_light_stem", endings(
    (7, "akat eket oket okat ünök anok enök änak énak"), (5, "ban ben nak nek ból ből hoz hez höz ról ről tól től val vel ért vál vél"),
    (5, "at et ot öt ra re ba be on en ön ul ül ig ek ok ök ak ás és"), (4, "á é a e k t"),
), 4)
stemmer("norwegian_light_stem", endings((5, "ene ede ane het ert"), (4, "er en et ar as es eg"), (3, "a e s")), 4)
stemmer("bengali_stem", endings((5, "গুলি গুলো েদের"), (4, "গুল েরা দের কের"), (3, "ের তে কে রা তা না সে"), (2, "া ি ী ু ূ ে ৈ ো ৌ ্")), 4)
stemmer("hindi_stem", endings(
    (6, "ाइयाँ ाइयां ाइयों ाऊंगा ाऊंगी ाएंगी ाएंगे"),
    (5, "एंगी एंगे ताएं ताओं नाएं नाओं ाएगा ाएगी ाओगी ाओगे ातीं ियाँ ियां ियों ूंगा ूंगी ेंगी ेंगे"),
    (4, "तीं ाइए ाईं ाएं ाओं ाकर ाता ाती ाते ाना ाने ाया ुआं ुएं ुओं ेगा ेगी ोगी ोगे"),
    (3, "कर ता ती ते ना नी ने ाँ ां ाई ाए ाओ िए ीं ें ों"), (2, "ा ि ी ु ू े ो"),
), 3)
stemmer("persian_stem", endings((5, "ترین هایی"), (4, "های تری اتی انی"), (3, "ها ان ات تر ین یی"), (3, "ی ه ا")), 4)

FOLD = ("àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii")


def _folded(more: str = "", to: str = "") -> TermFn:
    return translated(FOLD[0] + more, FOLD[1] + to)


stemmer("spanish_light_stem", in_turn(_folded(), step((0, "[oae]", ""), (0, "eses", "es"), (0, "ces", "z"), (0, "[oae]s", ""))), 5)
stemmer("italian_light_stem", in_turn(_folded(), step((0, "[ih][ei]", ""), (0, "i[ao]", ""), (0, "[eiao]", ""))), 6)
stemmer("portuguese_light_stem", in_turn(
    step((4, "([rslz])es", "$1"), (3, "ns", "m"), (4, "[eé]is", "el"), (4, "ais", "al"), (4, "óis", "ol"), (4, "is", "il"), (3, "[õã]es", "ão"), (6, "mente", ""), (3, "s", "")),
    step((7, "inha", "inho"), (7, "iaca", "iaco"), (7, "eira", "eiro"), (6, "(os|ic|id|ad|iv|am)a", "$1o"), (6, "ona", "ão"), (6, "ora", "or"), (6, "esa", "ês"), (6, "na", "no")),
    step((4, "[eao]", "")), _folded("ãõç", "aoc"),
), 4)
stemmer("russian_light_stem", in_turn(
    endings((6, "иями оями"), (5, "иям иях оях ями оям оьв ами его ему ери ими ого ому ыми оев"),
            (4, "ая яя ях юю ах ею их ия ию ьв ою ую ям ых ея ам ем ей ём ев ий им ое ой ом ов ые ый ым ми"), (3, "а е и о у й ы я ь")),
    step((3, "[ьи]", ""), (3, "нн", "н")),
), 4)
stemmer("german_light_stem", in_turn(step((0, "(e[rl])n", "$1"), (0, "e[nrs]", ""), (0, "[esn]", "")), translated("äöü", "aou")), 5)
stemmer("german_minimal_stem", step((0, "ern", ""), (0, "e[nrs]", ""), (0, "[es]", "")), 5)
stemmer("english_minimal_stem", step((2, "[us]s", "$0"), (3, "([^ae])ies", "$1y"), (3, "[iaoe]es", "$0"), (2, "s", "")), 3)
stemmer("french_minimal_stem", step((0, "aux", "al"), (0, "[sx]", "")), 4)
lowered = _told(lambda t: F.lower(t), "lower({t})")
stemmer("czech_stem", in_turn(lowered,
    endings((7, "atech"), (6, "ětem etem atům"), (5, "ech ich ích ého ěmi emi ému ěte ete ěti eti ího iho ími ímu imu ách ata aty ých ama ami ové ovi ými"),
            (4, "em es ém ím ům at ám os us ým mi ou"), (3, "a e i o u ů y á é í ý ě")),
    endings((5, "ov in ův")),
    step((1, "čt", "ck"), (1, "št", "sk"), (0, "[cč]", "k"), (0, "[zž]", "h"), (1, "e(.)", "$1"), (2, "ů(.)", "o$1")),
), 4)
stemmer("bulgarian_stem", lambda t: F.when((F.length(t) > 5) & F.endswith(t, F.lit("ища")), F.left(t, F.length(t) - 3)).otherwise(in_turn(
    step((6, "ият", ""), (5, "ът|то|те|та|ия", ""), (4, "ят", "")),
    step((6, "овци", "о"), (6, "ове", ""), (6, "еве", "й"), (5, "ища", ""), (5, "та", ""), (5, "ци", "к"), (5, "зи", "г"), (5, "е(.)и", "я$1"), (4, "си", "х"), (4, "и", "")),
    step((3, "я", "")), step((3, "[аое]", "")), step((4, "ен", "н")), step((5, "ъ(.)", "$1")),
)(t)), 4)

VOWELS_LV = "[aeiouāīēū]"
#: Latvian endings with the vowels that a word must have more of, and those that undo palatalization.
LATVIAN = """
ajiem 3 ajai 3 ajam 2 ajām 2 ajos 2 ajās 2 iem 2+ ajā 2 ais 2 ai 2 ei 2 ām 1 am 1 ēm 1 īm 1 im 1 um 1 us 1+ as 1 ās 1 es 1 os 1+ ij 1 īs 1 ēs 1
is 1 ie 1 u 1+ a 1+ i 1+ e 1 ā 1 ē 1 ī 1 ū 1 o 1 s 0 š 0
""".split()


def _latvian(t: Column) -> Column:
    vowels, out = F.regexp_count(t, F.lit(VOWELS_LV)), None
    harden = step((1, "([pbmv])j", "$1"), (1, "šņ", "sn"), (1, "žņ", "zn"), (1, "šļ", "sl"), (1, "žļ", "zl"), (1, "ļņ", "ln"), (1, "ļļ", "ll"), (0, "č", "c"), (0, "ļ", "l"), (0, "ņ", "n"))
    for ending, need in zip(LATVIAN[::2], LATVIAN[1::2], strict=True):
        stem = F.left(t, F.length(t) - len(ending))
        if need.endswith("+"):
            stem = F.when(stem.rlike("kš$") & F.startswith(F.lit(ending), F.lit("u")), F.concat(F.left(stem, F.length(stem) - 2), F.lit("st"))).when(
                stem.rlike("ņņ$") & F.startswith(F.lit(ending), F.lit("u")), F.concat(F.left(stem, F.length(stem) - 2), F.lit("nn"))
            ).otherwise(harden(stem))
        fits = (vowels > int(need[0])) & (F.length(t) >= len(ending) + 3) & F.endswith(t, F.lit(ending))
        out = F.when(fits, stem) if out is None else out.when(fits, stem)
    return out.otherwise(t)


stemmer("latvian_stem", _latvian, 4)
stemmer("arabic_stem", in_turn(
    step((4, "وال|بال|كال|فال", ""), (3, "ال|لل", ""), (3, "و", ""), start=True),
    *[step((len(x) + 1, x, "")) for x in "ها ان ات ون ين يه ية ه ة ي".split()],
), 4)
stemmer("swedish_minimal_stem", in_turn(step((4, "s", "")), step((6, "arne|erna|arna|orna|aren", ""), (5, "are", ""), (4, "a[rt]|e[rtn]|or", ""), (3, "[aen]", ""))))


@token_filter()
def norwegian_minimal_stem(bokmaal: bool = True, nynorsk: bool = True) -> Filter:
    more = ("|ane", "|ar") if nynorsk else ("", "")
    run = in_turn(step((4, "s", "")), step((5, "ene" + more[0], ""), (4, "e[rnt]" + more[1], ""), (3, "[ae]", "")))
    return rewrite(run)


stemmer("portuguese_minimal_stem", step((4, "ões", "ão"), (3, "ães", "ão"), (3, "ais", "al"), (3, "éis", "el"), (3, "eis", "el"), (3, "óis", "ol"), (3, "is", "i"), (3, "ns", "m"), (3, "s", "")), 4)
stemmer("sorani_stem", in_turn(
    step((5, "دا", ""), (4, "نا", "ن"), (6, "ەوە", "")), step((6, "مان|یان|تان", "")),
    step((6, "ێکی", ""), (7, "یەکی", ""), (5, "ێک", ""), (6, "یەک", ""), (6, "ەکە", ""), (5, "کە", ""), (7, "ەکان", ""), (6, "کان", ""), (7, "یانی", ""), (6, "انی", ""),
         (6, "یان", ""), (5, "ان", ""), (7, "یانە", ""), (6, "انە", ""), (5, "(ا|ە)یە", "$1"), (4, "ە", ""), (4, "ی", "")),
))


def _listed(lower: bool, *groups: tuple[int, str]) -> TermFn:
    """The first listed ending is stripped that leaves at least so many UTF-8 bytes."""

    def run(t: Column) -> Column:
        t = F.lower(t) if lower else t
        out = None
        for least, words in groups:
            for w in words.split():
                stem = F.left(t, F.length(t) - len(w))
                fits = F.endswith(t, F.lit(w)) & (F.octet_length(stem) >= least)
                out = F.when(fits, stem) if out is None else out.when(fits, stem)
        return out.otherwise(t)

    cases = [f"when ends_with({{t}}, '{w}') and strlen(left({{t}}, length({{t}}) - {len(w)})) >= {least} then left({{t}}, length({{t}}) - {len(w)})" for least, words in groups for w in words.split()]
    return _told(run, *["lower({t})"] * lower, f"case {' '.join(cases)} else {{t}} end")


stemmer("kannada_stem", _listed(True, (3, "ಗಳನ್ನು ಗಳಿಗೆ ಗಳಲ್ಲಿ ಗಳಿಂದ ಗಳು ಗಳ ನ್ನು ಇಗೆ ಅಲ್ಲಿ ಇಂದ ಲ್ಲಿ ನಲ್ಲಿ"), (6, "ವು ನು ಗೆ ದ ರು")), 3)
stemmer("tamil_stem", _listed(True, (6, "களுக்கு களால் களில் களை க்கு ுக்கு ால் ில் ுடன் கள் என் ை ல் ன் ம் ர்")), 3)
_TELUGU = _listed(True, (6, "లను లకు లతో లలో"), (3, "లో కు తో ను డు ము గా కి ని లు ల"))
_TELUGU_SHORT = _listed(True, (3, "లో కు తో ను డు ము గా కి ని లు ల"))
stemmer("telugu_stem", lambda t: F.when(F.length(t) > 4, _TELUGU(t)).when(F.length(t) > 3, _TELUGU_SHORT(t)).otherwise(F.lower(t)), 3)


def _affixes(prefixes: tuple[int, str] | None, *suffixes: tuple[int, str, bool], prefixes_first: bool = False, left: int = 2) -> TermFn:
    """On the lowered term: one prefix and one suffix of each list (or, where told,
    every suffix of a list in turn), each leaving more than so many bytes."""

    def strip(t: Column, w: str, more: int, start: bool) -> tuple[Column, Column]:
        fits = (F.octet_length(t) > len(w.encode()) + more) & (F.startswith if start else F.endswith)(t, F.lit(w))
        return fits, F.substring(t, len(w) + 1, 2_147_483_647) if start else F.left(t, F.length(t) - len(w))

    def one_of(words: str, more: int, start: bool) -> TermFn:
        def run(t: Column) -> Column:
            out = F.when(F.lit(False), t)
            for w in words.split():
                out = out.when(*strip(t, w, more, start))
            return out.otherwise(t)

        return run

    parts: list[TermFn] = []
    for more, words, each in suffixes:
        parts += [one_of(w, more, False) for w in words.split()] if each else [one_of(words, more, False)]
    if prefixes:
        head = one_of(prefixes[1], prefixes[0], True)
        parts = [head, *parts] if prefixes_first else [*parts, head]
    whole = in_turn(*parts)

    def run(t: Column) -> Column:
        return let(whole(F.lower(t)), lambda s: F.when((F.octet_length(F.lower(t)) < 4) | (F.octet_length(s) < left) | (s == F.lower(t)), t).otherwise(s))

    return run


stemmer("navajo_stem", _affixes((2, "bich' bik' bits' bee bi shi ni ha"), (2, "ígíí igii é", False), prefixes_first=True))
stemmer("nahuatl_stem", _affixes((3, "no mo to in i"), (3, "tzintli tzintle tzin tli tl li tin meh me h yotl yot lli can yan pan", False), left=3))
stemmer("aymara_stem", _affixes(None, (2, "nakana nakar naka mpi taki nka tha na ru xa wa ti sa", False)))
stemmer("quechua_stem", _affixes(None, (3, "puni chá cha raq ña", True), (2, "manta kama pura rayku ntin kuna wan man paq pi ta pa qa", False), (2, "nchik nchis ykichik ykichis nku yki y n", False)))
stemmer("guarani_stem", _affixes((2, "mba'e mbae ñe'ẽ"), (2, "kuéra kuera guasu mi ite hára hara py pe gui re me", False)))
stemmer("yiddish_stem", lambda t: F.when((F.length(t) > 4) & F.lower(t).rlike("^[a-z'-]+$"), _affixes(None, (3, "lekh ung keit heyt shaft ish ikh er im es en s n", False))(t)).otherwise(t))
stemmer("hebrew_stem", lambda t: F.when(t.rlike(r"[\x{05D0}-\x{05EA}]"), in_turn(
    step((3, "[הובכלמש]", ""), start=True), step((4, "ים|ות", "")), step((3, "ה", "")),
)(t)).otherwise(t))


# Stemmers that need more than endings: Python, once for each distinct term of a batch.


def krovetz_like(term: str) -> str:
    """The first of nine endings that fits: plural, -ed, -ing, -ity, -ness, -tion, -ment, -able/-ible, -ly; no lexicon."""
    if len(term.encode()) < 3:
        return term
    low = term.lower()
    doubled, open_stem = re.compile(r"([^aeioulsz])\1$"), re.compile("(^|[^aeiou])[aeiou][^aeiou]$")

    def restored(stem: str, double_from: int) -> str | None:
        if len(low) > double_from and doubled.search(stem):
            return stem[:-1]
        if len(stem) < 3:
            return None
        return stem + "e" if open_stem.search(stem) else stem

    def plural() -> str | None:
        if len(low) < 4:
            return None
        if low.endswith("ies") and len(low) > 4:
            return low[:-3] + "y"
        if low.endswith("es") and (len(low) > 4 or re.search("(ss|sh|ch|x|z)es$", low)):
            return low[:-2]
        return low[:-1] if low.endswith("s") and not low.endswith("ss") else None

    def past() -> str | None:
        if not low.endswith("ed") or len(low) < 5:
            return None
        if low.endswith("ied"):
            return low[:-3] + "y"
        return low[:-1] if low.endswith("eed") else restored(low[:-2], 4)

    def aspect() -> str | None:
        return restored(low[:-3], 5) if low.endswith("ing") and len(low) >= 5 else None

    def ending(words: str, more: int, made: Callable[[str], str] = lambda s: s) -> str | None:
        for w in words.split():
            if low.endswith(w) and len(low) > more and len(low) - len(w) >= 3:
                return made(low[: -len(w)])
        return None

    found = plural() or past() or aspect() or ending("ity", 5) or ending("ness", 6, lambda s: re.sub("i$", "y", s))
    found = found or ending("ation", 7, lambda s: s + "ate") or ending("tion", 6, lambda s: s + "t") or ending("ment", 6)
    return found or ending("able ible", 6) or ending("ly", 4) or low


@token_filter("kstem", "porter_stem")
def kstem() -> Filter:
    return python_terms(krovetz_like)


def indonesian(term: str) -> str:
    """Particles, possessives, then derivational prefixes and suffixes, while more than two syllables are left."""
    word, removed = term.lower(), set()
    left = sum(c in "aeiou" for c in word)

    def cut(pattern: str, to: str = "", mark: str = "") -> bool:
        nonlocal word, left
        new, n = re.subn(pattern, to, word, count=1)
        if n:
            word, left = new, left - 1
            removed.add(mark)
        return bool(n)

    def first() -> bool:
        rules = [("^meng", "", "meng"), ("^meny(?=[aeiou])", "s", "meng"), ("^me[nm]", "", "meng"), ("^me", "", "meng"), ("^peng", "", "peng"), ("^peny(?=[aeiou])", "s", "peng"),
                 ("^peny", "", "peng"), ("^pen(?=[aeiou])", "t", "peng"), ("^pe[nm]", "", "peng"), ("^di", "", "di"), ("^ter", "", "ter"), ("^ke", "", "ke")]
        return left > 2 and any(cut(*r) for r in rules)

    def second() -> bool:
        rules = [("^ber", "", "ber"), ("^bel(?=ajar$)", "", "ber"), ("^be(?=[^aeiou]er)", "", "ber"), ("^per", "", ""), ("^pel(?=ajar$)", "", ""), ("^pe", "", "pe")]
        return left > 2 and any(cut(*r) for r in rules)

    def suffix() -> bool:
        if left <= 2:
            return False
        if not removed & {"ke", "peng", "pe"} and cut("kan$"):
            return True
        if not removed & {"di", "meng", "ter"} and cut("an$"):
            return True
        return not removed & {"ber", "ke", "peng"} and cut("(?<!s)i$")

    if left > 2:
        cut("(kah|lah|pun)$")
    if left > 2:
        cut("(ku|mu|nya)$")
    if first():
        if suffix():
            second()
    else:
        second()
        suffix()
    return word


@token_filter()
def indonesian_stem() -> Filter:
    return python_terms(indonesian)


@token_filter("hunspell")
def hunspell_stem(rules: tuple[tuple[bool, str, str], ...] = (), dedup: bool = True, longest_only: bool = False) -> Filter:
    """rules: (is_suffix, strip, affix). All stems that the rules give, the first in the term's place."""

    def stems(term: str) -> list[str]:
        low, out = term.lower(), []
        for is_suffix, strip, affix in sorted(rules, key=lambda r: not r[0]):
            if affix and (low.endswith(affix) if is_suffix else low.startswith(affix)):
                base = low[: -len(affix)] if is_suffix else low[len(affix) :]
                extra = "" if strip == "0" else strip
                if len(base.encode()) >= 2:
                    out.append(base + extra if is_suffix else extra + base)
        out = sorted(set(out)) if dedup else out
        return (sorted(out, key=lambda s: -len(s.encode()))[:1] if longest_only else out) or [term]

    return python_expand(stems)


#: Languages of the generic stemmer filter, and the filters that they mean.
LANGUAGES = {
    "arabic": "arabic_stem", "bengali": "bengali_stem", "brazilian": "brazilian_stem", "brazilian_portuguese": "brazilian_stem", "bulgarian": "bulgarian_stem",
    "czech": "czech_stem", "dutch": "dutch_stem", "dutch_kp": "dutch_stem", "english": "kstem", "light_english": "kstem", "porter": "kstem", "porter2": "kstem",
    "finnish": "finnish_light_stem", "light_finnish": "finnish_light_stem", "french": "french_light_stem", "light_french": "french_light_stem",
    "minimal_french": "french_minimal_stem", "galician": "galician_stem", "minimal_galician": "galician_minimal_stem", "german": "german_light_stem",
    "light_german": "german_light_stem", "minimal_german": "german_minimal_stem", "greek": "greek_stem", "hindi": "hindi_stem",
    "hungarian": "hungarian_light_stem", "light_hungarian": "hungarian_light_stem", "indonesian": "indonesian_stem", "italian": "italian_light_stem",
    "light_italian": "italian_light_stem", "kannada": "kannada_stem", "latvian": "latvian_stem", "norwegian": "norwegian_light_stem",
    "light_norwegian": "norwegian_light_stem", "light_nynorsk": "norwegian_light_stem", "persian": "persian_stem", "portuguese": "portuguese_light_stem",
    "light_portuguese": "portuguese_light_stem", "russian": "russian_light_stem", "light_russian": "russian_light_stem", "spanish": "spanish_light_stem",
    "light_spanish": "spanish_light_stem", "tamil": "tamil_stem", "telugu": "telugu_stem",
}


@token_filter("stemmer")
def stemmer_of(language: str = "english") -> Filter:
    return FILTERS[LANGUAGES[language.lower()]]()


#: French endings: more than so many characters, ending, replacement, and whether the stem is then done.
FRENCH = [
    (5, "(?<!e)aux", "al", 0), (5, "x", "", 0), (3, "x", "", 0), (3, "s", "", 0), (9, "issement", "ir", 1), (8, "issant", "ir", 1), (6, "ivement", "if", 1), (6, "ement", "e", 1),
    (11, "ficatrice", "fier", 1), (10, "ficateur", "fier", 1), (9, "catrice", "quer", 1), (8, "cateur", "quer", 1), (8, "atrice", "er", 1), (7, "ateur", "er", 1), (6, "trice", "teur", 0),
    (5, "ième", "", 1), (7, "teuse", "ter", 1), (6, "teur", "ter", 1), (5, "euse", "eu", 1), (8, "ère", "er", 1), (7, "ive", "if", 1), (4, "([fm])olle", r"\1ou", 1), (9, "nnelle", "n", 1),
    (9, "nnel", "n", 1), (4, "ète", "et", 0), (8, "ique", "", 0), (8, "esse", "e", 1), (7, "inage", "in", 1), (9, "ualisation", "uel", 1), (9, "isation", "", 1), (9, "isateur", "", 1), (8, "[ai]tion", "", 1),
]


def french_light(term: str) -> str:
    word = term
    for more, ending, to, done in FRENCH:
        if len(word) > more and (new := re.sub(f"(?:{ending})$", to, word)) != word:
            word = new
            if done:
                break
    if len(word) > 4:
        word = re.sub(r"([^\W\d_])\1+", r"\1", word.translate(str.maketrans("àáâôèéêùûîç", "aaaoeeeuuic")))
        word = re.sub("ie$", "", word) if len(word) > 4 else word
    if len(word) > 4:
        word = re.sub(r"([^\W\d_])\1$", r"\1", re.sub("e$", "", re.sub("r$", "", word)))
    return word


@token_filter()
def french_light_stem() -> Filter:
    return python_terms(french_light)


stemmer("spanish_minimal_stem", lambda t: F.when(~F.endswith(t, F.lit("s")), t).otherwise(in_turn(_folded("ñ", "n"), step((4, "eses", "es"), (3, "ces", "z"), (3, "es", ""), (0, "([ao])s", "$1")))(t)), 4)
stemmer("galician_minimal_stem", step((3, "([^s])s", "$1")), 4)
