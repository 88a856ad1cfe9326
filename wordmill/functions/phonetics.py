"""Phonetic codes, and normalization of Indic scripts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..tokens import Filter, python_expand, python_terms, rewrite
from .registry import token_filter

#: Rewriting rules shared by both rule sets, then those that differ (approximate, exact).
SOUNDS = "tsch tS sch S tch tS th t ph f gh g kh x sh S ch x ck k zh Z dj dZ ts ts tz ts sz S cz tS rz Z qu kv"
VOWEL_SOUNDS = {"approx": "ei aj ey aj eu oj au au ou u oo u ee i ae e oe o ue u ie i c k", "exact": "ei ej ey ej eu ej au au ou u oo u ee i ae e oe oe ue ue ie ie c ts"}
SINGLE_SOUNDS = "x ks q k w v y i"


@token_filter()
def beider_morse(rules: str = "approx", replace: bool = True, max_phonemes: int = 20) -> Filter:
    parts = f"{SOUNDS} {VOWEL_SOUNDS[rules]} {SINGLE_SOUNDS}".split()
    table = dict(zip(parts[::2], parts[1::2], strict=True)) | ({"h": ""} if rules == "approx" else {})
    found = re.compile("|".join(sorted(table, key=len, reverse=True)))

    def encode(term: str) -> str:
        made = found.sub(lambda m: table[m[0]], term.lower())
        return "|".join(made.split("|")[:max_phonemes]) or term

    return python_terms(encode) if replace else python_expand(lambda t: [t] if encode(t) == t else [t, encode(t)])


CODES = dict(zip("BFPVCGJKQSXZDTLMNR", "111122222222334556", strict=True))  # fixed values: the published classes
REFINED = dict(zip("AEIOUHWYBPFVCKSGJQXZDTLMNR", "00000000112233344555667889", strict=True))


def american_soundex(term: str, length: int = 4) -> str:
    """Letter and three digits; letters of one class side by side, or with H or W between, count once."""
    letters = [c for c in term.upper() if "A" <= c <= "Z"]
    if not letters:
        return ""
    out, last = letters[0], CODES.get(letters[0], "")
    for c in letters[1:]:
        code = CODES.get(c, "")
        if code and code != last:
            out += code
        if c not in "HW":
            last = code
    return (out + "000")[:length]


def refined_soundex(term: str) -> str:
    letters = [c for c in term.upper() if "A" <= c <= "Z"]
    if not letters:
        return ""
    out, last = letters[0], ""
    for c in letters:
        if REFINED[c] != last:
            out += REFINED[c]
        last = REFINED[c]
    return out


def cologne(term: str) -> str:
    """The Cologne phonetics as published: digits by letter and neighbours, repeats once, zeros only first."""
    word = re.sub("[^A-Z]", "", term.upper().translate(str.maketrans("ÄÖÜ", "AOU")).replace("ß", "S").replace("PH", "F"))
    digits = []
    for k, c in enumerate(word):
        before, after = word[k - 1 : k] if k else "", word[k + 1 : k + 2]
        if c in "AEIJOUY":
            code = "0"
        elif c == "H":
            continue
        elif c in "BP":
            code = "1"
        elif c in "DT":
            code = "8" if after and after in "CSZ" else "2"
        elif c in "FVW":
            code = "3"
        elif c in "GKQ":
            code = "4"
        elif c == "C":
            soft = "AHKLOQRUX" if not k else "AHKOQUX"
            code = "4" if after and after in soft and not (before and before in "SZ") else "8"
        elif c == "X":
            code = "8" if before and before in "CKQ" else "48"
        elif c == "L":
            code = "5"
        elif c in "MN":
            code = "6"
        elif c == "R":
            code = "7"
        else:
            code = "8"
        digits += list(code)
    once = [d for k, d in enumerate(digits) if not k or digits[k - 1] != d]
    return "".join(d for k, d in enumerate(once) if d != "0" or not k)


def _scan(word: str, rules: list[tuple[re.Pattern, str]], start: int = 0):
    """The first rule that fits at each place, from left to right: (what it covers, its code or None)."""
    at = start
    while at < len(word):
        found = next(((m, code) for pattern, code in rules if (m := pattern.match(word, at))), None)
        m, code = found or (None, None)
        yield (m[0] if m else word[at]), code
        at = m.end() if m else at + 1


def _rules(text: str) -> list[tuple[re.Pattern, str]]:
    """Pairs of a pattern and a code; an underscore is no code."""
    parts = text.split()
    return [(re.compile(p, re.S), "" if c == "_" else c) for p, c in zip(parts[::2], parts[1::2], strict=True)]


#: The first letters that sound otherwise, then the codes of letters by their neighbours, as published.
METAPHONE_START = [("^[KGP](?=N)", ""), ("^A(?=E)", ""), ("^W(?=R)", ""), ("^WH", "W"), ("^X", "S")]
METAPHONE = _rules(r"""
([^C])(?<=\1\1) _  ^A A  ^E E  ^I I  ^O O  ^U U  (?<=M)B\Z _  B B  (?<=S)C(?=[EIY]) _  (?<=S)C(?=H) K  C(?=IA|H) X  C(?=[EIY]) S  C K
DG[EIY] J  D T  G(?=H\Z|H[^AEIOU]) _  (?<=.)G(?=N) _  G(?=[EIY]) J  G K  H\Z _  (?<=[CSPTG])H _  H(?=[AEIOU]) H
F F  J J  L L  M M  N N  R R  (?<=C)K _  K K  P(?=H) F  P P  Q K  S(?=H|IO|IA) X  S S  T(?=IA|IO) X  T(?=CH) _  T(?=H) 0  T T
V F  W(?=[AEIOU]) W  Y(?=[AEIOU]) Y  X KS  Z S  . _
""")


def metaphone(term: str, length: int = 4) -> str:
    word = term.upper()
    if len(word) < 2:
        return word
    for pattern, to in METAPHONE_START:
        changed = re.sub(pattern, to, word)
        if changed != word:
            word = changed
            break
    return "".join(code for _, code in _scan(word, METAPHONE))[: length or 4]


#: Replacements one after another; 2 stands for a silent letter, 3 for a vowel until the end.
CAVERPHONE = """
cough cou2f rough rou2f tough tou2f enough enou2f gn 2n mb m2 cq 2q ci si ce se cy sy tch 2ch c k q k x k v f dg 2g tio sio tia sia d t ph fh b p sh s2 z s
a 3 e 3 i 3 o 3 u 3 3gh3 3kh3 gh 22 g k ss s tt t pp p kk k ff f nn n rr r ll l mm m
""".split()


def caverphone(term: str, length: int = 6) -> str:
    """Six signs, or with more than six asked for, six and then ones."""
    word = re.sub("[^a-z]", "", term.lower())
    if not word:
        return ""
    word = word.removesuffix("e")
    for old, new in zip(CAVERPHONE[::2], CAVERPHONE[1::2], strict=True):
        word = word.replace(old, new)
    return word.replace("3", "").upper()[:6].ljust(length, "1")


#: Starts and endings that are written otherwise first, then codes of letters; = repeats the last letter of the code.
NYSIIS_START = [("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH|PF", "FF"), ("SCH", "SSS")]
NYSIIS_END = [("EE|IE", "Y"), ("DT|RT|RD|NT|ND", "D")]
NYSIIS = _rules("EV AF [AEIOU] A Q G Z S M N K(?=N) N K C SCH SSS PH FF (?<=[AEIOU])H(?=[AEIOU]) H H = (?<=[AEIOU])W = W W")


def nysiis(term: str, length: int = 6) -> str:
    """Rewritten letters are not repeated; letters that no rule knows are kept as they stand."""
    word = re.sub("[^A-Z]", "", term.upper())
    for rules, anchored in ((NYSIIS_START, r"\A(?:{})"), (NYSIIS_END, r"(?:{})\Z")):
        fitting = next(((anchored.format(p), to) for p, to in rules if re.search(anchored.format(p), word)), None)
        word = re.sub(*fitting, word) if fitting else word
    key = word[:1]
    for letters, code in _scan(word, NYSIIS, 1):
        if code is None or code == "=":
            key += key[-1] if code else letters
            continue
        for c in code:
            key += c if key[-1] != c else ""
    key = key[:1] + re.sub("S+\\Z", "", key[1:])
    key = key[:-2] + "Y" if key.endswith("AY") else key
    return (key[:1] + re.sub("A+\\Z", "", key[1:]))[:length]


#: Codes of letters and groups of letters; vowels count at the start only.
DAITCH_MOKOTOFF = _rules("""
^[AEIOUY] 0 [AEIOUYH] _ B 7 C[HK] 5 C[SZ] 4 C 5 D[TZS] 4 D 3 F 7 G 5 J 4 KH 5 K 5 L 8 [MN] 6 P[HF] 7 P 7 Q 5 R 9
SH 4 SCH 4 ST(?=[RSC]) 2 ST 4 S 4 T[SZ] 4 TH 3 T 3 [VW] 7 X 5 Z[HS] 4 Z 4
""")


def daitch_mokotoff(term: str) -> str:
    """Six digits; equal digits side by side count once."""
    word = re.sub("[^A-Z]", "", term.upper())
    codes = [code for _, code in _scan(word, DAITCH_MOKOTOFF) if code]
    once = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c]
    return "".join(once)[:6].ljust(6, "0") if word else ""


ENCODERS = {
    "soundex": american_soundex, "refined_soundex": refined_soundex, "cologne": cologne, "metaphone": metaphone, "double_metaphone": metaphone, "caverphone1": caverphone,
    "caverphone2": lambda t: caverphone(t, 10), "nysiis": nysiis, "daitch_mokotoff": daitch_mokotoff,
}


@token_filter()
def phonetic(encoder: str = "soundex", replace: bool = True, max_code_length: int = 4) -> Filter:
    """Codes in the place of terms, or after them; terms without a code stay. The length holds for metaphone,
    whose second code is taken to be its first."""
    if encoder == "soundex" and replace:
        plain = lambda t: F.regexp_replace(t, "[^A-Za-z]", "")
        return rewrite(lambda t: F.when(plain(t) == "", t).otherwise(F.soundex(plain(t))))
    code = ENCODERS[encoder] if "metaphone" not in encoder else lambda t: metaphone(t, max_code_length)
    if replace:
        return python_terms(lambda t: code(t) or t)
    return python_expand(lambda t: [t, code(t)] if code(t) else [t])



#: Letters and signs that follow each other, and the one that they make, as offsets into a script's block.
#: Scripts: Devanagari D, Bengali B, Gurmukhi P, Gujarati J, Oriya O, Tamil T, Telugu E, Kannada K, Malayalam M; third: 00 none, FF a zero-width joiner.
INDIC = """
05 3E 45 11 DJ|05 3E 46 12 D|05 3E 47 13 DJ|05 3E 48 14 DJ|05 3E 00 06 DBPJO|05 45 00 72 D|05 45 00 0D J|05 46 00 04 D|05 47 00 0F J|05 48 00 10 PJ|05 49 00 11 DJ|05 4A 00 12 D
05 4B 00 13 DJ|05 4C 00 14 DPJ|06 45 00 11 DJ|06 46 00 12 D|06 47 00 13 DJ|06 48 00 14 DJ|07 57 00 08 M|09 41 00 0A D|09 57 00 0A TM|0E 46 00 10 M|0F 45 00 0D D|0F 46 00 0E D
0F 47 00 10 D|0F 57 00 10 O|12 3E 00 13 M|12 4C 00 14 EK|12 55 00 13 E|12 57 00 14 TM|13 57 00 14 O|15 3C 00 58 D|16 3C 00 59 DP|17 3C 00 5A DP|1C 3C 00 5B DP|21 3C 00 5C DBO
22 3C 00 5D DBO|23 4D FF 7A M|24 4D FF 4E B|28 3C 00 29 D|28 4D FF 7B M|2B 3C 00 5E DP|2F 3C 00 5F DB|2C 41 41 0B E|30 3C 00 31 D|30 4D FF 7C M|32 4D FF 7D M|33 3C 00 34 D
33 4D FF 7E M|35 41 00 2E E|3E 45 00 49 DJ|3E 46 00 4A D|3E 47 00 4B DJ|3E 48 00 4C DJ|3F 55 00 40 K|41 41 00 42 P|46 3E 00 4A TM|46 42 55 4B K|46 42 00 4A K|46 46 00 48 M
46 55 00 47 EK|46 56 00 48 EK|46 57 00 4C TM|47 3E 00 4B BOTM|47 57 00 4C BO|4A 55 00 4B K|72 3F 00 07 P|72 40 00 08 P|72 47 00 0F P|73 41 00 09 P|73 42 00 0A P|73 4B 00 13 P
"""
SCRIPTS = "DBPJOTEKM"


def _indic_table() -> dict[str, str]:
    out: dict[str, str] = {}
    for row in INDIC.replace("\n", "|").strip("|").split("|"):
        one, two, three, made, scripts = row.split()
        for s in scripts:
            at = lambda h, s=s: chr(0x900 + 0x80 * SCRIPTS.index(s) + int(h, 16))
            third = {"00": "", "FF": "‍"}.get(three) if three in ("00", "FF") else at(three)
            out.setdefault(at(one) + at(two) + third, at(made))
    return out


@token_filter()
def indic_normalization() -> Filter:
    """Sequences composed from left to right, longer ones first; then zero-width joiners go."""
    table = _indic_table()
    found = re.compile("|".join(sorted(table, key=len, reverse=True)))
    return python_terms(lambda t: t if t.isascii() else re.sub("[‌‍]", "", found.sub(lambda m: table[m[0]], t)))
