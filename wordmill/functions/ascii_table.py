"""Folding of letters to ASCII."""

from __future__ import annotations

#: Latin letters by the ASCII letters that they fold to.
LATIN = {
    "A": "ÀÁÂÃÄÅĀĂĄ", "AE": "Æ", "C": "ÇĆĈĊČ", "D": "ÐĎĐ", "E": "ÈÉÊËĒĔĖĘĚ", "G": "ĜĞĠĢ", "H": "ĤĦ", "I": "ÌÍÎÏĨĪĬĮİ", "IJ": "Ĳ", "J": "Ĵ",
    "K": "Ķ", "L": "ĹĻĽĿŁ", "N": "ÑŃŅŇ", "O": "ÒÓÔÕÖØŌŎŐ", "OE": "Œ", "R": "ŔŖŘ", "S": "ŚŜŞŠ", "T": "ŢŤŦ", "TH": "Þ", "U": "ÙÚÛÜŨŪŬŮŰŲ",
    "W": "Ŵ", "Y": "ÝŶ", "Z": "ŹŻŽ",
}
#: Those without a capital, or whose capital is elsewhere, and ligatures.
OTHERS = {"n": "ŉ", "y": "ÿ", "Y": "Ÿ", "ss": "ß", "f": "ƒ", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ", "st": "ﬆ"}
#: Greek and Cyrillic letters in order, and their transliterations.
GREEK = ("αβγδεζηθικλμνξοπρστυφχψω", "a b g d e z h th i k l m n x o p r s t u ph ch ps o".split())
CYRILLIC = ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i j k l m n o p r s t u f h ts ch sh shch - y - e yu ya".split())
#: Last code points of the runs of alternating capitals and small letters from U+1E00 on, and from U+1EA0 on.
ADDITIONAL = "A 1E01 B 1E07 C 1E09 D 1E13 E 1E1D F 1E1F G 1E21 H 1E2B I 1E2F K 1E35 L 1E3D M 1E43 N 1E4B O 1E53 P 1E57 R 1E5F S 1E69 T 1E71 U 1E7B V 1E7F W 1E89 X 1E8D Y 1E8F Z 1E95"
VIETNAMESE = "A 1EB7 E 1EC7 I 1ECB O 1EE3 U 1EF1 Y 1EF9"
SINGLE = {0x1E96: "h", 0x1E97: "t", 0x1E98: "w", 0x1E99: "y", 0x1E9A: "a", 0x1E9B: "s", 0x1E9E: "S", 0x3000: " "}


def _table() -> dict[int, str]:
    out = {ord(c): plain for plain, letters in OTHERS.items() for c in letters} | SINGLE
    for plain, letters in LATIN.items():
        for c in letters:
            out[ord(c)] = plain
            if len(c.lower()) == 1:
                out[ord(c.lower())] = plain.lower()
    for letters, names in (GREEK, CYRILLIC):
        for c, name in zip(letters, names, strict=True):
            name = name.replace("-", "")
            out[ord(c)], out[ord(c.upper())] = name, name.capitalize()
    out[ord("ς")] = "s"
    for runs, code in ((ADDITIONAL, 0x1E00), (VIETNAMESE, 0x1EA0)):
        parts = runs.split()
        for letter, last in zip(parts[::2], parts[1::2], strict=True):
            while code <= int(last, 16):
                out[code] = letter if code % 2 == 0 else letter.lower()
                code += 1
    out |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    out |= {c: letters[(c - 0x1D400) % 52] for c in range(0x1D400, 0x1D6A4)}
    return out | {c: str((c - 0x1D7CE) % 10) for c in range(0x1D7CE, 0x1D800)}


TABLE = _table()


def fold(term: str) -> str:
    return term if term.isascii() else term.translate(TABLE)
