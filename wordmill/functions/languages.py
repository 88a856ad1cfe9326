"""Stop words, and filters for minority and indigenous languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..data.stopwords import stop_words
from ..tokens import TOKENS, Filter, drop, is_one_of, let, none, rewrite, token
from .folding import mapped, steps
from .registry import token_filter
from .social_and_unicode import _without


@token_filter()
def stop(words: str | tuple[str, ...] = "english", ignore_case: bool = False) -> Filter:
    """Words of a list, or of a language's list, go; positions keep the gaps."""
    found = stop_words(words) if isinstance(words, str) else tuple(words)
    if ignore_case:
        return drop(lambda t: is_one_of(F.lower(t), [w.lower() for w in found]))
    return drop(lambda t: is_one_of(t, found))


#: Short stop lists, matched in lower case.
SHORT_LISTS = {
    "navajo": "éí ei dóó doo áko ako t'áá taa shi ni bi da lá la go yee baa bee nihí nihi índa inda háálá haala",
    "nahuatl": "in ín ihuan huan ica ipan itech amo neh teh yeh tech nochi ce ome zan san axan axcan niman tlein tlen kenin quenin kanin canin",
    "aymara": "naya juma jupa nanaka jumanaka jupanaka aka uka khaya jani ukhamaraki ukata jan kunasa khitisa kawkisa",
    "quechua": "kay chay pay ñuqa qam ima pi may mana ari arí hina chaymanta icha aswanqa huq huk chayqa hinaspa ichaqa",
    "guarani": "ha ha'e hae che nde ore ñande ko pe amo ndaha'éi nahániri avei katu heta mbovy upéicha upéi ágã aga ky'a porã rupi rehe",
    "welsh": """a ac am ar at â bod bydd yn y yr i ei eu fy dy ein eich mae maen yw ydy oedd roedd o gan gyda heb rhwng wrth dan tan dros tros
        drwy trwy er ers hyd nes ni chi nhw fe hi fi hon hyn hwn hynny hwnnw pan pe os ond neu na nid dim un dau dwy tri tair wedi cyn mewn
        allan eto hefyd iawn felly wedyn nawr yma yna""",
    "scottish_gaelic": """an am a na nan nam ag air aig ann anns às bho bhon de den do don e eadar fo gu gun gus le leis mar mu mun o on ri ris
        ro tro troimh tha is bi bha chan cha nach ach agus no neo ma mur ged nuair far oir gur seo sin siud mo ar ur mi thu i sinn sibh iad""",
}
#: Tibetan grammatical syllables.
TIBETAN_SYLLABLES = "གི གིས ཀྱི ཀྱིས ཡི ཡིས ནི དང ལ ན ར སུ ནས ཀྱང ཡང པ བ ཅིག ཞིག ཤིག ཡིན རེད ཡོད འདུག དེ འདི དེར ལས བས"


def _short_stop(language: str):
    words = SHORT_LISTS[language].split()
    return lambda: drop(lambda t: is_one_of(F.lower(t), words))


for _language in SHORT_LISTS:
    token_filter(f"{_language}_stop")(_short_stop(_language))


@token_filter()
def tibetan_stop_syllable() -> Filter:
    return drop(lambda t: is_one_of(t, TIBETAN_SYLLABLES.split()))


NIQQUD = r"[\x{0591}-\x{05BD}\x{05BF}\x{05C1}\x{05C2}\x{05C4}\x{05C5}\x{05C7}]"


@token_filter()
def hebrew_niqqud_remove() -> Filter:
    return _without(NIQQUD, drop_empty=False)


@token_filter()
def hebrew_final_form_norm() -> Filter:
    return rewrite(mapped("ךםןףץ", "כמנפצ"))


@token_filter()
def yiddish_normalization() -> Filter:
    return rewrite(steps((NIQQUD, ""), ("ײ", "יי"), ("װ", "וו"), ("ױ", "וי")))


@token_filter()
def scottish_gaelic_lenition() -> Filter:
    """The h of a lenited initial goes, and the word is lowered, when it has three letters or more."""

    def run(t: Column) -> Column:
        low = F.lower(t)
        return F.when((F.length(low) >= 3) & low.rlike("^[bcdfgmpst]h"), F.regexp_replace(low, "^(.)h", "$1")).otherwise(t)

    return rewrite(run)


#: Welsh initials after soft, nasal and aspirate mutation, with the radical ones; the first that fits counts.
WELSH_MUTATIONS = [
    ("^f", "b"), ("^b", "p"), ("^dd", "d"), ("^d", "t"), ("^g", "c"), ("^l(?!l)", "ll"), ("^r(?!h)", "rh"),
    ("^mh", "p"), ("^nh", "t"), ("^ngh", "c"), ("^ng", "g"), ("^ph", "p"), ("^th", "t"), ("^ch", "c"),
]


@token_filter()
def welsh_mutation_norm() -> Filter:
    def run(t: Column) -> Column:
        low = F.lower(t)
        out = F.when(F.length(low) < 2, t)
        for pattern, radical in WELSH_MUTATIONS:
            out = out.when(low.rlike(pattern), F.regexp_replace(low, pattern, radical))
        return out.otherwise(t)

    return rewrite(run)


@token_filter()
def cherokee_normalization() -> Filter:
    small = "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
    large = "".join(map(chr, [*range(0x13A0, 0x13F0), *range(0x13F0, 0x13F6)]))
    return rewrite(mapped(small, large))


@token_filter()
def cherokee_translit_norm() -> Filter:
    plain = steps(("ts", "j"), ("qu", "kw"), ("tl", "hl"))
    return rewrite(lambda t: plain(F.lower(t)))


@token_filter()
def khmer_sign_remove() -> Filter:
    return _without(r"[\x{17B4}\x{17B5}\x{17D4}-\x{17DA}\x{17DC}\x{17DD}]")


@token_filter()
def tibetan_punctuation_remove() -> Filter:
    return _without(r"[\x{0F04}-\x{0F12}\x{0F14}\x{0F85}\x{0F3A}-\x{0F3D}\x{0FBE}-\x{0FC5}\x{0FC7}-\x{0FCC}\x{0FCE}\x{0FCF}]")


def _split_at(marks: str, script: str) -> Filter:
    """Parts of terms of a script take their place at successive positions."""

    def one(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t["term"], marks, -1), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
        bare = F.regexp_replace(t["term"], marks, "")
        single = token(F.when(bare == "", t["term"]).otherwise(bare), t["start_offset"], t["end_offset"], t["position"])
        spread = lambda p: F.transform(p, lambda x, i: token(x, t["start_offset"], t["end_offset"], t["position"] + i))
        return F.when(~t["term"].rlike(script), F.array(t)).otherwise(let(parts, lambda p: F.when(F.size(p) <= 1, F.array(single)).otherwise(spread(p))))

    return lambda tokens: F.flatten(F.transform(tokens, one))


@token_filter()
def khmer_word_boundary() -> Filter:
    return _split_at(r"[\x{200B}\x{200C}]", r"[\x{1780}-\x{17FF}]")


@token_filter()
def tibetan_tsek_segment() -> Filter:
    return _split_at("་", r"[\x{0F00}-\x{0FFF}]")


@token_filter()
def navajo_normalization() -> Filter:
    return rewrite(lambda t: F.translate(F.lower(t), "'’ʻ", "ʼʼʼ"))


@token_filter()
def navajo_tone_remove(remove_nasal: bool = False) -> Filter:
    tones = ("áÁéÉíÍóÓǎ", "aaeeiiooa")
    nasal = ("ąĄęĘįĮǫǪ", "aaeeiioo") if remove_nasal else ("", "")
    return rewrite(mapped(tones[0] + nasal[0], tones[1] + nasal[1]))


@token_filter()
def guarani_normalization() -> Filter:
    return rewrite(lambda t: F.translate(F.lower(t), "’'‘", "ʼʼʼ"))


__all__ = ["TOKENS", "none"]
