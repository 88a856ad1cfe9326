"""Social media and plain language; emoji; Unicode safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tokens import Filter, drop, expand, inject, let, look_up, none, rewrite, string, tag
from .registry import token_filter

#: Contractions and what they stand for.
CONTRACTIONS = """
don't dont=do not|doesn't doesnt=does not|didn't didnt=did not|won't wont=will not|wouldn't wouldnt=would not|shouldn't shouldnt=should not
couldn't couldnt=could not|can't cant=cannot|isn't isnt=is not|aren't arent=are not|wasn't wasnt=was not|weren't werent=were not
hasn't hasnt=has not|haven't havent=have not|hadn't hadnt=had not|i'm im=i am|you're youre=you are|they're theyre=they are|he's hes=he is
she's shes=she is|i've ive=i have|you've youve=you have|we've weve=we have|they've theyve=they have|you'll youll=you will
they'll theyll=they will|you'd youd=you would|he'd hed=he would|they'd theyd=they would|that's thats=that is|who's whos=who is
what's whats=what is|there's theres=there is|here's heres=here is
"""
#: Abbreviations.
ABBREVIATIONS = """
govt=government|approx=approximately|dept=department|mgmt=management|info=information|tech=technology|env=environment|config=configuration
auth=authentication|admin=administrator|dev=development|prod=production|impl=implementation|repo=repository|dir=directory|src=source
msg=message|err=error|req=request|res=response|btn=button|img=image|num=number|str=string|obj=object|arr=array|fn=function|var=variable
ctx=context|ref=reference|ptr=pointer|alloc=allocation|dealloc=deallocation|init=initialize|exec=execute|calc=calculate|util=utility
tmp=temporary|prev=previous|cur curr=current
"""
#: Slang.
SLANG = """
lol=laughing out loud|brb=be right back|tbh=to be honest|imo=in my opinion|imho=in my humble opinion|fwiw=for what it is worth
afaik=as far as i know|iirc=if i recall correctly|tl;dr tldr=too long did not read|btw=by the way|smh=shaking my head|irl=in real life
fyi=for your information|asap=as soon as possible|eta=estimated time of arrival|diy=do it yourself|tbd=to be determined|wip=work in progress
afk=away from keyboard|idk=i do not know|nvm=never mind|omg=oh my god|rofl=rolling on floor laughing|ty=thank you|np=no problem|gg=good game
gl=good luck|pls plz=please|thx thnx=thanks
"""
#: Words with a sentiment.
POSITIVE = "good great excellent amazing wonderful fantastic awesome love happy joy beautiful perfect best brilliant outstanding superb incredible delightful pleasant positive"
NEGATIVE = "bad terrible horrible awful worst hate ugly disgusting pathetic dreadful miserable angry sad disappointing poor negative toxic broken failed useless"


def entries(text: str) -> dict[str, str]:
    rows = [row.split("=") for line in text.strip().splitlines() for row in line.split("|")]
    return {word: meaning for words, meaning in rows for word in words.split()}


@token_filter()
def contraction_expand() -> Filter:
    known = entries(CONTRACTIONS)
    return rewrite(lambda t: F.coalesce(look_up(known, F.lower(t)), t))


def _meaning(text: str) -> Filter:
    known = entries(text)
    return tag(lambda t: look_up(known, F.lower(t)), lambda t: look_up(known, F.lower(t)).isNotNull())


@token_filter()
def abbreviation_expand() -> Filter:
    return _meaning(ABBREVIATIONS)


@token_filter()
def slang_norm() -> Filter:
    return _meaning(SLANG)


@token_filter()
def sentiment_tag() -> Filter:
    def name(t: Column) -> Column:
        return F.when(F.lower(t).isin(*POSITIVE.split()), "_sentiment:positive").when(F.lower(t).isin(*NEGATIVE.split()), "_sentiment:negative")

    return tag(name, lambda t: name(t).isNotNull())


@token_filter()
def mention_tag() -> Filter:
    bare = lambda t: F.substring(t, 2, 2_147_483_647)
    return tag(lambda t: string("_mention:", bare(t)), lambda t: t.rlike("(?s)^@."), term=bare)


@token_filter()
def hashtag_tag() -> Filter:
    bare = lambda t: F.lower(F.substring(t, 2, 2_147_483_647))
    return tag(lambda t: string("_hashtag:", bare(t)), lambda t: t.rlike("(?s)^#."), term=bare)


@token_filter()
def mention_remove() -> Filter:
    return drop(lambda t: F.startswith(t, F.lit("@")))


@token_filter()
def hashtag_remove() -> Filter:
    return drop(lambda t: F.startswith(t, F.lit("#")))


@token_filter()
def shouting_norm() -> Filter:
    """No letter that isn't upper case, and more than one byte."""
    quiet = r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]"
    return tag(lambda t: F.lit("_emphasis:shouting"), lambda t: (F.octet_length(t) > 1) & ~t.rlike(quiet), term=F.lower)


# Emoji.

#: What counts as emoji for the emoji filters, and for emoji_presence.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{200D}\x{2B50}]"
EMOJI_PRESENT = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{24C2}-\x{1F251}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F02F}]"
#: Names of the code points from U+1F600 on, then of single ones.
FACES = """
grinning_face beaming_face joy smiley smile sweat_smile laughing innocent smiling_imp wink blush yum relieved heart_eyes sunglasses smirk
neutral_face expressionless unamused sweat pensive confused confounded kissing kissing_heart kissing_smiling_eyes kissing_closed_eyes
stuck_out_tongue stuck_out_tongue_winking stuck_out_tongue_closed_eyes disappointed worried angry rage cry persevere triumph
disappointed_relieved frowning anguished fearful weary sleepy tired_face grimacing sob open_mouth hushed cold_sweat scream astonished flushed
sleeping dizzy_face no_mouth mask
"""
NAMED = """
1F44D thumbsup 1F44E thumbsdown 1F44F clap 1F44B wave 1F44C ok_hand 1F4AF hundred_points 1F525 fire 1F4A9 poop 1F4A5 boom 1F4AB dizzy
1F4AC speech_balloon 2764 red_heart 1F494 broken_heart 1F495 two_hearts 1F496 sparkling_heart 1F497 heartpulse 1F498 cupid 1F499 blue_heart
1F49A green_heart 1F49B yellow_heart 1F49C purple_heart 2B50 star 1F31F star2 1F308 rainbow 2600 sunny 1F327 rain 26A1 zap 1F4A1 bulb
1F389 tada 1F38A confetti_ball 1F3C6 trophy 1F680 rocket 2708 airplane 1F697 car 1F355 pizza 1F354 hamburger 1F35F fries 1F356 meat_on_bone
1F357 poultry_leg 1F349 watermelon 1F34E apple 1F34C banana 1F353 strawberry 1F36C candy 1F36B chocolate 1F366 ice_cream 1F370 cake
1F382 birthday_cake 1F36A cookie 2615 coffee 1F375 tea 1F37A beer 1F37B beers 1F377 wine_glass 1F374 cocktail 1F36E custard 1F36D lollipop
1F344 mushroom 26BD soccer 1F3C0 basketball 1F3C8 american_football 26F3 golf 1F3AF dart 1F3AE video_game 1F3B5 musical_note 1F4BB computer
1F4F1 phone 1F4BE floppy_disk 1F4DA books 1F4D6 open_book 270D writing_hand 1F58D crayon 1F4DD memo 1F4C8 chart_up 1F4C9 chart_down
1F9E0 brain 1F52D telescope 1F52E crystal_ball
"""
GLAD = r"[\x{1F600}-\x{1F60A}\x{1F60D}\x{1F60E}\x{1F618}-\x{1F61A}\x{1F44D}\x{1F44F}\x{1F4AF}\x{2764}\x{1F495}-\x{1F49C}\x{1F525}\x{1F389}\x{1F38A}\x{1F3C6}\x{1F680}\x{2B50}\x{1F31F}\x{1F308}]"
UNHAPPY = r"[\x{1F61E}-\x{1F625}\x{1F627}-\x{1F62D}\x{1F630}\x{1F631}\x{1F44E}\x{1F494}\x{1F4A9}]"
#: Emoticons.
EMOTICONS = {
    "smile": ":) :-) :D :-D =)", "sad": ":( :-( =(", "wink": ";) ;-)", "tongue": ":P :-P :p :-p", "heart": "<3", "broken_heart": "</3",
    "surprised": ":O :-O :o", "laughing": "XD xD", "angry": ">:( >:-(", "crying": ":'( :'‑(", "angel": "O:) 0:)", "devil": ">:) >:-)",
    "cool": "B) B-)", "skeptical": ":/ :-/", "neutral_face": ":| :-|",
}


def emoji_names() -> dict[str, str]:
    single = NAMED.split()
    faces = {chr(0x1F600 + k): name for k, name in enumerate(FACES.split())}
    return faces | {chr(int(code, 16)): name for code, name in zip(single[::2], single[1::2], strict=True)}


def _all(t: Column, pattern: str) -> Column:
    return F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))


@token_filter()
def emoji_to_text(keep_original: bool = False) -> Filter:
    """Names of a term's emoji joined by _; its other text is lost."""
    known = emoji_names()
    names = lambda t: F.array_join(F.transform(_all(t, "[" + "".join(known) + "]"), lambda c: look_up(known, c)), "_")
    if keep_original:
        return tag(names, lambda t: names(t) != "")
    return rewrite(lambda t: let(names(t), lambda n: F.when(n == "", t).otherwise(n)))


@token_filter()
def emoji_remove() -> Filter:
    return _without(EMOJI)


@token_filter()
def emoji_extract(remove_from_original: bool = False) -> Filter:
    found = lambda t: F.when(t.rlike(f"^{EMOJI}*$"), none()).otherwise(_all(t, EMOJI))
    if not remove_from_original:
        return inject(found)
    return inject(found, lambda t: F.when(t.rlike(f"^{EMOJI}*$"), t).otherwise(F.regexp_replace(t, EMOJI, "")))


@token_filter()
def emoji_sentiment() -> Filter:
    good, bad = lambda t: F.regexp_count(t, F.lit(GLAD)), lambda t: F.regexp_count(t, F.lit(UNHAPPY))
    name = lambda t: F.when(good(t) > bad(t), "positive").when(bad(t) > good(t), "negative").otherwise("neutral")
    return tag(lambda t: string("_sentiment:", name(t)), lambda t: (good(t) + bad(t)) > 0, unless="_sentiment:")


@token_filter()
def emoticon_to_text() -> Filter:
    known = {face: name for name, faces in EMOTICONS.items() for face in faces.split()}
    return rewrite(lambda t: F.coalesce(look_up(known, t), t))


# Unicode safety.

#: Characters without a form of their own, and look-alikes of ASCII letters.
INVISIBLE = r"[\x{200B}-\x{200F}\x{2028}\x{2029}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{FFF9}-\x{FFFB}\x{00AD}\x{034F}\x{061C}\x{180E}]"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}\x{2060}]"
BIDI = r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{061C}]"
LOOKS_LIKE = ("аеорсухАВЕКМНОРСТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxABEKMHOPCTXABEZHIKMNOPTYX")
SYMBOL_LETTERS = ("ⅰⅱℓℐℑℝℕℤℚℂ", "iilIIRNZQC")
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
ASCII = "".join(chr(c) for c in range(0x21, 0x7F))


def _without(pattern: str, drop_empty: bool = True) -> Filter:
    """Characters removed; a term that had nothing else goes."""

    def terms(t: Column) -> Column:
        bare = F.regexp_replace(t, pattern, "")
        return F.when((bare == "") & (t != ""), none()).otherwise(F.array(bare)) if drop_empty else F.array(bare)

    return expand(terms)


@token_filter()
def invisible_char_remove() -> Filter:
    return _without(INVISIBLE)


@token_filter()
def zero_width_remove() -> Filter:
    return _without(ZERO_WIDTH)


@token_filter()
def bidi_strip() -> Filter:
    return _without(BIDI)


@token_filter()
def diacritic_strip() -> Filter:
    return _without(r"[\x{0300}-\x{036F}]", drop_empty=False)


@token_filter()
def confusable_norm() -> Filter:
    return rewrite(lambda t: F.translate(t, LOOKS_LIKE[0] + FULL_WIDTH, LOOKS_LIKE[1] + ASCII))


@token_filter()
def homoglyph_norm() -> Filter:
    return rewrite(lambda t: F.translate(t, SYMBOL_LETTERS[0] + LOOKS_LIKE[0] + FULL_WIDTH, SYMBOL_LETTERS[1] + LOOKS_LIKE[1] + ASCII))


@token_filter()
def fullwidth_norm() -> Filter:
    return rewrite(lambda t: F.translate(t, FULL_WIDTH + "　", ASCII + " "))


@token_filter()
def mixed_script_detect() -> Filter:
    scripts = (r"[\p{IsAlphabetic}&&[\x{41}-\x{7A}\x{C0}-\x{24F}]]", r"[\p{IsAlphabetic}&&[\x{400}-\x{4FF}]]", r"[\p{IsAlphabetic}&&[\x{370}-\x{3FF}]]")
    return tag(lambda t: F.lit("_warning:mixed_script"), lambda t: sum((t.rlike(s).cast("int") for s in scripts), F.lit(0)) > 1)


@token_filter()
def emoji_presence() -> Filter:
    return tag(lambda t: F.lit("_has_emoji:true"), lambda t: t.rlike(EMOJI_PRESENT), unless="_has_emoji:")
