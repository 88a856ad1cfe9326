"""Stemmers whose endings depend on the stem: Brazilian Portuguese, Greek and Spanish plurals.

Words of scripts and forms that a stemmer doesn't know stay as they are; empty terms stay empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tokens import Filter, python_terms
from .registry import token_filter
from .stemmers import _folded, _quoted, _told, step, stemmer

# Spanish plurals: one CASE behind two word lists, so it stays a column expression.

#: Words that are no plurals, without accents.
SPANISH_INVARIANT = """
abrebotellas abrecartas abrelatas afueras albatros albricias aledaños alexis alicates analisis andurriales antitesis añicos apendicitis apocalipsis
arcoiris aries bilis boletus boris brindis cactus canutas caries cascanueces cascarrabias ciempies cifosis cortaplumas corpus cosmos cosquillas creces
crisis cuatrocientas cuatrocientos cuelgacapas cuentacuentos cuentapasos cumpleaños doscientas doscientos dosis enseres entonces esponsales estatus
exequias fauces forceps fotosintesis gafas gafotas gargaras gris honorarios ictus jueves lapsus lavacoches lavaplatos limpiabotas lunes maitines martes
mondadientes novecientas novecientos nupcias ochocientas ochocientos pais paris parabrisas paracaidas parachoques paraguas pararrayos pisapapeles piscis
portaaviones portamaletas portamantas quinientas quinientos quitamanchas recogepelotas rictus rompeolas sacacorchos sacapuntas saltamontes salvavidas
seis seiscientas seiscientos setecientas setecientos sintesis tenis tifus trabalenguas vacaciones venus versus viacrucis virus viveres volandas
""".split()
#: Words that lose two letters whatever the rules say.
SPANISH_SHORTENED = "yoes noes sies clubes faralaes albalaes itemes albumes sandwiches relojes bojes contrarreloj carcajes".split()


def _spanish_plural():
    fold = _folded()
    rules = step((0, "([^aeiou])s", "$1"), (4, "([qg]u[ie])s", "$1"), (4, "([aeiou][rdlnx])es", "$1"), (3, "([yu])es", "$1"), (4, "([ulrtn]i)es", "$1"), (3, "ses", "s"),
                 (3, "([aeiou])is", "$1y"), (3, "dis", "dy"), (3, "ces", "z"), (0, "([aeiou])s", "$1"))

    def run(t: Column) -> Column:
        low, plain = F.lower(fold(t)), fold(t)
        return F.when(low.isin(*SPANISH_INVARIANT), plain).when(low.isin(*SPANISH_SHORTENED), F.left(plain, F.length(t) - 2)).otherwise(rules(plain))

    of = lambda words: ", ".join(map(_quoted, words))
    lists = f"case when lower({{t}}) in ({of(SPANISH_INVARIANT)}) then {{t}} when lower({{t}}) in ({of(SPANISH_SHORTENED)}) then left({{t}}, length({{t}}) - 2) else {rules.sql[0]} end"
    return _told(run, *fold.sql, lists)


stemmer("spanish_plural_stem", _spanish_plural(), 4)

# Brazilian Portuguese: an ending goes where it lies wholly in a region behind the first syllables.

#: Endings of the first step, with what replaces them; they lie in the second region if not told otherwise.
BRAZILIAN_NOUNS = """
uciones:u imentos amentos adores adoras logias:log encias:ente amente@1 idades acoes imento amento adora ismos istas logia:log ucion:u encia:ente mente
idade acao ezas icos icas ismo avel ivel ista osos osas ador ivas ivos iras:ir@e eza ico ica oso osa iva ivo ira:ir@e
""".split()
#: Verb endings, longest first.
BRAZILIAN_VERBS = """
issemos essemos assemos ariamos eriamos iriamos iremos eremos aremos avamos iramos eramos aramos asseis esseis isseis arieis erieis irieis irmos iamos
armos ermos areis ereis ireis asses esses isses astes assem essem issem ardes erdes irdes ariam eriam iriam arias erias irias estes istes aveis aria eria
iria asse esse isse aste este iste arei erei irei aram eram iram avam arem erem irem ando endo indo arao erao irao adas idas aras eras iras avas ares eres
ires ados idos amos emos imos ieis ada ida ara era ira iam ado ido ias ais eis ear ia ei am em ar er ir as es is eu iu ou
""".split()
BRAZILIAN_LETTERS = str.maketrans("áâãéêíóôõúüçñ", "aaaeeiooouucn")
_BEHIND = re.compile("[^aeiou]*[aeiou]+[^aeiou](.+)", re.S)
_VERB_REGION = re.compile("(?:.[^aeiou]+[aeiou]|[aeiou]{2,}[^aeiou]|...)(.+)", re.S)


def brazilian(term: str) -> str:
    """Noun endings, else verb endings, else a last vowel; then a last e."""
    word = re.sub("[-,;.?!'\"]\\Z", "", re.sub("\\A[\"'\\-,;.?!](?=.)", "", term.lower().translate(BRAZILIAN_LETTERS)))
    if not 2 < len(word) < 30:
        return term
    if not word.isalpha():
        return word

    def behind(pattern: re.Pattern, text: str) -> str:
        m = pattern.match(text)
        return m[1] if m else ""

    first = behind(_BEHIND, word)
    second, verbs = behind(_BEHIND, first), behind(_VERB_REGION, word)
    out = None
    for entry in BRAZILIAN_NOUNS:
        rule, _, where = entry.partition("@")
        ending, _, to = rule.partition(":")
        region = {"": second, "1": first, "e": verbs}[where]
        if region.endswith(ending) and (where != "e" or word.endswith("e" + ending)):
            out = word[: -len(ending)] + to
            break
    if out is None:
        ending = next((e for e in BRAZILIAN_VERBS if verbs.endswith(e)), None) or next((e for e in ("os", "a", "i", "o") if verbs.endswith(e)), "")
        out = word.removesuffix(ending)
    if verbs.endswith("e"):
        out = out.removesuffix("e")
        silent = "u" if verbs.endswith("gue") else "i" if verbs.endswith("cie") else ""
        out = out.removesuffix(silent)
    return out


@token_filter()
def brazilian_stem() -> Filter:
    return python_terms(brazilian)


# Greek: cuts in turn; some stems get a part of the ending back.

_VOWEL, _OPEN = "αεηιουω", "αεηιοω"


def _stems(whole: str = "", tails: str = "", vowels: str = "") -> re.Pattern:
    """Stems that equal one of whole or end with one of tails or vowels."""
    ends = [*tails.split(), *([f"[{vowels}]"] if vowels else [])]
    return re.compile("|".join([*whole.split(), *([f".*(?:{'|'.join(ends)})"] if ends else [])]) or "(?!)", re.S)


#: Irregular words, whose endings are what follows the mark.
GREEK_IRREGULAR = """
καθεστ|ωτοσ καθεστ|ωτων γεγον|οτοσ γεγον|οτων καθεστ|ωτα τατο|γιου τατο|γιων γεγον|οτα καθεστ|ωσ σκα|γιου σκα|γιων ολο|γιου ολο|γιων κρε|ατοσ κρε|ατων περ|ατοσ περ|ατων
τερ|ατοσ τερ|ατων τατο|για γεγον|οσ φα|γιου φα|γιων σο|γιου σο|γιων σκα|για ολο|για κρε|ατα περ|ατα τερ|ατα φα|για σο|για φω|τοσ φω|των κρε|ασ περ|ασ τερ|ασ φω|τα φω|σ
""".split()
#: Endings behind at least one letter (those after a slash: behind any or none), what a stem gets back, and the stems that do.
GREEK = [
    ("εωσ εων", "ε", _stems("θ δ ελ γαλ ν π ιδ παρ")),
    ("ια ιου ιων", "ι", _stems(vowels=_VOWEL)),
    ("ικα ικο ικου ικων", "ικ", _stems("αλ αδ ενδ αμαν αμμοχαλ ηθ ανηθ αντιδ φυσ βρωμ γερ εξωδ καλπ καλλιν καταδ μουλ μπαν μπαγιατ μπολ μποσ νιτ ξικ συνομηλ πετσ πιτσ πικαντ "
                                       "πλιατσ ποστελν πρωτοδ σερτ συναδ τσαμ υποδ φιλον φυλοδ χασ", vowels=_VOWEL)),
    ("ηθηκαμε ουσαμε αγαμε ησαμε ηκαμε", "", _stems()),
    ("αμε", "αμ", _stems("αναπ αποθ αποκ αποστ βουβ ξεθ ουλ πεθ πικρ ποτ σιχ χ")),
    ("ιουντανε ιοντανε ιοτανε αγανε / ουντανε ηθηκανε οντανε ουσανε ησανε οτανε ηκανε", "αγαν", _stems("τρ τσ")),
    ("ανε", "αν", _stems("βετερ βουλκ βραχμ γ δραδουμ θ καλπουζ καστελ κορμορ λαοπλ μωαμεθ μ μουσουλμ ν ουλ π πελεκ πλ πολισ πορτολ σαρακατσ σουλτ τσαρλατ ορφ τσιγγ τσοπ φωτοστεφ χ "
                         "ψυχοπλ αγ γαλ γερ δεκ διπλ αμερικαν ουρ πιθ πουριτ σ ζωντ ικ καστ κοπ λιχ λουθηρ μαιντ μελ σιγ σπ στεγ τραγ τσαγ φ ερ αδαπ αθιγγ αμηχ ανικ ανοργ απηγ απιθ "
                         "ατσιγγ βασ βασκ βαθυγαλ βιομηχ βραχυκ διατ διαφ ενοργ θυσ καπνοβιομηχ καταγαλ κλιβ κοιλαρφ λιβ μεγλοβιομηχ μικροβιομηχ νταβ ξηροκλιβ ολιγοδαμ ολογαλ "
                         "πενταρφ περηφ περιτρ πλατ πολυδαπ πολυμηχ στεφ ταβ τετ υπερηφ υποκοπ χαμηλοδαπ ψηλοταβ", vowels=_OPEN)),
    ("ησετε", "", _stems()),
    ("ετε", "ετ", _stems("αβαρ βεν εναρ αβρ αδ αθ αν απλ βαρον ντρ σκ κοπ μπορ νιφ παγ παρακαλ σερπ σκελ συρφ τοκ υ δ εμ θαρρ θ",
                         "οδ αιρ φορ ταθ διαθ σχ ενδ ευρ τιθ υπερθ ραθ ενθ ροθ σθ πυρ αιν συνδ συν συνθ χωρ πον βρ καθ ευθ εκθ νετ ρον αρκ βαρ βολ ωφελ", _OPEN)),
    ("οντασ ωντασ", "", _stems()),
    ("ομαστε", "ομαστ", _stems("ον")),
    ("ιεστε", "ιεστ", _stems("π απ συμπ ασυμπ ακαταπ αμεταμφ")),
    ("εστε", "εστ", _stems("αλ αρ εκτελ ζ μ ξ παρακαλ προ νισ")),
    ("ηθηκεσ ηθηκα ηθηκε", "", _stems()),
    ("ηκεσ ηκα ηκε", "ηκ", _stems("διαθ θ παρακαταθ προσθ συνθ", "σκωλ σκουλ ναρθ σφ οθ πιθ")),
    ("ουσεσ ουσα ουσε", "ουσ", _stems("φαρμακ χαδ αγκ αναρρ βρομ εκλιπ λαμπιδ λεχ μ πατ ρ λ μεδ μεσαζ υποτειν αμ αιθ ανηκ δεσποζ ενδιαφερ δε δευτερευ καθαρευ πλε τσα",
                                      "ποδαρ βλεπ πανταχ φρυδ μαντιλ μαλλ κυματ λαχ ληγ φαγ ομ πρωτ", _VOWEL)),
    ("αγεσ αγα αγε", "αγ", _stems("αβαστ πολυφ αδηφ παμφ ρ ασπ αφ αμαλ αμαλλι ανυστ απερ ασπαρ αχαρ δερβεν δροσοπ ξεφ νεοπ νομοτ ολοπ ομοτ προστ προσωποπ συμπ συντ τ υποτ χαρ αειπ αιμοστ "
                                  "ανυπ αποτ αρτιπ διατ εν επιτ κροκαλοπ σιδηροπ λ ναυ ουλαμ ουρ π τρ μ", "οφ πελ χορτ λλ σφ ρπ φρ πρ λοχ σμην")),
    ("ησου ησε ησα", "ησ", _stems("ν χερσον δωδεκαν ερημον μεγαλον επταν")),
    ("ηστε", "ηστ", _stems("ασβ σβ αχρ χρ απλ αειμν δυσχρ ευχρ κοινοχρ παλιμψ")),
    ("ησουνε ηθουνε ουνε", "ουν", _stems("ν ρ σπι στραβομουτσ κακομουτσ εξων")),
    ("ησουμε ηθουμε ουμε", "ουμ", _stems("παρασουσ φ χ ωριοπλ αζ αλλοσουσ ασουσ")),
]
#: Stems of the cut -αγ- that don't get it back although the table above says so.
GREEK_NOT_BACK = _stems("ψοφ ναυλοχ", "κολλ")
#: Diminutives and patronymics; of the first only the listed stems lose the whole ending.
GREEK_PLURALS = [
    ("αδεσ αδων", "αδ", re.compile("(?!.*(?:οκ|μαμ|μαν|μπαμπ|πατερ|γιαγι|νταντ|κυρ|θει|πεθερ)\\Z).*", re.S)),
    ("εδεσ εδων", "εδ", _stems(tails="οπ ιπ εμπ υπ γηπ δαπ κρασπ μιλ")),
    ("ουδεσ ουδων", "ουδ", _stems(tails="αρκ καλιακ πεταλ λιχ πλεξ σκ σ φλ φρ βελ λουλ χν σπ τραγ φε")),
]
#: Endings of words that no rule above has shortened, longest first.
GREEK_LAST = """
ιοντουσαν ιομασταν ιοσασταν ιουμαστε οντουσαν ιεμαστε ιεσαστε ιομουνα ιοσαστε ιοσουνα ιουνται ιουνταν ηθηκατε ομασταν οσασταν ουμαστε ιομουν ιονταν ιοσουν ηθειτε
ηθηκαν ομουνα οσαστε οσουνα ουνται ουνταν ουσατε αγατε ιεμαι ιεται ιεσαι ιοταν ιουμα ηθεισ ηθουν ηκατε ησατε ησουν ομουν ονται ονταν οσουν ουμαι ουσαν αγαν αμαι
ασαι αται ειτε εσαι εται ηδεσ ηδων ηθει ηκαν ησαν ησει ησεσ ομαι οταν αει εισ ηθω ησω ουν ουσ αν ασ αω ει εσ ησ οι οσ ου υσ ων α ε η ι ο υ ω
""".split()
GREEK_DEGREES = re.compile("(?:εστερ|εστατ|οτερ|οτατ|υτερ|υτατ|ωτερ|ωτατ)\\Z")


def _ending(words: str) -> re.Pattern:
    """A word's ending, behind a letter, or behind any number of letters if it stands after a slash; the longest one."""
    some, _, free = words.partition("/")
    return re.compile("|".join([*(f"(?<=.){w}" for w in some.split()), *free.split()]).join(["(?:", ")\\Z"]), re.S)


_GREEK_CUTS = [(_ending(words), back, kept) for words, back, kept in [*GREEK_PLURALS, *GREEK]]
_GREEK_LAST = _ending(" ".join(GREEK_LAST))
_GREEK_IRREGULAR = re.compile("(?:" + "|".join(f"(?<={w.split('|')[0]}){w.split('|')[1]}" for w in GREEK_IRREGULAR) + ")\\Z")


def greek(term: str) -> str:
    """On terms in lower case without accents and final sigmas; a stem of fewer than three letters leaves the term."""
    if len(term) < 4:
        return term
    word = "αγαμ" if term == "αγαμε" else _GREEK_IRREGULAR.sub("", term)
    for ending, back, kept in _GREEK_CUTS:
        found = ending.search(word)
        if not found:
            continue
        stem = word[: found.start()]
        if found[0] in ("οντασ", "ωντασ"):
            back = "οντ" if stem == "αρχ" else "ωντ" if stem.endswith("κρε") else ""
            word = stem + back
        else:
            word = stem + back if kept.fullmatch(stem) and not (back == "αγ" and GREEK_NOT_BACK.fullmatch(stem)) else stem
    word = re.sub("(?<=.μα)(?:των|τοσ|τα)\\Z", "", word)
    if len(word) == len(term):
        word = _GREEK_LAST.sub("", word, count=1)
    word = GREEK_DEGREES.sub("", word)
    return word if 3 <= len(word) < len(term) else term


@token_filter()
def greek_stem() -> Filter:
    return python_terms(greek)
