"""SQL of term filters: list expressions over `term` whose elements are the results."""

from __future__ import annotations

from ..functions import folding, social_and_unicode, stemmers


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def translate(old: str, new: str, term: str = "term") -> str:
    return f"translate({term}, {quoted(old)}, {quoted(new)})"


def one(expression: str) -> str:
    return f"[{expression}]"


def unless_empty(expression: str, kept: str = "false") -> str:
    """Empty results are dropped, but where `kept` holds."""
    return f"case when {expression} = '' and not ({kept}) then [] else [{expression}] end"


def reversed_(term: str = "term") -> str:
    """By code points; the engine's own function goes by grapheme clusters."""
    return f"array_to_string(list_reverse(regexp_extract_all({term}, '(?s).')), '')"


def tagged(value: str, when: str = "true") -> str:
    return f"case when {when} then [term, {value}] else [term] end"


def without(pattern: str) -> str:
    return unless_empty(f"regexp_replace(term, {quoted(pattern)}, '', 'g')", "term = ''")


def parts(marked: str) -> str:
    """The lower-case parts between marks, after the term, if there are several."""
    found = f"list_transform(list_filter(string_split({marked}, chr(1)), lambda p: p <> ''), lambda p: lower(p))"
    return f"[term] || case when len({found}) > 1 then {found} else [] end"


_CAPITAL = "upper(replace({0}[1:1], 'ß', 'SS')) || {0}[2:]"
_LETTER = r"[\p{L}\p{Nl}]"
_FIRST = f"regexp_extract(term, '{_LETTER}')"
_BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SCRIPTS = [
    (r"[\x00-\x7f]", "latin", "en"), (r"[\x{400}-\x{4ff}]", "cyrillic", "ru"), (r"[\x{370}-\x{3ff}]", "greek", "en"), (r"[\x{600}-\x{6ff}]", "arabic", "ar"), (r"[\x{590}-\x{5ff}]", "hebrew", "en"),
    (r"[\x{900}-\x{97f}]", "devanagari", "hi"), (r"[\x{4e00}-\x{9fff}]", "cjk", "zh"), (r"[\x{3040}-\x{309f}]", "hiragana", "ja"), (r"[\x{30a0}-\x{30ff}]", "katakana", "ja"),
    (r"[\x{ac00}-\x{d7af}]", "hangul", "ko"), (r"[\x{e00}-\x{e7f}]", "thai", "th"),
]
_MIXED = [
    r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]", r"[\x{400}-\x{481}\x{48A}-\x{4FF}]",
    r"[\x{370}-\x{373}\x{376}\x{377}\x{37A}-\x{37D}\x{37F}\x{386}\x{388}-\x{38A}\x{38C}\x{38E}-\x{3A1}\x{3A3}-\x{3F5}\x{3F7}-\x{3FF}]",
]
_HARAKAT = "".join(map(chr, range(0x064B, 0x0653)))


def _first_letter(column: int, nothing: str, other: str) -> str:
    cases = " ".join(f"when regexp_matches({_FIRST}, '^{row[0]}') then '{row[column]}'" for row in _SCRIPTS)
    return f"case when {_FIRST} = '' then '{nothing}' {cases} else '{other}' end"


def _entropy() -> str:
    return "coalesce(list_aggregate(regexp_extract_all(hex(encode(term)), '..'), 'entropy'), 0)"


def term_sql() -> dict[str, str]:
    u, fullwidth, ascii_ = social_and_unicode, social_and_unicode.FULL_WIDTH, social_and_unicode.ASCII
    digits = "".join(chr(int(b, 16) + k) for b in folding.DIGIT_BLOCKS for k in range(10))
    kept = "array_to_string(list_transform(list_filter(range(1, length(term) + 1), lambda i: {test}), lambda i: term[i:i]), '')"
    low = "lower(term)"
    head = f"case when regexp_matches({low}, '^[^aeiou]+[aeiou]') then regexp_extract({low}, '^[^aeiou]+') else {low}[1:1] end"
    elided = r"regexp_extract(term, '(?s)^([^''’]*[''’]).', 1)"
    virama = r"regexp_replace(regexp_replace(term, '[नऩ][़\x{200C}\x{200D}]*्', 'ं', 'g'), '[़\x{200C}\x{200D}्]', '', 'g')"
    out = {
        "trim": unless_empty(f"regexp_replace(term, '^{_BLANK}+|{_BLANK}+$', '', 'g')"),
        "capitalization": one(_CAPITAL.replace("{0}[2:]", "lower({0}[2:])").format("term")),
        "sentence_case": f"[case when starts_with(term, '_mention:') then term else {_CAPITAL.replace('{0}[2:]', 'lower({0}[2:])').format('term')} end]",
        "pascal_case": f"[array_to_string(list_transform(regexp_split_to_array(term, '[_ -]'), lambda p: {_CAPITAL.format('p')}), '')]",
        "camel_case": f"[array_to_string(list_transform(regexp_split_to_array(term, '[_ -]'), lambda p, i: case when i > 1 then {_CAPITAL.format('p')} else lower(p[1:1]) || p[2:] end), '')]",
        "word_reverse": f"[array_to_string(list_transform(string_split(term, ' '), lambda p: {reversed_('p')}), ' ')]",
        "pig_latin": f"[case when term = '' then '' when regexp_matches({low}, '^[aeiou]') then {low} || 'way' else {low}[length({head}) + 1:] || {head} || 'ay' end]",
        "collapse_repeats": one(kept.format(test="i = 1 or term[i:i] <> term[i - 1:i - 1]")),
        "stretched_word_norm": one(kept.format(test="i < 3 or term[i:i] <> term[i - 1:i - 1] or term[i:i] <> term[i - 2:i - 2]")),
        "rot13": one(translate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM")),
        "camel_case_split": parts("regexp_replace(term, '([a-z])([A-Z])', '\\1' || chr(1) || '\\2', 'g')"),
        "syllable_count": tagged(
            f"'_syllables:' || case when term = '' then 0 else greatest(1, len(regexp_extract_all({low}, '[aeiouy]+')) - case when regexp_matches({low}, '(?s)^..*[^aeiou]e$') and length(term) > 2 and len(regexp_extract_all({low}, '[aeiouy]+')) > 1 then 1 else 0 end) end",
            "not starts_with(term, '_syllables:')",
        ),
        "entropy": tagged(f"'_entropy:' || case when {_entropy()} < 2.0 then 'low' when {_entropy()} < 4.0 then 'medium' else 'high' end", "not starts_with(term, '_entropy:')"),
        "entropy_filter": f"case when {_entropy()} > 4.5 then [] else [term] end",
        "script_tag": tagged("'_script:' || " + _first_letter(1, "unknown", "other"), "not starts_with(term, '_script:')"),
        "language_tag": tagged("'_lang:' || " + _first_letter(2, "und", "en"), "not starts_with(term, '_lang:')"),
        "uuid_detect": tagged("'_type:uuid'", "regexp_full_match(term, '[0-9a-fA-F-]{8}-[0-9a-fA-F-]{4}-[0-9a-fA-F-]{4}-[0-9a-fA-F-]{4}-[0-9a-fA-F-]{12}')"),
        "invisible_char_remove": without(u.INVISIBLE),
        "zero_width_remove": without(u.ZERO_WIDTH),
        "bidi_strip": without(u.BIDI),
        "confusable_norm": one(translate(u.LOOKS_LIKE[0] + fullwidth, u.LOOKS_LIKE[1] + ascii_)),
        "homoglyph_norm": one(translate(u.SYMBOL_LETTERS[0] + u.LOOKS_LIKE[0] + fullwidth, u.SYMBOL_LETTERS[1] + u.LOOKS_LIKE[1] + ascii_)),
        "fullwidth_norm": one(translate(fullwidth + "　", ascii_ + " ")),
        "mixed_script_detect": tagged("'_warning:mixed_script'", " + ".join(f"regexp_matches(term, '{s}')::int" for s in _MIXED) + " > 1"),
        "emoji_presence": tagged("'_has_emoji:true'", f"regexp_matches(term, '{u.EMOJI_PRESENT}') and not starts_with(term, '_has_emoji:')"),
        "apostrophe": unless_empty("case when contains(term, '''') then split_part(term, '''', 1) when contains(term, '’') then split_part(term, '’', 1) else term end"),
        "arabic_normalization": one(translate("آأإىةـ" + _HARAKAT, "ااايه")),
        "persian_normalization": one(translate("یےکۀۂـ" + _HARAKAT, "ييكهه")),
        "bengali_normalization": one(translate("\u0981\u09dc\u09dd\u09df\u09c8\u09cc\u09e1\u09e3\u09bc", "\u0982\u09a1\u09a2\u09af\u09c7\u09cb\u09e0\u09e2")),
        "hindi_normalization": one(translate(folding.HINDI_FROM, folding.HINDI_TO, virama)),
        "decimal_digit": one(translate(digits, "0123456789" * len(folding.DIGIT_BLOCKS))),
        "elision": f"[case when {elided} <> '' and lower(left({elided}, length({elided}) - 1)) in ('l', 'd', 'qu', 'm', 'n', 's', 't') then term[length({elided}) + 1:] else term end]",
        "greek_lowercase": one("lower(" + translate("ςΆάΈέΉήΊΪίϊΐΎΫύϋΰΌόΏώ", "σααεεηηιιιιιυυυυυοοωω") + ")"),
        "turkish_lowercase": one("lower(" + translate("İI", "iı") + ")"),
        "irish_elision": "[case when length(term) < 3 then term else regexp_replace(term, '^([dDmMbB]''|[nth]-)', '') end]",
        "delimited_payload": unless_empty("split_part(term, '|', 1)"),
        "delimited_term_freq": unless_empty("split_part(term, '|', 1)"),
        "delimited_boost": "case when contains(term, '|') and not starts_with(term, '_boost:') then [split_part(term, '|', 1), '_boost:' || term[position('|' in term) + 1:]] else [term] end",
        "conditional": "[case when starts_with(term, 's') then upper(replace(term, 'ß', 'SS')) else term end]",
        "multiplexer": f"[term] || list_filter([lower(term)], lambda x: x <> term) || list_filter([{reversed_()}], lambda x: x <> term)",
        "keyword_marker": f"[case when term in ('the', 'Hello', 'sooooo') then term else {reversed_()} end]",
        "protected_words": f"[case when term in ('the', 'Hello', 'sooooo') then term else {reversed_()} end]",
    }
    return out


def stemmer_query(name: str, terms: str) -> str:
    """Each step of the stemmer's rules is one column of a subquery."""
    steps, least = stemmers.SQL[name]
    inner = "select term, n, term as t from w"
    for s in steps:
        inner = f"select term, n, {s.format(t='t')} as t from ({inner})"
    return f"{terms} select term, case when length(term) < {least} then term else t end as out, n from ({inner})"


# Analyzers.

_W = r"[\p{L}\p{M}\p{N}_]"
#: The words of the standard tokenizer without looking around; ideographs and hiragana, which stand alone there, are not told apart.
_STANDARD = rf"(?:{_W}*(?:\p{{L}}(?:[''’.:·]\p{{L}})+|\p{{N}}(?:[.,;'']\p{{N}})+))+{_W}*|{_W}+"
_TOKENS = {"standard": f"regexp_extract_all(text, '{_STANDARD}')"}


def analyzer_query(spec, lists: dict[str, str], stop_words) -> str | None:
    """tf and df of every term, each filter of the specification one subquery; None where a part has no SQL."""
    if spec.normalizers or spec.custom or spec.tokenizer[0] not in _TOKENS or spec.tokenizer[1]:
        return None
    q = f"select doc_id, term, count(*) as n from (select doc_id, unnest({_TOKENS[spec.tokenizer[0]]}) as term from documents) group by doc_id, term"
    for name, params in spec.filters:
        if name == "stop":
            words = stop_words(params.get("words", "english"))
            q = f"select * from ({q}) where term not in ({', '.join(map(quoted, words))})"
        elif params or (name not in lists and name not in stemmers.SQL):
            return None
        elif name in stemmers.SQL:
            steps, least = stemmers.SQL[name]
            q = f"select doc_id, n, term, term as t from ({q})"
            for s in steps:
                q = f"select doc_id, n, term, {s.format(t='t')} as t from ({q})"
            q = f"select doc_id, n, case when length(term) < {least} then term else t end as term from ({q})"
        else:
            q = f"select doc_id, n, unnest({lists[name]}) as term from ({q})"
    return f"select term, sum(n)::bigint as tf, count(distinct doc_id) as df from ({q}) group by term"
