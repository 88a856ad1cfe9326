"""Analyzers: normalizers, one tokenizer, filters, compiled to one column expression.

An analyzer is a plain specification. Compiled, it is a function from a text
column to a token column: no shuffle, no state beyond a row, so it runs in batch,
in SQL and on streams alike. Where only terms are wanted, tokenizers that are one
pattern run in the JVM without offsets.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as _functions
from ..data.stopwords import WORDS
from ..functions.registry import ANALYZERS, FILTERS, NORMALIZERS, TOKENIZERS
from ..shipping import ship
from ..tokens import chain, terms, unique_terms

Part = tuple[str, dict[str, Any]]


def part(spec: str | Part) -> Part:
    return (spec, {}) if isinstance(spec, str) else spec


@dataclass(frozen=True)
class Analyzer:
    tokenizer: Part = ("standard", {})
    filters: tuple[Part, ...] = ()
    normalizers: tuple[Part, ...] = ()
    custom: tuple = field(default=())  # filters given as functions, after the named ones

    def tokens(self, text: Column, offsets: bool = True) -> Column:
        for name, params in self.normalizers:
            text = NORMALIZERS[name](**params)(text)
        name, params = self.tokenizer
        out = TOKENIZERS[name](**params)(text, offsets)
        return chain(*[FILTERS[n](**p) for n, p in self.filters], *self.custom)(out)

    def terms(self, text: Column) -> Column:
        return terms(self.tokens(text, offsets=False))

    def unique_terms(self, text: Column) -> Column:
        return unique_terms(self.tokens(text, offsets=False))

    def explode(self, docs: DataFrame, key: str, text: str = "text", offsets: bool = True) -> DataFrame:
        """key, ord, term, start_offset, end_offset, position: one row per token."""
        found = docs.select(F.col(key), F.posexplode(self.tokens(F.col(text), offsets)).alias("ord", "t"))
        return found.select(key, "ord", "t.term", "t.start_offset", "t.end_offset", "t.position")


class Builder:
    """Collects parts by name; a second tokenizer replaces the first."""

    def __init__(self) -> None:
        self._normalizers: list[Part] = []
        self._filters: list[Part] = []
        self._tokenizer: Part = ("standard", {})

    def normalizer(self, name: str, **params: Any) -> Builder:
        self._normalizers.append((name, params))
        return self

    def tokenizer(self, name: str, **params: Any) -> Builder:
        self._tokenizer = (name, params)
        return self

    def filter(self, name: str, **params: Any) -> Builder:
        self._filters.append((name, params))
        return self

    def filters(self, *names: str | Part) -> Builder:
        self._filters += [part(n) for n in names]
        return self

    def build(self) -> Analyzer:
        return Analyzer(self._tokenizer, tuple(self._filters), tuple(self._normalizers))


def from_names(normalizers=(), tokenizer: str = "standard", filters=(), lenient: bool = False) -> Analyzer | None:
    """By component names. lenient: unknown normalizers and filters are passed over and
    an unknown tokenizer gives None; else they are errors."""
    lists = ((NORMALIZERS, normalizers), (FILTERS, filters))
    if lenient:
        if tokenizer not in TOKENIZERS:
            return None
        normalizers, filters = ([n for n in names if n in known] for known, names in lists)
    elif unknown := [n for known, names in (*lists, (TOKENIZERS, [tokenizer])) for n in names if n not in known]:
        raise KeyError(f"unknown components: {unknown}")
    return Analyzer((tokenizer, {}), tuple(map(part, filters)), tuple(map(part, normalizers)))


def _spec(text: str) -> Analyzer:
    """`standard | lowercase | stop words=french | ...`, parameters as name=value."""

    def one(piece: str) -> Part:
        name, *params = piece.split()
        return name, dict(p.split("=", 1) for p in params)

    first, *rest = map(one, text.split("|"))
    return Analyzer(first, tuple(rest))


#: The filters between the standard tokenizer, lower case and stop words and the end, by language.
PIPELINES = """
afrikaans: ; amharic: ; armenian: armenian_stem ; azerbaijani: ; basque: basque_stem ; brazilian: brazilian_stem ; bulgarian: bulgarian_stem
croatian: croatian_stem ; czech: czech_stem ; danish: scandinavian_normalization scandinavian_folding ; dutch: dutch_stem ; estonian: estonian_stem
filipino: ; finnish: finnish_light_stem ; galician: galician_stem ; georgian: ; german: german_normalization german_light_stem
hungarian: hungarian_light_stem ; indonesian: indonesian_stem ; latvian: latvian_stem ; lithuanian: lithuanian_stem ; malay: ; mongolian:
norwegian: norwegian_light_stem ; polish: polish_stem ; portuguese: portuguese_light_stem ; romanian: romanian_normalization
serbian: serbian_normalization ; slovak: slovak_stem ; slovenian: slovenian_stem ; spanish: spanish_light_stem ; swahili: ; swedish: swedish_stem
tagalog: ; ukrainian: ukrainian_stem ; vietnamese:
"""
#: Pipelines of another shape.
OTHERS = {
    "arabic": "standard | lowercase | decimal_digit | arabic_normalization | stop words=arabic | arabic_stem",
    "bengali": "standard | lowercase | decimal_digit | indic_normalization | bengali_normalization | stop words=bengali | bengali_stem",
    "catalan": "standard | elision articles=l,d,qu,m,n,s | lowercase | stop words=catalan | catalan_stem",
    "cjk": "standard cjk_runs=1 | cjk_width | lowercase | cjk_bigram | stop words=cjk",
    "english": "standard | apostrophe | lowercase | stop words=english | kstem",
    "french": "standard | elision articles=french | lowercase | stop words=french | french_light_stem",
    "greek": "standard | greek_lowercase | stop words=greek | greek_stem",
    "hindi": "standard | lowercase | decimal_digit | indic_normalization | hindi_normalization | stop words=hindi | hindi_stem",
    "irish": "standard | irish_elision | irish_lowercase | stop words=irish",
    "italian": "standard | elision articles=l,dell,all,dall,sull,nell,un,quest,quell | lowercase | stop words=italian | italian_light_stem",
    "marathi": "standard | lowercase | decimal_digit | indic_normalization | stop words=marathi",
    "nepali": "standard | lowercase | decimal_digit | indic_normalization | stop words=nepali",
    "russian": "standard | lowercase | russian_yo_normalization | stop words=russian | russian_light_stem",
    "sorani": "standard | sorani_normalization | lowercase | decimal_digit | stop words=sorani",
    "tamil": "standard | lowercase | decimal_digit | indic_normalization | stop words=tamil | tamil_stem",
    "thai": "thai | lowercase | decimal_digit | stop words=thai",
    "turkish": "standard | apostrophe | turkish_lowercase | stop words=turkish",
    "urdu": "standard | lowercase | decimal_digit | indic_normalization | stop words=urdu",
    "fingerprint": "standard | lowercase | asciifolding | stop words=english | fingerprint",
    "simple": "letter | lowercase",
    "stop": "letter | lowercase | stop words=english",
    "keyword": "keyword",
    "pattern": "pattern | lowercase",
    "whitespace": "whitespace",
    "hebrew": "standard | hebrew_niqqud_remove | hebrew_final_form_norm | lowercase | stop words=hebrew | hebrew_stem",
    "yiddish": "standard | yiddish_normalization | yiddish_stem",
    "scottish_gaelic": "standard | lowercase | scottish_gaelic_lenition | scottish_gaelic_stop",
    "tibetan": "standard | tibetan_tsek_segment | tibetan_punctuation_remove | tibetan_stop_syllable",
    "welsh": "standard | lowercase | welsh_mutation_norm | welsh_stop",
    "cherokee": "standard | cherokee_normalization",
    "khmer": "standard | khmer_word_boundary | khmer_sign_remove",
    "quechua": "standard | lowercase | quechua_stop | quechua_stem",
    "guarani": "standard | guarani_normalization | lowercase | guarani_stop | guarani_stem",
    "navajo": "standard | navajo_normalization | lowercase | navajo_stop | navajo_stem",
    "nahuatl": "standard | lowercase | nahuatl_stop | nahuatl_stem",
    "aymara": "standard | lowercase | aymara_stop | aymara_stem",
}


def _listed() -> dict[str, Analyzer]:
    out = {}
    for entry in PIPELINES.replace("\n", " ; ").split(" ; "):
        name, found, rest = entry.partition(":")
        if found:
            out[name.strip()] = _spec(" | ".join(["standard", "lowercase", f"stop words={name.strip()}", *rest.split()]))
    for name, text in OTHERS.items():
        out[name] = _spec(text)
    arabic = out["arabic"].filters[:3]
    persian = Analyzer(("standard", {}), (*arabic, ("persian_normalization", {}), ("stop", {"words": "persian"})), (("pattern_replace", {"pattern": "\u200c", "replacement": " "}),))
    return out | {"persian": persian}


for _key, _analyzer in _listed().items():
    ANALYZERS[_key] = lambda a=_analyzer: a


def analyzer(name: str) -> Analyzer:
    return ANALYZERS[name]()


def analyzer_names() -> list[str]:
    return sorted(ANALYZERS)


def available(name: str) -> bool:
    """Whether all parts of an analyzer are built."""
    a = analyzer(name)
    known = all(f in FILTERS for f, _ in a.filters)
    return known and all(p["words"].strip("_") in (*WORDS, "filipino") for f, p in a.filters if f == "stop")


def register_sql(spark: SparkSession, names: list[str] | None = None) -> None:
    """SQL functions analyze_<name>(text): the terms of each tokenizer named (all of them if none is), in
    Arrow batches; null gives null. For use where a column expression can't be."""
    ship(spark)
    for name in names or sorted(TOKENIZERS):
        spark.udf.register(f"analyze_{name}", _sql_function(TOKENIZERS[name]().scan))


def _sql_function(scan):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else [term for term, *_ in scan(text)])

    return run


__all__ = ["_functions"]
