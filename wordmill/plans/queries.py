"""Queries over the tables, one for each component, and SQL for those that SQL can express.

Filters that look at one term run over the distinct terms of all documents with
their counts, and over the probes: (term, out, n), an empty `out` list giving no row. Filters over a
document's stream run document by document: (doc_id, ord, term, position).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..data.stopwords import stop_words
from ..functions import stemmers
from ..functions.phonetics import ENCODERS
from ..functions.registry import FILTERS, NORMALIZERS, TOKENIZERS
from ..shipping import ship
from ..tokens import token
from .analyzers import analyzer, analyzer_names, available
from .probes import PROBES
from .term_sql import _BLANK, analyzer_query, quoted, reversed_, stemmer_query, term_sql, unless_empty

Query = Callable[[SparkSession, str], DataFrame]

#: Filters over a whole stream, and parameters where the plain form does nothing.
STREAM = "shingle fixed_shingle common_grams common_grams_query concatenate_graph fingerprint fix_broken_offsets flatten_graph limit limit_token_offset limit_token_position unique remove_duplicates".split()
PARAMS: dict[str, dict] = {
    "common_grams": {"words": ("the", "of", "and", "to")}, "limit": {"max_token_count": 5}, "limit_token_offset": {"max_start_offset": 100}, "limit_token_position": {"max_position": 10},
    "length": {"least": 3, "most": 8}, "codepoint_count": {"least": 3, "most": 8}, "keep_words": {"words": ("the", "of", "and")}, "lookup": {"known": {"the": "THE", "of": "OF"}},
    "dictionary_stem": {"known": {"the": "th"}}, "stemmer_override": {"known": {"the": "th"}}, "synonym": {"rules": "the => a, an\nof, from"}, "edge_ngram": {"min_gram": 1, "max_gram": 3},
    "ngram": {"min_gram": 2, "max_gram": 3}, "pattern_replace": {"pattern": "[aeiou]", "replacement": "_"}, "pattern_capture": {"patterns": ("([aeiou]+)",)}, "pattern_typing": {"rules": (("^[0-9]+$", "number"),)},
    "pattern_keyword_marker": {"pattern": "^th"}, "redact": {"patterns": ("idiot",)}, "predicate": {"predicates": (("min_length", 4), "is_alphabetic")},
    "dictionary_decompounder": {"words": ("the", "and", "hand", "er", "ou")}, "hyphenation_decompounder": {"words": ("the", "and", "er", "hand")}, "hunspell": {"rules": ((True, "", "ing"), (True, "0", "s"))},
    "multiplexer": {"filters": (FILTERS["lowercase"](), FILTERS["reverse"]())}, "conditional": {"pred": ("pattern", "^s"), "then": FILTERS["uppercase"]()},
    "keyword_marker": {"words": ("the", "Hello", "sooooo"), "then": FILTERS["reverse"]()}, "protected_words": {"words": ("the", "Hello", "sooooo"), "then": FILTERS["reverse"]()},
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _term_filter(name: str, **params) -> Query:
    params = params or PARAMS.get(name, {})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = F.regexp_extract_all("text", F.lit(r"([^ \t\n\r\f\x0B]+)"), F.lit(1))
        terms = _read(spark, sf_dir, "documents").select(F.explode(found).alias("term"), F.lit(1).alias("n"))
        probes = spark.range(1).select(F.explode(F.array(*map(F.lit, PROBES))).alias("term"), F.lit(0).alias("n"))
        terms = terms.unionByName(probes).groupBy("term").agg(F.sum("n").alias("n"))
        one = F.array(token(F.col("term"), F.lit(0), F.octet_length("term"), F.lit(0)))
        return terms.select("term", "n", F.explode(FILTERS[name](**params)(one)).alias("t")).select("term", F.col("t.term").alias("out"), "n")

    return run


def _stream_filter(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = FILTERS[name](**PARAMS.get(name, {}))(TOKENIZERS["whitespace"]()(F.col("text")))
        found = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(made).alias("ord", "t"))
        return found.select("doc_id", F.col("ord").cast("long").alias("ord"), "t.term", F.col("t.position").cast("long").alias("position"))

    return run


#: The table, key and column that a tokenizer reads; documents' text if not listed.
SOURCES = {
    "url": ("pages", "page_id", "url"), "path_hierarchy": ("pages", "page_id", "url"), "json_field": ("events", "event_id", "props"), "ngram": ("part", "p_partkey", "p_name"), "edge_ngram": ("part", "p_partkey", "p_name"),
    "sliding_window": ("part", "p_partkey", "p_name"), "structured_id": ("customer", "c_custkey", "c_name"), "keyword": ("nation", "n_nationkey", "n_name"),
}


def _tokenizer(name: str) -> Query:
    table, key, column = SOURCES.get(name, ("documents", "doc_id", "text"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _read(spark, sf_dir, table).select(F.col(key).cast("long").alias("id"), F.posexplode(TOKENIZERS[name]()(F.col(column))).alias("ord", "t"))
        whole = {c: F.col(f"t.{c}").cast("long").alias(c) for c in ("start_offset", "end_offset", "position")}
        return found.select("id", F.col("ord").cast("long").alias("ord"), "t.term", *whole.values())

    return run


def _normalizer(name: str) -> Query:
    table, key, column = ("pages", "page_id", "html") if name == "html_strip" else ("documents", "doc_id", "text")
    params = {"mapping": {"rules": (("the", "le"), ("le", "la"))}}.get(name, {})
    return lambda spark, sf_dir: _read(spark, sf_dir, table).select(F.col(key).alias("id"), NORMALIZERS[name](**params)(F.col(column)).alias("text"))


def _analyzer(name: str) -> Query:
    """term, tf, df over all documents. A document gives each of its terms once for
    every occurrence and once for itself, so one aggregation by term is all: it is
    combined in each task, and a row per term and task is shuffled."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = F.transform(F.array(analyzer(name).terms(F.col("text"))), lambda t: F.struct(t.alias("all"), F.array_distinct(t).alias("once")))[0]
        rows = _read(spark, sf_dir, "documents").select(made.alias("t"))
        counted = lambda c, tf, df: F.transform(F.col(c), lambda x: F.struct(x.alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df")))
        found = rows.select(F.explode(F.concat(counted("t.all", 1, 0), counted("t.once", 0, 1))).alias("c")).select("c.*")
        return found.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))

    return run


def term_counts_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of event types by day: the batch form of the streaming query."""
    from ..streaming.windows import windowed_terms

    return windowed_terms(_read(spark, sf_dir, "events"), "ts", "event_type", "1 day")


def overlap_with_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold word 8-grams of benchmark items: doc_id, item_id, how many distinct ones."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def grams(df: DataFrame, key: str) -> DataFrame:
        w = df.select(key, words(F.col("text")).alias("w")).where("size(w) >= 8")
        return w.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, F.lit(8)), " ")))).alias("gram"))

    # Grams of documents meet those of the benchmark first; only common ones are made distinct.
    items = grams(_read(spark, sf_dir, "benchmark"), "item_id").distinct()
    hits = grams(_read(spark, sf_dir, "documents"), "doc_id").join(items, "gram").distinct()
    return hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("grams"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyzer("stop")(spark, sf_dir)


def queries() -> dict[str, Query]:
    out = {f"flt_{n}": (_stream_filter if n in STREAM else _term_filter)(n) for n in sorted(FILTERS)}
    out |= {f"flt_phonetic_{n}": _term_filter("phonetic", encoder=n) for n in sorted(ENCODERS)}
    out |= {f"tok_{n}": _tokenizer(n) for n in sorted(TOKENIZERS)}
    out |= {f"norm_{n}": _normalizer(n) for n in sorted(NORMALIZERS)}
    out |= {f"analyzer_{n}": _analyzer(n) for n in analyzer_names() if available(n)}
    return out | {"term_counts_by_window": term_counts_by_window, "overlap_with_benchmark": overlap_with_benchmark}


# SQL. Each entry is a list expression over `term` whose elements are the results.

_TAG = "case when {when} then [term, {tag}] else [term] end"
_SIMPLE = {
    "lowercase": "lower(term)", "uppercase": "upper(replace(term, 'ß', 'SS'))", "reverse": reversed_(), "truncate": "term[:10]", "char_count": None, "rot13": None,
    "hex_encode": "lower(hex(encode(term)))", "base64_encode": "base64(encode(term))", "url_encode": "url_encode(term)", "pad": "case when length(term) >= 8 then term else lpad(term, 8, '0') end",
    "repeat_char": "regexp_replace(term, '(.)', '\\1\\1', 'g')", "hyphenated_words": "case when length(term) > 1 and term like '%-' then term[:-2] else term end",
    "delimited_payload": None, "partial_mask": "case when length(term) <= 4 then term else term[:2] || repeat('*', length(term) - 4) || right(term, 2) end",
    "hashtag_extract": "regexp_replace(term, '^#(.)', '\\1')", "mention_extract": "regexp_replace(term, '^@(.)', '\\1')", "russian_yo_normalization": "translate(term, 'ёЁ', 'еЕ')",
    "romanian_normalization": "translate(term, 'ŞşŢţ', 'ȘșȚț')", "slugify": None, "number_norm": "case when regexp_matches(term, '[0-9]') then replace(term, ',', '') else term end",
    "ordinal": "case when regexp_full_match(term, '[0-9]+(?i:st|nd|rd|th)') then regexp_extract(term, '^[0-9]+') else term end", "ansi_strip": "regexp_replace(term, '\\x1b\\[[0-9;]*[a-zA-Z]', '', 'g')",
    "lookup": "case term when 'the' then 'THE' when 'of' then 'OF' else term end", "dictionary_stem": "case term when 'the' then 'th' else term end", "stemmer_override": "case term when 'the' then 'th' else term end",
    "diacritic_strip": "regexp_replace(term, '[\\x{300}-\\x{36F}]', '', 'g')", "irish_lowercase": "lower(term)", "french_minimal_stem": "case when length(term) < 4 then term when term like '%aux' then term[:-4] || 'al' when regexp_matches(term, '[sx]$') then term[:-2] else term end",
    "german_minimal_stem": "case when length(term) < 5 then term when term like '%ern' then term[:-4] when regexp_matches(term, 'e[nrs]$') then term[:-3] when regexp_matches(term, '[es]$') then term[:-2] else term end",
    }


def _term_sql() -> dict[str, str]:
    out = {k: f"[{v}]" for k, v in _SIMPLE.items() if v}
    tag = lambda when, t: _TAG.format(when=when, tag=t)
    words = lambda language: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words(language)) + ")"
    return out | {
        "char_count": tag("not starts_with(term, '_len:')", "'_len:' || length(term)"),
        "byte_length": "[term, '_bytes:' || strlen(term)]",
        "length_band": "[term, '_length_band:' || case when length(term) <= 3 then 'short' when length(term) <= 8 then 'medium' else 'long' end]",
        "length": "case when length(term) between 3 and 8 then [term] else [] end",
        "codepoint_count": "case when length(term) between 3 and 8 then [term] else [] end",
        "pattern_replace": unless_empty("regexp_replace(term, '[aeiou]', '_', 'g')"),
        "keep_words": "case when term in ('the', 'of', 'and') then [term] else [] end",
        "stop": f"case when term in {words('english')} then [] else [term] end",
        "keyword_repeat": "[term, term]",
        "mention_remove": "case when starts_with(term, '@') then [] else [term] end",
        "hashtag_remove": "case when starts_with(term, '#') then [] else [term] end",
        "drop_if_flagged": "case when starts_with(term, '__DROP__') then [] else [term] end",
        "redact": "case when term like '%idiot%' then [] else [term] end",
        "edge_ngram": "list_transform(range(1, least(3, length(term)) + 1), lambda i: term[:i])",
        "email_extract": r"[term] || regexp_extract_all(term, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}')",
        "email_domain": tag("position('@' in term) > 0 and substr(term, position('@' in term) + 1) <> ''", "substr(term, position('@' in term) + 1)"),
        "key_value_pair": "case when position('=' in term) > 1 and position('=' in term) < length(term) then [term, '_key:' || split_part(term, '=', 1), '_val:' || substr(term, position('=' in term) + 1)] else [term] end",
        "http_status": tag("regexp_full_match(term, '[1-5][0-9][0-9]')", "'_http:' || case term[1] when '1' then 'informational' when '2' then 'success' when '3' then 'redirect' when '4' then 'client_error' else 'server_error' end"),
        "error_code": tag("regexp_matches(term, '^[A-Z][A-Z0-9_]*[0-9]+$|^[A-Z]{1,5}[-_][0-9]+$')", "'_type:error_code'"),
        "url_scheme": tag("position('://' in term) > 0", "'_scheme:' || split_part(term, '://', 1)"),
        "pattern_typing": tag("regexp_matches(term, '^[0-9]+$')", "'_type:number'"),
        "pattern_keyword_marker": tag("starts_with(term, 'th')", "'__KW__' || term"),
        "synonym": "case term when 'the' then ['the', 'a', 'an'] when 'of' then ['of', 'from'] when 'from' then ['from', 'of'] else [term] end",
        "mention_tag": "case when length(term) > 1 and starts_with(term, '@') then [term[2:], '_mention:' || term[2:]] else [term] end",
        "hashtag_tag": "case when length(term) > 1 and starts_with(term, '#') then [lower(term[2:]), '_hashtag:' || lower(term[2:])] else [term] end",
    }


def oracle_sql() -> dict[str, str]:
    probes = ", ".join(map(quoted, PROBES))
    terms = rf"with w as (select term, sum(k)::bigint as n from (select unnest(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) as term, 1 as k from documents union all select unnest([{probes}]), 0) group by term)"
    out = {f"flt_{k}": f"{terms} select term, unnest({v}) as out, n from w" for k, v in (_term_sql() | term_sql()).items()}
    out |= {f"flt_{k}": stemmer_query(k, terms) for k in stemmers.SQL}
    lists = _term_sql() | term_sql()
    out |= {f"analyzer_{k}": q for k in analyzer_names() if available(k) and (q := analyzer_query(analyzer(k), lists, stop_words))}
    seq = r"with t as (select doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') as ws from documents) "
    out["flt_limit"] = seq + "select doc_id, i - 1 as ord, ws[i] as term, i - 1 as position from t, range(1, 6) r(i) where i <= len(ws)"
    out["flt_limit_token_position"] = seq + "select doc_id, i - 1 as ord, ws[i] as term, i - 1 as position from t, range(1, 12) r(i) where i <= len(ws)"
    out["flt_fixed_shingle"] = seq + "select doc_id, i - 1 as ord, ws[i] || ' ' || ws[i + 1] as term, i - 1 as position from (select doc_id, ws, unnest(range(1, len(ws))) as i from t)"
    out["tok_keyword"] = "select n_nationkey::bigint as id, 0::bigint as ord, n_name as term, 0::bigint as start_offset, strlen(n_name) as end_offset, 0::bigint as position from nation"
    out["tok_edge_ngram"] = "select p_partkey as id, n - 1 as ord, p_name[:n] as term, 0::bigint as start_offset, strlen(p_name[:n]) as end_offset, n - 1 as position from part, range(1, 3) r(n) where n <= length(p_name)"
    out["norm_lowercase"] = "select doc_id as id, lower(text) as text from documents"
    out["norm_uppercase"] = "select doc_id as id, upper(replace(text, 'ß', 'SS')) as text from documents"
    blank = _BLANK.replace("'", "''")
    out["norm_trim"] = f"select doc_id as id, regexp_replace(text, '^{blank}+|{blank}+$', '', 'g') as text from documents"
    out["norm_collapse_whitespace"] = f"select doc_id as id, regexp_replace(text, '{blank}+', ' ', 'g') as text from documents"
    out["norm_pattern_replace"] = f"select doc_id as id, regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_{blank[1:-1]}]', '', 'g') as text from documents"
    out["norm_mapping"] = "select doc_id as id, replace(replace(text, 'the', 'le'), 'le', 'la') as text from documents"
    out["norm_unicode_nfc"] = "select doc_id as id, nfc_normalize(text) as text from documents"
    counts = "select term, count(*) as tf, count(distinct doc_id) as df from (select doc_id, {terms} as term from documents) {where} group by term"
    letters = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nl}]+'))".replace(r"\p{M}", "")
    stops = ", ".join(f"'{w}'" for w in stop_words("english"))
    out["analyzer_simple"] = counts.format(terms=letters, where="")
    out["analyzer_stop"] = counts.format(terms=letters, where=f"where term not in ({stops})")
    out["analyzer_whitespace"] = counts.format(terms=r"unnest(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+'))", where="")
    out["analyzer_keyword"] = counts.format(terms="text", where="")
    out["analyzer_pattern"] = counts.format(terms=r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'))", where="")
    out["term_counts_by_window"] = "select time_bucket(interval '1 day', ts) as window_start, lower(term) as term, count(*) as n from (select ts, unnest(regexp_extract_all(event_type, '[A-Za-z]+')) as term from events) group by 1, 2"
    out["overlap_with_benchmark"] = r"""
        with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents), b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark),
        dg as (select distinct doc_id, array_to_string(w[i:i + 7], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
        bg as (select distinct item_id, array_to_string(w[i:i + 7], ' ') as gram from (select item_id, w, unnest(range(1, len(w) - 6)) as i from b))
        select doc_id, item_id, count(*) as grams from dg join bg using (gram) group by doc_id, item_id"""
    return out
