"""Tokens of a large batch leave the worker in pieces, whatever the query does with them."""

import itertools
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from wordmill.functions import tokenizers
from wordmill.functions.registry import FILTERS, TOKENIZERS
from wordmill.plans import queries as core
from wordmill.tokens import TOKENS

SF_DIR = "/root/testdata/sf0.001"
QUERIES = "tok_whitespace flt_common_grams flt_common_grams_query flt_concatenate_graph flt_limit flt_limit_token_offset flt_limit_token_position flt_fingerprint flt_fix_broken_offsets flt_fixed_shingle flt_flatten_graph flt_remove_duplicates flt_shingle tok_wildcard flt_unique tok_burmese tok_camel_case tok_char_group tok_chinese_char tok_classic tok_code tok_compound_word tok_elision tok_email".split()


@pytest.mark.parametrize("name", QUERIES)
def test_a_worker_holds_few_tokens_at_once(spark, monkeypatch, name):
    made, whole = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: made.append(f) or whole(kind)(f))
    core.queries()[name](spark, SF_DIR)
    texts = [t for (t,) in duckdb.sql(f"select text from '{SF_DIR}/documents.parquet'").fetchall()] * 4
    counts = [[len(row or []) for row in piece] for piece in made[-1](iter([pa.array(texts)]))]
    assert sum(map(len, counts)) == len(texts)
    assert sum(map(sum, counts)) > 3 * tokenizers.HELD and all(sum(c[:-1]) < tokenizers.HELD for c in counts)


def test_pieces_hold_what_the_scanner_finds(spark):
    texts = [None, "", "Ünï code 日本 words"] + ["one two", "  ", None, "drei\tvier ünf"] * 12_000
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1).select("id", TOKENIZERS["whitespace"]()(F.col("text")).alias("t")).collect()
    size = lambda t: len(t.encode())
    want = {t: None if t is None else [(t[a:b], size(t[:a]), size(t[:b]), k) for _, a, b, k in TOKENIZERS["whitespace"]().scan(t)] for t in set(texts)}
    assert [texts[r.id] for r in got] == texts
    assert all((r.t if r.t is None else [tuple(x) for x in r.t]) == want[texts[r.id]] for r in got)


def test_filters_in_linear_time_on_streams_out_of_order(spark):
    rnd = random.Random(1)
    number = lambda most: rnd.choice([None, *(rnd.randint(-3, most) for _ in range(9))])
    streams = [[(rnd.choice("abc"), number(99), number(99), number(9)) for _ in range(n)] for n in (0, 1, 2, 3, 17, 64, 65, 4000)]
    given = spark.createDataFrame([(s,) for s in streams], f"t {TOKENS}").coalesce(1)
    got = given.select("t", *[FILTERS[n]()(F.col("t")).alias(n) for n in ("fix_broken_offsets", "flatten_graph", "unique", "remove_duplicates")]).collect()
    for r in got:
        ts = [tuple(t) for t in r.t]
        ends = list(itertools.accumulate((max(x for x in (a, b, 0) if x is not None) for _, a, b, _ in ts), max))
        assert [tuple(t) for t in r.fix_broken_offsets] == [(t, max(x for x in (a, e) if x is not None), f, p) for (t, a, b, p), e, f in zip(ts, [0, *ends], ends, strict=False)]
        span = lambda t: None if t[1] is None or t[2] is None else t[1] - t[2]
        low = lambda x: -(10**9) if x is None else x
        places = sorted({t[3] for t in ts if t[3] is not None})
        assert [tuple(t) for t in r.flatten_graph] == [(*t[:3], None if t[3] is None else places.index(t[3])) for t in sorted(ts, key=lambda t: (low(t[3]), low(span(t))))]
        for name, key in (("unique", lambda t: t[0]), ("remove_duplicates", lambda t: (t[3], t[0]))):
            keys = [key(t) for t in ts]
            assert [tuple(t) for t in r[name]] == [t for k, t in enumerate(ts) if keys.index(key(t)) == k]
