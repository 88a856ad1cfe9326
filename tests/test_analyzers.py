import pytest
from pyspark.sql import functions as F
from wordmill.functions.registry import FILTERS, NORMALIZERS, TOKENIZERS
from wordmill.plans.analyzers import Builder, analyzer, analyzer_names, available, from_names, register_sql
from wordmill.tokens import max_position, total_span

TEXT = "The cats' naïve İ straße ran http://x.y/z 日本 😀\tend"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(TEXT,), ("",), (None,), ("  \t\n ",)], "text string")


def first(texts, column):
    return [r[0] for r in texts.select(column).collect()]


@pytest.mark.parametrize("name", sorted(TOKENIZERS))
def test_offsets_lie_in_the_text(texts, name):
    rows = first(texts, TOKENIZERS[name]()(F.col("text")))
    raw = TEXT.encode()
    assert rows[2] is None and all(0 <= t.start_offset <= t.end_offset <= len(raw) for t in rows[0])
    assert [t.position for t in rows[0]] == sorted(t.position for t in rows[0])
    plain = "lowercase reverse fingerprint markdown phone_number truncate".split()
    if name not in plain:
        assert all(raw[t.start_offset : t.end_offset].decode() == t.term for t in rows[0])
    assert [t.term for t in rows[1]] == ([""] if name == "keyword" else [])


@pytest.mark.parametrize("name", [n for n in sorted(TOKENIZERS) if TOKENIZERS[n]().native is not None])
def test_native_terms_equal_scanned_ones(texts, name):
    t = TOKENIZERS[name]()
    assert [r and [x.term for x in r] for r in first(texts, t(F.col("text"), False))] == [r and [x.term for x in r] for r in first(texts, t(F.col("text"), True))]


@pytest.mark.parametrize("name", sorted(NORMALIZERS))
def test_normalizers_keep_null_and_empty(texts, name):
    rows = first(texts, NORMALIZERS[name]()(F.col("text")))
    assert rows[1] == "" and rows[2] is None


def test_named_analyzers(texts, spark):
    ready = [n for n in analyzer_names() if available(n)]
    assert len(analyzer_names()) == 73 and len(ready) >= 58
    for n in ready:
        rows = first(texts, analyzer(n).terms(F.col("text")))
        assert rows[2] is None
    df = spark.createDataFrame([("The Runner's dogs jumped",)], "text string")
    assert df.select(analyzer("english").terms(F.col("text"))).first()[0] == ["runner", "dog", "jump"]
    assert df.select(analyzer("fingerprint").terms(F.col("text"))).first()[0] == ["dogs jumped runner's"]


def test_builder_and_names(spark):
    df = spark.createDataFrame([("<p>A &amp; B</p>",), ("Hello World",)], "text string")
    a = Builder().normalizer("html_strip").tokenizer("standard").filters("lowercase").build()
    assert [list(r[0]) for r in df.select(a.terms(F.col("text"))).collect()] == [["a", "b"], ["hello", "world"]]
    detailed = df.select(a.tokens(F.col("text")).alias("t")).collect()[1].t
    assert [tuple(t) for t in detailed] == [("hello", 0, 5, 0), ("world", 6, 11, 1)]
    spans = df.select(max_position(a.tokens(F.col("text"))), total_span(a.tokens(F.col("text")))).collect()[1]
    assert spans[0] == 1 and tuple(spans[1]) == (0, 11)
    assert from_names(["nope"], "letter", ["lowercase", "what"], lenient=True) == from_names([], "letter", ["lowercase"])
    assert from_names(tokenizer="nope", lenient=True) is None
    with pytest.raises(KeyError):
        from_names(["nope"])
    assert len(FILTERS) > 240


def test_stream_equals_batch(spark, tmp_path):
    from wordmill.streaming.windows import windowed_terms

    docs = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    docs.write.parquet(str(tmp_path / "in"))
    stream = windowed_terms(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), "ts", "event_type", "1 day", "1 hour")
    q = stream.writeStream.format("memory").queryName("terms_by_day").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select window_start, term, max(n) n from terms_by_day group by 1, 2")
    want = windowed_terms(docs, "ts", "event_type", "1 day")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sql_functions(spark, texts):
    register_sql(spark)
    texts.createOrReplaceTempView("sql_texts")
    rows = spark.sql("select text, analyze_whitespace(text) as words, analyze_standard(text) as terms, analyze_keyword(text) as whole from sql_texts").collect()
    assert rows[0].words == TEXT.split() and rows[0].whole == [TEXT] and "straße" in rows[0].terms
    assert rows[1].words == [] and rows[2].words is None and rows[2].terms is None
