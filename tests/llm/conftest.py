import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, unit string, shard int, `n` int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with those used inside."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "s", 1, "x", 7, 9) for i, t in pairs], DOCS)

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three four five six seven eight nine ten eleven"),
    (5, "one two three four five six seven eight nine ten eleven"),
    (5, "one two three four five six seven eight nine ten eleven"),
    (None, "a null id"),
    (6, "\u00e9\u4e2d\U0001f600 </s> <|endoftext|> \\s [INST]"),
    (7, "word " * 40_000),
    (8, "same line\nsame line\n\nsame line"),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
