"""Exact length histogram of encoded documents.

Documents are reduced to one row per distinct encoded length; sums over the
longer lengths (suffix sums) then answer totals, quantiles and truncated totals
for every context limit without touching the documents again.

Null texts count as empty (length 0). Empty tables give an empty histogram.
Extra columns are ignored. The histogram has at most one row per distinct
length, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

CHUNK = 256  # texts encoded at once in a worker


def lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """One row per document: n_tokens, the number of ids of its whole text."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wordmill.llm.bytepair import encoder

        own = encoder(tokenizer)
        for b in batches:
            for start in range(0, b.num_rows, CHUNK):
                texts = b.column(0).slice(start, CHUNK).to_pylist()
                yield pa.record_batch({"n_tokens": pa.array(own.lengths([t or "" for t in texts]))})

    return docs.select(text).mapInArrow(count, "n_tokens long")


def histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: exact counts; combined in each task before the shuffle."""
    return lengths(docs, tokenizer, text).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each distinct length L: n_docs, docs_at_least and tokens_at_least
    (documents of L tokens or more), docs_total, tokens_total, docs_upto
    (documents of at most L: the rank for quantiles) and truncated_total (tokens
    that remain when every document is cut to L)."""
    rows = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = hist.select(
        "n_tokens",
        "n_docs",
        F.sum("n_docs").over(rows).alias("docs_at_least"),
        F.sum(tokens).over(rows).alias("tokens_at_least"),
        F.sum("n_docs").over(every).alias("docs_total"),
        F.sum(tokens).over(every).alias("tokens_total"),
    )
    return out.withColumns({"docs_upto": F.expr("docs_total - docs_at_least + n_docs"), "truncated_total": truncated(F.col("n_tokens"))})


def truncated(limit: Column) -> Column:
    """Over a row of suffix_sums: total tokens under a limit at or above the next
    smaller length and at most this row's own."""
    return F.col("tokens_total") - F.col("tokens_at_least") + F.col("docs_at_least") * limit


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens that remain when every document is cut to `limit`; 0 for no documents."""
    row = sums.where(F.col("n_tokens") >= limit).orderBy("n_tokens").select(truncated(F.lit(limit))).first()
    row = row or sums.select(F.max("tokens_total")).first()
    return (row and row[0]) or 0


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least the part q of all documents don't exceed."""
    row = sums.where(F.col("docs_upto") >= F.ceil(F.lit(q) * F.col("docs_total"))).orderBy("n_tokens").first()
    return row and row["n_tokens"]
