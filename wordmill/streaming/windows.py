"""Windowed term counts, for batch and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.analyzers import analyzer


def windowed_terms(events: DataFrame, time: str, text: str, window: str, late: str | None = None, name: str = "simple") -> DataFrame:
    """window_start, term, n. On a stream, `late` is the watermark: what comes later is dropped and its state freed."""
    kind = events.schema[time].dataType
    if late is not None:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    found = events.select(F.col(time).alias("ts"), F.explode(analyzer(name).terms(F.col(text))).alias("term"))
    return found.groupBy(F.window("ts", window).alias("w"), "term").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast(kind).alias("window_start"), "term", "n")


def distinct_texts(docs: DataFrame, time: str, text: str, late: str) -> DataFrame:
    """A stream without texts of equal fingerprint seen within the watermark."""
    key = analyzer("fingerprint").terms(F.col(text))[0]
    return docs.withColumn("fingerprint", key).withWatermark(time, late).dropDuplicatesWithinWatermark(["fingerprint"]).drop("fingerprint")
