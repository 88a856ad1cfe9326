"""Balanced label propagation: documents move to the shards of those they are
linked with (equal texts), under quotas; then counts are made equal.

Documents start in the shard of a hash. In each round the members of a group are
counted by shard (one aggregation, one join); a group then moves to the shard
that holds most of it, as far as that shard's quota has room for linked
documents. A last pass hands the rows beyond a shard's quota, documents without
links first, to the shards below theirs: counts differ by at most one. Only groups
larger than a shard are divided, by a hash. The rows of a large group are joined
and ranked in parts, so no group meets in one task; groups that hold a thousandth
of all rows are fewer than 2000 and are broadcast. Only DataFrame functions; what
is collected is one number a shard.

A null text has size 16 and the text key of the empty text. Rows with equal
doc_id stay separate rows of the same group or bucket. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table

BUCKET_ROWS = 20_000  # rows ranked within one window partition, on average
PART_ROWS = 100_000  # rows of a group in one part, on average at most
HOT_SHARE = 1000  # a group of more than this part of all rows is hot


def _part(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and text_key of every document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("text_key"),
    )


def propagate(rows: DataFrame, n_shards: int, total: int, rounds: int = 3) -> DataFrame:
    """rows plus unit (null for documents without links), its parts, part, and shard."""
    quota = max(1, total // n_shards)
    groups = Table(rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shard-groups")
    hot = F.col("members") > max(1, total // HOT_SHARE)
    known = rows.join(F.broadcast(groups.df.where(hot)), "text_key")  # fewer than 2 * HOT_SHARE groups
    found = rows.join(F.broadcast(groups.df.where(hot)), "text_key", "left_anti").join(groups.df.where(~hot), "text_key", "left").unionByName(known)
    start = _part(n_shards, F.lit("shard"), F.col("doc_id"), F.col("text_key"))
    unit = F.xxhash64("text_key", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("members") / quota)))
    parts = F.ceil(F.least(F.col("members"), F.lit(quota)) / PART_ROWS).cast("int")
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), parts).cast("int")
    linked_of = lambda c: F.when(F.col("members") > 1, c)
    placed = Table(found.select(*rows.columns, linked_of(unit).alias("unit"), linked_of(parts).alias("parts"), linked_of(part).alias("part"), start.alias("shard")), "shards").df
    groups.drop()
    alone, now = placed.where("unit is null"), None
    linked_rows = placed.where("unit is not null")
    for k in range(rounds):
        held = linked_rows.groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"))
        load = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        best = held.groupBy("unit").agg(
            F.max_by("shard", F.struct("n", F.xxhash64("unit", "shard"))).alias("target"), F.sum("n").alias("members"), F.max("n").alias("there"), F.count(F.lit(1)).alias("spread"), F.max("parts").alias("parts")
        )
        best = best.where("spread > 1")
        flow = {r["target"]: r["n"] for r in best.groupBy("target").agg(F.sum(F.expr("members - there")).alias("n")).collect()}
        leaving = {r["shard"]: r["n"] for r in held.drop("parts").join(best, "unit").where("shard <> target").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        if not flow:
            break
        room = {s: max(0.0, min(1.0, (quota - load.get(s, 0) + leaving.get(s, 0)) / n)) for s, n in flow.items()}
        allowed = F.element_at(F.create_map(*[F.lit(x) for s, r in room.items() for x in (s, float(r))]), F.col("target"))
        luck = F.pmod(F.xxhash64(F.lit(k), F.col("unit")), F.lit(1_000_003)) / 1_000_003
        moves = best.where(luck < allowed).select("unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "target")
        moved = linked_rows.join(moves, ["unit", "part"], "left")
        then = Table(moved.select(*rows.columns, "unit", "parts", "part", F.coalesce("target", "shard").alias("shard")), "shards")
        if now is not None:
            now.drop()
        now, linked_rows = then, then.df
    return alone.unionByName(linked_rows)


def balance(rows: DataFrame, n_shards: int, total: int) -> DataFrame:
    """rows with shard and slot, where shard counts differ by at most one."""
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    n_buckets = max(1, -(-total // (n_shards * BUCKET_ROWS)))
    bucket = F.when(F.col("unit").isNull(), _part(n_buckets, F.lit("slot"), F.col("doc_id"), F.col("text_key")) + n_buckets).otherwise(F.pmod(F.xxhash64("unit", "part"), F.lit(n_buckets)).cast("int"))
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("unit").asc_nulls_last(), "doc_id", "text_key")
    ranked = rows.withColumn("r", F.row_number().over(within) - 1).join(counts, ["shard", "bucket"]).withColumn("rank", F.col("before") + F.col("r"))
    load = dict.fromkeys(range(n_shards), 0) | {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    over = [max(0, load[s] - quota[s]) for s in range(n_shards)]
    short = [max(0, quota[s] - load[s]) for s in range(n_shards)]

    def of_shard(values: list[int], s: Column) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), s + 1)

    ends = list(accumulate(short))
    starts_over = [e - o for e, o in zip(accumulate(over), over, strict=True)]
    is_over = F.col("rank") >= of_shard(quota, F.col("shard"))
    spare = of_shard(starts_over, F.col("shard")) + F.col("rank") - of_shard(quota, F.col("shard"))
    to = F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e <= F.col("spare")))
    out = ranked.withColumn("spare", F.when(is_over, spare)).withColumn("to", F.when(is_over, to).otherwise(F.col("shard")).cast("int"))
    base = of_shard([load[s] - (ends[s] - short[s]) for s in range(n_shards)], F.col("to"))
    return out.withColumn("slot", F.when(is_over, base + F.col("spare")).otherwise(F.col("rank")).cast("long")).withColumn("shard", F.col("to"))


def shard(docs: DataFrame, n_shards: int = 40, rounds: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and linked (has copies)."""
    rows = Table(linked(docs), "linked")
    total = rows.df.count()
    out = balance(propagate(rows.df, n_shards, total, rounds), n_shards, total)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("unit").isNotNull().alias("linked")
    )
