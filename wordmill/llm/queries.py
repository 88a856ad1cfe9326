"""The queries of this subpackage's operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, ngram_join, packing, piece_bpe, quality, sharding, token_counts, token_store, toxicity

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), 0.95)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), 40)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_encoded(_read(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(token_store.write(_read(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), 2))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(_read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(_read(spark, sf_dir, "documents"), tokenizer(BYTE_BPE)))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{odd}'), (-1L, 1L, 'assistant', '{odd}') as t(conv_id, turn, role, text)")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_chats(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("segments")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "order_ok",
        "first_violation",
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(_read(spark, sf_dir, "documents"), tokenizer(PIECE_BPE))


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    out = dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
    import corpus_pipeline

    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as known

    return known()
