"""One query an operator, with its production parameters, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import ann, bpe, chat, lm, media, minhash, mixing, suffix, toxicity, warc
from locusframe.llm.common import crc_of_id, materialise, table


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.pmod(crc_of_id(), F.lit(7)) == 2).alias("held_out"))
    found = lm.learn_and_score(docs, "held_out", {"doc_id": "long", "held_out": "boolean"})
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = materialise(warc.write_bundles(warc.mark_revisits(table(spark, sf_dir, "pages"))), "warc")
    return warc.read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=("doc_id", "source")).select("row.doc_id", "size", "source_size", "target", "taken")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix.strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=51)
    return left.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_words")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read_media(media.encode_texts(table(spark, sf_dir, "documents")))
    return found.withColumn("feature", F.lower(F.hex("hash"))).drop("hash")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest_chats(chat.format_chats(rows.unionByName(own)))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(crc_of_id(), F.lit(4)) == 2
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~held)
    found = toxicity.score(docs.select("doc_id", "text"), net).select("row.doc_id", "score")
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm, op2_warc, op3_mixing, op4_suffix, op5_media, op6_chat, op7_minhash, op8_ann, op9_toxicity, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.ORACLE, "op3_mixing": mixing.ORACLE, "op6_chat": chat.ORACLE}
