"""A training corpus in five stages: toxicity, near-duplicates, repeated strings, source mixing, tokens.

Each stage takes all that the one before it kept. run() writes every stage's result to the shared
folder and reads it back for the next, so a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import bpe, minhash, mixing, suffix, toxicity
from locusframe.llm.common import crc_of_id, scratch, table

#: Fewer bytes than 51 words of prose have.
PASSAGE_BYTES = 200
PASSAGE_WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language; labels with crc32 mod 4 = 2 are not learnt from."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=F.pmod(crc_of_id(), F.lit(4)) != 2)
    return toxicity.score(docs, net).where(~toxicity.rejected(F.col("row.lang"), F.col("score"), net)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, once; rows without an id stay."""
    found = minhash.near_duplicates(docs)
    kept = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    named = docs.join(kept.where("n = 1").select("doc_id"), "doc_id", "left_semi")
    again = docs.join(kept.where("n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(again).unionByName(docs.where("doc_id IS NULL"))


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their passages of over 50 words that also occur elsewhere; n_chars follows.

    A passage is a run of whole words covered by repeated strings of PASSAGE_BYTES, letter case and kind of white space aside."""
    left = suffix.strip_repeats(docs, PASSAGE_BYTES, characters=True, fold=True, words=PASSAGE_WORDS)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept").cast("string"))
    changed = {"text": text, "n_chars": F.when(F.col("row.text").isNotNull(), F.length(text)).cast("long")}
    return left.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that every source's words come near its target."""
    return mixing.emit(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and lang, n_tokens and ids of every document."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=("doc_id", "source", "lang"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", strip_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No stage but mixing can be put in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as block:
            docs = block.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
