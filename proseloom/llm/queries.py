"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    chunks,
    contamination,
    language,
    lines,
    links,
    mixing,
    near_duplicates,
    repeats,
    resampling,
    token_counts,
    toxicity,
    vector_codes,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKEN_LIMIT = 2048
TOXIC_SCORE = 0.3


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def bpe_digests(documents: DataFrame) -> DataFrame:
    """Encode with a lexicon of these texts, decode, and digest ids and text."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    lexicon = bpe.build_lexicon(documents, tokenizer)
    # Decoded beside the encoding, so that a text visits Python once.
    decoded = bpe.encode(documents, tokenizer, lexicon, decoded=True)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digests(table(spark, folder, "documents"))


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_prefixes=True)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op4_chunk_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.compare_with_next(table(spark, folder, "documents"))


@query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    )
    learned = language.profiles(documents.where("NOT held_out AND doc_id IS NOT NULL"))
    return language.identify(documents, learned, ["doc_id", "held_out"])


@query
def op10_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


@query
def op8_contamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op9_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.remove_boilerplate(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


ORACLES["op9_line_spread"] = lines.LINES_SQL


def scored_texts(documents: DataFrame, labels: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
    """Toxicity scores by a model of these texts and a classifier of these labels."""
    model = toxicity.character_model(documents)
    return toxicity.score(documents, model, toxicity.learn(documents, labels, model), keep, name)


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    documents = table(spark, folder, "documents").withColumn("held_out", held_out)
    scores = scored_texts(documents, table(spark, folder, "labels").where(~held_out), ["doc_id", "held_out"])
    return scores.withColumn("predicted", (F.col("score") >= TOXIC_SCORE).cast("int"))


@query
def op3_link_trust(spark: SparkSession, folder: str) -> DataFrame:
    return links.judge(table(spark, folder, "pages"))


ORACLES["op3_link_trust"] = links.judge_sql()


@query
def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings")).drop("label")


ORACLES["op11_vector_codes"] = vector_codes.COMPRESS_SQL


@query
def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op12_resampling"] = resampling.RESAMPLE_SQL


@query
def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
