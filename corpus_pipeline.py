"""Text cleaning in stages, each applied to all rows that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm import contamination, lines, near_duplicates
from proseloom.llm.common import cut, table
from proseloom.llm.queries import TOXIC_SCORE, bpe_digests, scored_texts
from proseloom.session import checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the limit.

    Null and empty texts and rows without an id are scored like others; rows that repeat
    fare alike; an empty table stays empty. All columns stay as they are.
    """
    scores = scored_texts(docs, table(spark, sf_dir, "labels"), docs.columns, "__toxicity")
    return scores.where(F.col("__toxicity") < TOXIC_SCORE).select(*docs.columns)


def line_spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites; ``n_chars`` follows the text.

    Null and empty texts stay as they are; a null site counts as none; rows without an id
    and rows that repeat are cleaned each; an empty table stays empty. No other column changes.
    """
    cleaned = lines.remove_boilerplate(docs, names=("__lines", "__removed"))
    changed = F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; documents without an id stay.

    Null and empty texts are classes of their own. Of rows that repeat an id one stays. An
    empty table stays empty.
    """
    kept = near_duplicates.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id")
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).union(docs.where("doc_id IS NULL")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    A row goes if its own text holds one; other rows of its id, and other rows without an
    id, stay. Null and empty texts hold none. An empty table stays empty.
    """
    found = contamination.contaminated(docs, table(spark, sf_dir, "benchmark"), by_text=True)
    bad = cut(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    if bad.count() <= contamination.BROADCAST_ROWS:
        bad = F.broadcast(bad)
    same = docs["doc_id"].cast("long").eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["__hash"])
    return docs.join(bad, same, "left_anti")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of the documents that are left, as digests.

    Null texts count as empty; rows without an id and rows that repeat are encoded each; an
    empty table gives an empty result.
    """
    return bpe_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_spread", line_spread),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

# No stage but the second can be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written beside the checkpoints and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
