"""Resampling of documents towards a target by importance weights of hashed features.

Features are runs of words, hashed into buckets. The array of bucket gains says how
much likelier a bucket is in the target than in the documents; a document's weight is
the sum over its features. Weights with Gumbel noise make a draw without replacement:
the highest scores are taken, ranked by a distributed radix sort.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, resident, small_batches, stored
from .radix import ranked

BUCKETS = 10_000
LONGEST_RUN = 1
FEWEST_WORDS = 20
SHARE = 10
SEED = 2024
# The bytes of words, after A-Z became lower-case; UTF-8 bytes from 128 on belong to words.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
# Bytes of a text taken apart at once, and what a worker remembers of single words.
PIECE = 1 << 20
KEPT_WORDS, KEPT_LENGTH = 500_000, 64


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts that end where a word ends."""
    at = 0
    while at < len(text):
        end = len(text)
        if at + PIECE < end and (gap := GAP.search(text, at + PIECE)):
            end = gap.start()
        yield text[at:end]
        at = end


class FeatureHasher:
    """Buckets of the features of whole texts."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest
        self.known: dict[bytes, int] = {}

    def _bucket(self, feature: bytes) -> int:
        known = self.known.get(feature)
        if known is None:
            known = crc32(feature) % self.buckets
            if len(feature) <= KEPT_LENGTH:
                if len(self.known) >= KEPT_WORDS:
                    self.known.clear()
                self.known[feature] = known
        return known

    def parts(self, text: bytes) -> Iterator[tuple[int, list[int]]]:
        """Number of words, and buckets of the features that end, part by part."""
        before: list[bytes] = []
        for piece in _pieces(text):
            words = WORD.findall(piece.lower())
            found = list(map(self._bucket, words))
            if self.longest > 1:
                run = before + words
                for length in range(2, self.longest + 1):
                    first = max(0, len(before) - length + 1)
                    found += [self._bucket(b" ".join(run[i : i + length])) for i in range(first, len(run) - length + 1)]
                before = run[1 - self.longest :]
            yield len(words), found


def _hasher(buckets: int, longest: int) -> FeatureHasher:
    return resident(("features", buckets, longest), lambda: FeatureHasher(buckets, longest))


def bucket_counts(documents: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """How many features of all texts fall into each bucket. At most ``buckets`` rows reach the driver."""
    small_batches(documents.sparkSession)

    def count(batches):
        hasher, sums = _hasher(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"].cast(pa.large_binary()):
                for _, found in hasher.parts(text.as_py() or b""):
                    sums += np.bincount(found, minlength=buckets) if found else 0
        there = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], names=["bucket", "n"])

    texts = documents.select(F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for row in found:
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket in thousandths: log of its smoothed shares in the target and in the documents."""
    buckets, all_docs, all_target = len(documents), float(documents.sum()), float(target.sum())
    ratio = [
        (float(t) + 1) * (all_docs + buckets) / ((float(s) + 1) * (all_target + buckets))
        for s, t in zip(documents.tolist(), target.tolist())
    ]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighted(documents: DataFrame, gains: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row; other columns are not read."""
    small_batches(documents.sparkSession)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def score(batches):
        hasher = _hasher(len(gains), longest)
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for at, text in enumerate(batch["text"].cast(pa.large_binary())):
                for words, found in hasher.parts(text.as_py() or b""):
                    out[:, at] += (words, len(found), gains[found].sum() if found else 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, out)], names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, ", ".join(f"{name} long" for name in names))


def resample(
    documents: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    longest: int = LONGEST_RUN,
    fewest_words: int = FEWEST_WORDS,
    share: int = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document, all long.

    ``documents`` needs ``doc_id`` and ``text``, ``target`` needs ``text``; other columns
    are not read. Of the documents with at least ``fewest_words`` words ``share`` percent
    (rounded down) are drawn: those with the highest scores, of equal scores those with the
    smaller id. ``rank`` is null for the others. Null and empty texts have no words and a
    weight of 0. Null ids draw their noise as an empty id and come last among equal scores.
    Rows that repeat take part each. Empty tables give empty results; an empty target
    only leaves the smoothing.
    """
    spark = documents.sparkSession
    gains = bucket_gains(bucket_counts(documents, buckets, longest), bucket_counts(target, buckets, longest))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")
    scored, folder = stored(weighted(documents, gains, longest).withColumn("score", F.col("weight") + noise))
    able = scored.where(F.col("n_words") >= fewest_words)
    taken = able.count() * share // 100
    ranks = ranked(able.drop("n_words"), [("score", True), ("doc_id", False)])
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= taken, F.col("rank")))
    rest, kept = stored(scored.where(F.col("n_words") < fewest_words).drop("n_words"))
    discard(spark, folder)
    return ranks.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


# The same rows by plain sums, for the given tables; crc32 word by word from its table.
RESAMPLE_SQL = f"""
WITH RECURSIVE step(k, i, v) AS (
  SELECT 0, i, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT k + 1, i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8
), dw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
), bw AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark
), words AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), bytes AS (
  SELECT w, list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT) AS b FROM words
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295)
    % {BUCKETS} AS bucket FROM bytes, crc
), s AS (
  SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY 1
), t AS (
  SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY 1
), sums AS (
  SELECT (SELECT count(*) FROM dw) AS ss, (SELECT count(*) FROM bw) AS tt
), gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (ss + {BUCKETS})
    / ((s.n + 1)::DOUBLE * (tt + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums
), weights AS (
  SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY 1
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
), able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= {FEWEST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {SHARE} // 100 THEN rank END AS rank
FROM scored LEFT JOIN able USING (doc_id)
"""
