"""Language of a text by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of three letters is the product
of their vectors, each rotated by its place; a text is the sum of its runs, and a
language the sum of its texts. Texts go to the language of the largest cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

DIMENSIONS = 1024
SEED = 20_011
# Texts bundled at a time: more texts share more runs but fill the count table less.
TEXTS_AT_ONCE = 32
MOST_LANGUAGES = 1024
MOST_CODES = 1 << 24


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)


@lru_cache(20_000)
def _letter_vector(code: int) -> np.ndarray:
    """The vector of one letter; code 0 is the gap between words."""
    bits = np.random.Generator(np.random.Philox(key=[code, SEED])).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def runs(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes by local number, the distinct runs as numbers, and the counts text x run."""
    lowered = [t.lower() for t in batch]
    codes = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(batch)), [len(t) + 1 for t in lowered])
    owner = np.concatenate([[0], owner])
    codes = np.where(_letters()[codes], codes, 0)
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, owner = codes[kept], owner[kept]
    seen = np.bincount(codes, minlength=1)
    alphabet = np.nonzero(seen)[0]
    local = np.zeros(len(seen), np.int64)
    local[alphabet] = np.arange(len(alphabet))
    small, size = local[codes], len(alphabet)
    inside = np.nonzero(codes[1:-1])[0] + 1
    packed = (small[inside - 1] * size + small[inside]) * size + small[inside + 1]
    if size**3 <= MOST_CODES:
        present = np.zeros(size**3, bool)
        present[packed] = True
        distinct = np.nonzero(present)[0]
        place = np.zeros(size**3, np.int32)
        place[distinct] = np.arange(len(distinct))
        column = place[packed]
    else:
        distinct, column = np.unique(packed, return_inverse=True)
    row = owner[inside]
    counts = np.bincount(row * len(distinct) + column, minlength=len(batch) * len(distinct))
    return alphabet, distinct, counts.reshape(len(batch), len(distinct))


def run_vectors(alphabet: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """One bound vector for each run."""
    size = len(alphabet)
    vectors = np.array([_letter_vector(int(c)) for c in alphabet], np.int8).reshape(size, DIMENSIONS)
    out = np.roll(vectors, 2, axis=1)[distinct // size**2]
    out *= np.roll(vectors, 1, axis=1)[distinct // size % size]
    out *= vectors[distinct % size]
    return out


def bundles(batch: list[str]) -> np.ndarray:
    """The vector of every text."""
    if not batch:
        return np.zeros((0, DIMENSIONS), np.float32)
    alphabet, distinct, counts = runs(batch)
    return counts.astype(np.float32) @ run_vectors(alphabet, distinct).astype(np.float32)


def profiles(labelled: DataFrame, most_languages: int = MOST_LANGUAGES) -> dict[str, np.ndarray]:
    """The vector of every language in ``lang``, bundled from all texts of that language.

    Sums are whole numbers, so they do not depend on the order of rows. Null texts and
    null languages add nothing. The result has one bounded row for each language; more
    than ``most_languages`` of them are an error.
    """
    small_batches(labelled.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("total", pa.int64())])

    def bundle(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = np.array(batch["lang"].to_pylist(), object)
            found, which = np.unique(languages.astype(str), return_inverse=True)
            alphabet, distinct, counts = runs(list(texts(batch["text"])))
            sums = np.zeros((len(found), len(distinct)), np.int64)
            np.add.at(sums, which, counts)
            added = sums.astype(np.float64) @ run_vectors(alphabet, distinct).astype(np.float64)
            for language, vector in zip(found, added):
                totals[language] = totals.get(language, 0) + vector
        for language, vector in totals.items():
            columns = [
                pa.array([language] * DIMENSIONS, pa.string()),
                pa.array(np.arange(DIMENSIONS), pa.int32()),
                pa.array(np.rint(vector).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    summed = rows.mapInArrow(bundle, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    summed = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("v"))
    found = summed.select("lang", "v.total").limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    return {row.lang: np.array(row.total, np.float64) for row in sorted(found, key=lambda r: r.lang)}


def identify(documents: DataFrame, learned: dict[str, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (cosine, at least 0) of every whole text.

    Null texts, texts without a letter, and all texts if nothing was learned give
    ``und`` and 0. Of equal cosines the first language in order wins. Rows that repeat
    are judged each; an empty table gives an empty result; no other column is read.
    """
    small_batches(documents.sparkSession)
    kept = keep or ["doc_id"]
    names = [n for n, v in learned.items() if np.any(v)]
    rows = documents.select(*kept, F.col("text").cast("string").alias("__text"))
    prototypes = np.array([learned[n] / np.linalg.norm(learned[n]) for n in names], np.float32).reshape(len(names), DIMENSIONS)

    def judge(batches):
        for batch in batches:
            whole, languages, scores = list(texts(batch["__text"])), [], []
            for at in range(0, len(whole), TEXTS_AT_ONCE):
                vectors = bundles(whole[at : at + TEXTS_AT_ONCE])
                length = np.linalg.norm(vectors, axis=1)
                if not names:
                    languages += ["und"] * len(vectors)
                    scores += [0.0] * len(vectors)
                    continue
                cosine = vectors @ prototypes.T / np.maximum(length, 1e-9)[:, None]
                best = cosine.argmax(axis=1)
                for i, k in enumerate(best):
                    languages.append(names[k] if length[i] else "und")
                    scores.append(float(np.clip(cosine[i, k], 0, 1)) if length[i] else 0.0)
            columns = [batch[k] for k in kept] + [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(judge, f"{kinds}, lang_pred string, score double")
