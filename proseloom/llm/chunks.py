"""Fingerprints from chunks that the content itself delimits.

A gear hash over the last 32 bytes decides where a chunk ends. Chunks shorter than
the normal size need a rarer hash to end, longer ones a commoner one, so sizes gather
around it. A fingerprint is the set of chunk digests with their lengths; how much of
one text another contains is the share of its bytes in common chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, small_batches, texts

# A chunk's length takes one byte of its entry.
LEAST, NORMAL, MOST = 16, 48, 192
RARE_BITS, COMMON_BITS = 7, 5
WINDOW = 32
QUANTILES, PER_QUANTILE = 512, 8
_random = np.random.Generator(np.random.Philox(key=[4, 20_011]))
GEAR = np.concatenate([[0], _random.integers(1, 1 << 32, 255, dtype=np.uint64)]).astype(np.uint32)
SPREAD = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def _next(marked: np.ndarray) -> memoryview:
    """For each place the first marked place from it on; the length if there is none."""
    size = len(marked)
    places = np.where(marked, np.arange(size), size)
    return np.minimum.accumulate(places[::-1])[::-1].copy().data


def fingerprints_of(batch: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct entries of each text: 40 bits of digest, 8 bits of length."""
    gap = bytes(WINDOW)
    data = np.frombuffer(gap + gap.join(batch) + gap, np.uint8)
    gear = GEAR[data]
    width = 1
    while width < WINDOW:
        gear[width:] += gear[:-width] << np.uint32(width)
        width *= 2
    rare, common = _next(gear >> np.uint32(32 - RARE_BITS) == 0), _next(gear >> np.uint32(32 - COMMON_BITS) == 0)
    starts, ends, sizes = [], [], []
    at = WINDOW
    for text in batch:
        end, before = at + len(text), len(starts)
        while at < end:
            cut = end
            if end - at > LEAST:
                cut = rare[at + LEAST - 1] + 1
                if cut > at + NORMAL and at + NORMAL < end:
                    cut = min(common[at + NORMAL] + 1, at + MOST)
                cut = min(cut, end)
            starts.append(at)
            ends.append(cut)
            at = cut
        sizes.append(len(starts) - before)
        at += WINDOW
    first, last = np.array(starts, np.int64), np.array(ends, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(SPREAD[data] * _powers(BASE, len(data)), dtype=np.uint64)])
    digests = (sums[last] - sums[first]) * _powers(_INVERSE, len(data) + 1)[first]
    length = (last - first).astype(np.uint64)
    entries = (mixed(digests + length) >> np.uint64(24) << np.uint64(8)) | length
    return [np.unique(part) for part in np.split(entries, np.cumsum(sizes)[:-1])] if batch else []


def written(entries: np.ndarray) -> str:
    """A fingerprint as text: twelve hex digits for each chunk."""
    return entries.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").astype(np.uint64).ravel()


def contained(part: np.ndarray, whole: np.ndarray) -> float:
    """Share of the bytes of ``part`` in chunks that ``whole`` has; two empty texts are alike."""
    if not len(part):
        return float(not len(whole))
    length = (part & np.uint64(255)).astype(np.int64)
    if not len(whole):
        return 0.0
    place = np.minimum(np.searchsorted(whole, part), len(whole) - 1)
    return float(length[whole[place] == part].sum() / length.sum())


def containment(part: Column, whole: Column) -> Column:
    """How much of one fingerprint's text another's holds, 0 to 1; null if either is null."""

    @F.pandas_udf("double")
    def share(a, b):
        return a.combine(b, lambda x, y: None if x is None or y is None else contained(read(x), read(y)))

    return share(part, whole)


def fingerprint(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text; null and empty texts have the empty one."""
    small_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            entries = fingerprints_of([t.encode("utf-8", "surrogatepass") for t in texts(batch["text"])])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(map(written, entries), pa.string())], names=["doc_id", "fingerprint"]
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def in_order(documents: DataFrame) -> DataFrame:
    """``cell, guest, doc_id, text``: texts in cells of neighbouring ids, sorted within.

    A cell holds a narrow range of ids: quantiles of the ids, each cut into equal
    ranges. The texts after its last one are the guests of a cell: those with the
    first id of the next cell that has rows, and of the first cell after the last.
    The number of cells is bounded, so their first ids may be broadcast. Null ids come
    first; rows of one id follow each other by their text's hash.
    """
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    steps = [k / QUANTILES for k in range(QUANTILES + 1)]
    bounds = sorted(set(ids.select("doc_id").approxQuantile("doc_id", steps, 0.25 / QUANTILES)))
    if not bounds:
        cell = F.lit(0)
    else:
        place, halves = F.lit(1), 1 << len(bounds).bit_length()
        known = F.array(*[F.lit(int(b)) for b in bounds])
        strides = F.array(*[F.lit(halves >> k) for k in range(1, len(bounds).bit_length() + 1)])
        place = F.aggregate(
            strides,
            F.lit(1),
            lambda at, s: F.when((at + s <= len(bounds)) & (F.get(known, at + s - 1) <= F.col("doc_id")), at + s).otherwise(at),
        )
        low, high = F.get(known, place - 1), F.coalesce(F.get(known, place), F.lit(int(bounds[-1]) + 1))
        inner = F.least(F.floor((F.col("doc_id") - low) / (high - low) * PER_QUANTILE), F.lit(PER_QUANTILE - 1))
        cell = F.coalesce(F.greatest(place * PER_QUANTILE + F.greatest(inner, F.lit(0)), F.lit(0)), F.lit(0))
    celled = ids.withColumn("cell", cell.cast("long"))
    firsts = celled.groupBy("cell").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    firsts = firsts.withColumn("first", F.when(~F.col("unnamed"), F.col("first")))
    everywhere = Window.orderBy("cell")
    before = F.coalesce(F.lag("cell").over(everywhere), F.max("cell").over(Window.partitionBy(F.lit(0))))
    hosts = firsts.select(F.col("cell").alias("own"), "first", before.alias("host"))
    joined = celled.join(F.broadcast(hosts), celled["doc_id"].eqNullSafe(hosts["first"]) & (celled["cell"] == hosts["own"]), "left")
    stays = F.struct(F.col("cell"), F.lit(False).alias("guest"))
    visits = F.struct(F.col("host").alias("cell"), F.lit(True).alias("guest"))
    places = F.when(F.col("host").isNull(), F.array(stays)).otherwise(F.array(stays, visits))
    spread = joined.select(F.explode(places).alias("p"), "doc_id", "text").select("p.cell", "p.guest", "doc_id", "text")
    return spread.repartition("cell").sortWithinPartitions("cell", "guest", "doc_id", F.xxhash64("text"), "text")


def compare_with_next(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last quarter of code points replaced by as many from the
    beginning of the next text by id (of the first, after the last). ``near_edited``
    and ``near_next`` tell how much of the text the edited and the next text contain.
    Null texts count as empty; rows that repeat are neighbours of each other.
    """
    import hashlib

    small_batches(documents.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pairs(batches) -> Iterator[pa.RecordBatch]:
        held = None  # cell, id, text and fingerprint of the row that waits for its next one
        for batch in batches:
            cells, guests, ids = (batch[k].to_pylist() for k in ("cell", "guest", "doc_id"))
            whole = list(texts(batch["text"]))
            own = fingerprints_of([t.encode("utf-8", "surrogatepass") for t in whole])
            found = []
            for cell, guest, doc_id, text, entries in zip(cells, guests, ids, whole, own):
                if held is not None and held[0] == cell:
                    found.append((held[1], held[2], held[3], text, entries))
                    held = None
                if not guest:
                    held = (cell, doc_id, text, entries)
            edited = []
            for _, text, _, following, _ in found:
                quarter = len(text) // 4
                edited.append((text[: len(text) - quarter] + following[:quarter]).encode("utf-8", "surrogatepass"))
            changed = fingerprints_of(edited)
            rows = [
                (i, len(t), hashlib.sha256(e).hexdigest(), written(f), written(c), contained(f, c), contained(f, n))
                for (i, t, f, _, n), e, c in zip(found, edited, changed)
            ]
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return in_order(documents).mapInArrow(
        pairs,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )
