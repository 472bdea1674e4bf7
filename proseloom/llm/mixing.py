"""Mixing of sources to target weights by entropy balancing.

Every document has a rate, the expected number of its copies. Of all rates that give each
source its target of words, the wanted ones are nearest in relative entropy to taking
every document once. They are exponentially tilted: ``exp(tilt * size / mean size)``,
up to a largest rate. The tilt of each source is the minimum of a convex dual, which
Newton steps find; then rates are rounded into whole copies, so that errors of large
documents are made up for by smaller ones.

Documents of one source and size have equal rates. So all iterations work on classes of
documents, counted once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, stored, text_bytes

WEIGHTS = (1, 2, 3)
MOST = 3
# Words of a mix in percent of all words.
SHARE = 100
# Words of a source may miss its target by this part before rates are rounded.
TOLERANCE = 1e-9
ROUNDS = 200
# A class of documents is dealt into so many cells, so that none of them has to be ranked as a whole.
CELL_BITS = 10
BEFORE = (Window.unboundedPreceding, -1)
# The bytes between words.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def sized(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size``: the number of words of every text; null texts have none."""
    small_batches(documents.sparkSession)

    def count(batches):
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            inside = ~SPACE[data]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            first = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[first] = inside[first]
            sums = np.concatenate([[0], np.cumsum(begins)])
            sizes = pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], sizes], names=["doc_id", "source", "size"])

    kinds = {"doc_id": "long", "source": "string", "text": "string"}
    rows = documents.select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds.items()])
    return rows.mapInArrow(count, "doc_id long, source string, size long")


def _numbered(sources: DataFrame) -> DataFrame:
    """The sources with their places ``place`` from 0 on by code point, null last, over any number of parts."""
    ordered, folder = stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # One row for each part of the sorted table.
    earlier = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(*BEFORE)), F.lit(0))
    begins = counts.select("__part", earlier.alias("__begin"))
    placed = ordered.withColumn("__part", part).join(F.broadcast(begins), "__part")
    out, _ = stored(placed.withColumn("place", F.col("__begin") + within).drop("__at", "__part", "__begin"))
    discard(sources.sparkSession, folder)
    return out


def _targets(sources: DataFrame, share: int, most: int) -> DataFrame:
    """``target`` of every source: its part by ``weight``, at most ``most`` times its words.

    What the sources at their limit leave over goes to the others by weight, round by
    round. Two numbers a round reach the driver.
    """
    limit = (F.col("source_size") * most).cast("double")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    level, filled = 0.0, F.lit(False)
    while True:
        full, free, free_limit = sources.agg(
            F.coalesce(F.sum(F.when(filled, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~filled, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~filled, limit)), F.lit(0.0)),
        ).first()
        left = max(0.0, words * share / 100 - full)
        if not free or left >= free_limit:
            filled = F.lit(True)
            break
        level = max(level, left / free)
        more = F.col("weight") * level > limit
        if not sources.where(more & ~filled).take(1):
            break
        filled = more
    return sources.withColumn("target", F.when(filled, limit).otherwise(F.col("weight") * F.lit(level)))


def _rate(most: int) -> Column:
    return F.least(F.exp(F.col("tilt") * F.col("size") / F.col("mean")), F.lit(float(most)))


def _tilts(classes: DataFrame, sources: DataFrame, most: int) -> tuple[DataFrame, str]:
    """``key, tilt`` of every source that has words, by Newton steps kept between known bounds.

    A round sums, for every source, the words its rates give and their slope. The sums are
    decimal, so their order does not matter. The driver learns whether a source is left.
    """
    spark = classes.sparkSession
    # At its limit a source takes every document as often as allowed, whatever its size.
    at_limit = F.col("target") >= F.col("source_size") * float(most)
    start = sources.where("source_size > 0").select(
        "key",
        "target",
        F.when(at_limit, float("inf")).when(F.col("target") <= 0, float("-inf")).otherwise(0.0).alias("tilt"),
        F.lit(float("-inf")).alias("low"),
        F.lit(float("inf")).alias("high"),
        (at_limit | (F.col("target") <= 0)).alias("done"),
    )
    state, folder = stored(start)
    words = F.col("n").cast("double") * F.col("size")
    exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    for _ in range(ROUNDS):
        if not state.where("NOT done").take(1):
            return state.select("key", "tilt"), folder
        rate = _rate(most)
        slope = F.when(rate < most, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = classes.join(state.where("NOT done").select("key", "tilt"), "key").groupBy("key").agg(exact(words * rate).alias("given"), exact(slope).alias("slope"))
        over = F.col("given") - F.col("target")
        low = F.when(over < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(over >= 0, F.least("high", "tilt")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("tilt") - over / F.col("slope"))
        inner = (F.col("low") + F.col("high")) / 2
        outer = F.when(over < 0, F.col("tilt") * 2 + 1).otherwise(F.col("tilt") * 2 - 1)
        bounded = (F.col("low") > float("-inf")) & (F.col("high") < float("inf"))
        far = F.greatest(F.lit(4.0), F.abs("tilt") * 4)
        near = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high")) & (F.abs(F.col("step") - F.col("tilt")) <= far)
        now = (
            state.join(sums, "key", "left")
            .withColumns({"settled": F.col("done") | (F.abs(over) <= TOLERANCE * F.col("target")), "step": step, "outer": outer})
            .withColumns({"low": F.when(F.col("done"), F.col("low")).otherwise(low), "high": F.when(F.col("done"), F.col("high")).otherwise(high)})
        )
        moved = F.when(near, F.col("step")).when(bounded, inner).otherwise(F.col("outer"))
        # Where the bounds meet, no number between them is left to try.
        stuck = bounded & ((inner <= F.col("low")) | (inner >= F.col("high")))
        now = now.select(
            "key",
            "target",
            F.when(F.col("settled"), F.col("tilt")).otherwise(moved).alias("tilt"),
            "low",
            "high",
            (F.col("settled") | stuck).alias("done"),
        )
        after, written = stored(now)
        discard(spark, folder)
        state, folder = after, written
    raise RuntimeError("the tilts did not settle")


def _rounded(classes: DataFrame, most: int) -> DataFrame:
    """``key, size, copies``: whole copies of every class, from the largest size of a source down.

    What a class takes too much or too little is carried on to the next smaller size. A
    source of ``w`` words has fewer than ``sqrt(2 * w)`` sizes, so its classes are few,
    however many documents it has.
    """

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        owed, copies = 0.0, []
        for size, n, rate in zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist()):
            owed += n * rate * size
            taken = min(max(math.floor(owed / size + 0.5), 0), most * n)
            owed -= taken * size
            copies.append(taken)
        return pd.DataFrame({"key": rows["key"], "size": rows["size"], "copies": copies})

    return classes.groupBy("key").applyInPandas(carry, "key string, size long, copies long")


def mix(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: int = SHARE
) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` of every document.

    ``documents`` needs ``doc_id``, ``source`` and ``text``; other columns are not read.
    ``size`` is the number of words of the text, ``taken`` the words of its copies. Sources
    in order by code point, null last, have the weights in turn; together they take
    ``share`` percent of all words, none more than ``most`` times its own. ``rate`` is the
    tilted rate, ``copies`` a whole number up to ``most``. The words a source takes miss
    its target by half of its smallest text where its smaller texts can make up for what
    rounding the larger ones missed, and by half of a larger one where they cannot.

    Null and empty texts have no words and no copies. Null sources are one source, null
    ids are ids like others; rows that repeat are documents each. Extra copies within a class
    go by a hash of the id, so the result depends on the rows only. An empty table gives an
    empty result.
    """
    spark = documents.sparkSession
    # A key without nulls, so that joins need no special case.
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    draw = F.xxhash64(F.lit("copies"), "doc_id")
    rows, _ = stored(sized(documents).withColumns({"key": key, "draw": draw, "cell": F.shiftrightunsigned(draw, 64 - CELL_BITS)}))
    cells, _ = stored(rows.groupBy("key", "size", "cell").agg(F.count("*").alias("n"), F.first("source").alias("source")))
    sources = cells.groupBy("key").agg(
        F.first("source").alias("source"),
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum("n").alias("n_docs"),
    )
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = _targets(_numbered(sources).withColumn("weight", turn), share, most)
    sources, _ = stored(sources.withColumn("mean", F.col("source_size") / F.col("n_docs")))
    counted = cells.where("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n"))
    classes, counted_folder = stored(counted.join(sources.select("key", "mean"), "key"))
    tilts, tilts_folder = _tilts(classes, sources, most)
    rated = classes.join(tilts, "key").select("key", "size", "n", _rate(most).alias("rate"))
    rated, rated_folder = stored(rated)
    discard(spark, counted_folder)
    discard(spark, tilts_folder)
    dealt = rated.join(_rounded(rated, most), ["key", "size"])
    dealt, _ = stored(dealt.select("key", "size", "rate", F.expr("copies div n").alias("each"), (F.col("copies") % F.col("n")).alias("extra")))
    discard(spark, rated_folder)

    # Of the documents of a class the first ones by hash get one copy more; those of earlier cells come first.
    earlier = F.sum("n").over(Window.partitionBy("key", "size").orderBy("cell").rowsBetween(*BEFORE))
    begun = cells.select("key", "size", "cell", F.coalesce(earlier, F.lit(0)).alias("begin"))
    whole = begun.join(dealt, ["key", "size"], "left").join(sources.select("key", "source_size", "target"), "key")
    among = F.row_number().over(Window.partitionBy("key", "size", "cell").orderBy("draw", "doc_id"))
    joined = rows.join(whole, ["key", "size", "cell"]).withColumn("place", F.col("begin") + among)
    copies = F.coalesce(F.col("each") + (F.col("place") <= F.col("extra")).cast("long"), F.lit(0))
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.coalesce("rate", F.lit(0.0)).alias("rate"),
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
