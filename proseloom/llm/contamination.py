"""Benchmark passages in texts, by fingerprints of item-sized windows. DataFrame operations only.

A window of as many words as an item has gets a 64-bit SimHash of its word shingles.
Four blocks of 16 bits index the fingerprints: if two differ in at most ``RADIUS``
bits, one block differs in at most a quarter of them, so the items are entered under
all blocks that near, and a window finds every item within the radius by its own four
blocks. Pairs found this way are compared by their exact weighted shingle similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

SHINGLE = 5
SIMILARITY = 0.8
# Texts of similarity 0.8 differ in about ten of 64 bits, with a deviation of three.
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
# Bits of one sum: shingles of a window are counted up to two million.
LANE = 21
LANES = 22
# Item shingles up to this number go to every executor; more of them are shuffled.
BROADCAST_ROWS = 500_000
# Bits of the filter of texts: 2 MB on every executor, whatever the input.
FILTER_BITS = 1 << 24
# Windows whose starts fall into one stretch of so many places (or of an item's length) are cut out together.
STRETCH = 256


def _words(text: str) -> Column:
    """Lower-case runs of letters and digits; an empty array for texts without any."""
    spaced = F.trim(F.regexp_replace(F.lower(F.col(text).cast("string")), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced != "", F.split(spaced, " ", -1)).otherwise(F.array().cast("array<string>"))


def _shingles(words: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words, by the place of the first."""
    last = F.size(words) - size
    run = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(last >= 0, run).otherwise(F.array().cast("array<long>"))


def _lane_sums(shingle: str) -> list[Column]:
    """Sums of single bits of the shingles, three to a number."""
    spread, mask = 1 | 1 << 20 | 1 << 40, 1 | 1 << LANE | 1 << 2 * LANE
    bits = [F.shiftrightunsigned(F.col(shingle), 3 * k).bitwiseAND(F.lit(7)) for k in range(LANES)]
    return [F.sum((b * F.lit(spread)).bitwiseAND(F.lit(mask))).alias(f"s{k}") for k, b in enumerate(bits)]


def _mark() -> Column:
    """The fingerprint from the sums: bits that more than half of the shingles have."""
    mark = F.lit(0).cast("long")
    for i in range(64):
        total = F.shiftright(F.col(f"s{i // 3}"), LANE * (i % 3)).bitwiseAND(F.lit((1 << LANE) - 1))
        value = F.lit(1 << i) if i < 63 else F.lit(-(1 << 63))
        mark = mark.bitwiseOR(F.when(total * 2 > F.col("n"), value).otherwise(F.lit(0).cast("long")))
    return mark


def _blocks(mark: str) -> Column:
    return F.array(*[F.shiftrightunsigned(mark, BLOCK_BITS * j).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for j in range(BLOCKS)])


def _starts(hits: str, run: str, least: str) -> Column:
    """All starts whose ``run`` places hold at least ``least`` of the sorted ``hits``; each comes once."""

    def first(i):
        return F.get(hits, i + F.col(least) - 1) - F.col(run) + 1

    firsts = F.filter(F.sequence(F.lit(0), F.size(hits) - F.col(least)), lambda i: first(i) <= F.get(hits, i))
    # Starts up to the hit before were given with that hit.
    every = F.flatten(F.transform(firsts, lambda i: F.sequence(F.greatest(first(i), F.get(hits, i - 1) + 1), F.get(hits, i))))
    return F.when(F.size(hits) >= F.col(least), every).otherwise(F.array().cast("array<int>"))


def _among(texts: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose hash ``key`` is one of ``keys``, and a few whose bit another one has set; no row is shuffled."""
    bit = F.pmod(F.col(key), F.lit(FILTER_BITS)) + 1
    maps = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__row"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = texts.join(F.broadcast(maps), F.bitmap_bucket_number(bit) == F.col("__row"))
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*texts.columns)


def fingerprints(shingles: DataFrame, key: str) -> DataFrame:
    """``key, mark`` from rows ``key, shingle``."""
    return shingles.groupBy(key).agg(F.count("*").alias("n"), *_lane_sums("shingle")).select(key, _mark().alias("mark"))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """``item_id, item, size, length, place, shingle`` of every item with words.

    Items of fewer than five words have one shingle of all of them. ``item`` tells the
    texts of one ``item_id`` apart; rows that repeat count once.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = rows.select("item_id", F.xxhash64("item_id", "text").alias("item"), _words("text").alias("words"))
    rows = rows.where("item_id IS NOT NULL AND size(words) > 0").withColumn("size", F.least(F.size("words"), F.lit(SHINGLE)))
    hashes = F.coalesce(*[F.when(F.col("size") == k, _shingles("words", k)) for k in range(1, SHINGLE + 1)])
    return rows.select("item_id", "item", "size", F.size("words").alias("length"), F.posexplode(hashes).alias("place", "shingle"))


def contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, by_text: bool = False) -> DataFrame:
    """``doc_id, item_id, similarity``: the documents that hold a passage like an item.

    ``by_text`` adds ``text_hash`` (``xxhash64`` of the text) and gives a row for each text of an id.

    A document holds it if a window of the item's number of words has a weighted
    Jaccard similarity of at least ``similarity`` to the item and a fingerprint within
    ``radius`` bits; the highest one is given. Windows of any start are compared, except
    those with too few shingles of items of their length to reach ``similarity``. At the
    ends of a text windows may be shorter. Null and empty texts, null ids of items and items without words match
    nothing; null ids of documents are one document, as are rows of one id. Empty
    tables give an empty result. Other columns are not read.
    """
    small_batches(documents.sparkSession)
    items = cut(item_shingles(benchmark))
    sizes = [row["size"] for row in items.select("size").distinct().collect()]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where("text IS NOT NULL AND text <> ''").withColumn("text_hash", F.xxhash64("text"))

    # Windows with enough shingles of items of their length, wherever these stand in the item.
    worded = texts.select("doc_id", "text_hash", _words("text").alias("words")).withColumn("n_words", F.size("words"))
    found = None
    for k in sorted(sizes) or [SHINGLE]:
        of_size = worded.select("doc_id", "text_hash", "n_words", F.lit(k).alias("size"), F.posexplode(_shingles("words", k)).alias("at", "shingle"))
        found = of_size if found is None else found.union(of_size)
    known = items.select("size", "length", "shingle").distinct()
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    hits = found.join(known, ["shingle", "size"]).groupBy("doc_id", "text_hash", "size", "length")
    hits = hits.agg(F.sort_array(F.collect_set("at")).alias("hits"), F.max("n_words").alias("n_words"))
    hits = hits.withColumn("run", F.col("length") - F.col("size") + 1)
    # A whole window shares at least so many shingles; one that an end of the text cuts may have fewer.
    least = {"whole": 2 * similarity / (1 + similarity), "short": similarity}
    for name, share in least.items():
        hits = hits.withColumn(name, F.greatest(F.ceil(F.col("run") * share - 1e-9).cast("int"), F.lit(1)))
    over = F.col("n_words") - F.col("size") + 1 - F.col("run")
    cut_short = F.filter(_starts("hits", "run", "short"), lambda s: (s < 0) | (s > over))
    starts = hits.where(F.size("hits") >= F.col("short"))
    starts = starts.withColumn("start", F.explode(F.array_union(_starts("hits", "run", "whole"), cut_short)))

    def stretch(length):
        return F.greatest(length, F.lit(STRETCH))

    starts = starts.withColumn("no", F.floor(F.col("start") / stretch(F.col("length"))).cast("int"))
    parts = starts.groupBy("doc_id", "text_hash", "size", "length", "no").agg(F.collect_list("start").alias("starts"))
    windows = parts.groupBy("doc_id", "text_hash", "size").agg(F.collect_list(F.struct("length", "no", "starts")).alias("parts"))

    # Their shingles, from the texts that have such windows: only these are shuffled.
    named = cut(windows.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}))
    held = _among(texts, named.select(F.col("__hash").alias("text_hash")), "text_hash")
    held = held.join(named, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    own = ["doc_id", "text_hash"] if by_text else ["doc_id"]
    held = held.select(*own, "size", _words("text").alias("words"), "parts")
    grams = F.coalesce(*[F.when(F.col("size") == k, _shingles("words", k)) for k in sorted(sizes) or [SHINGLE]])
    held = held.select(*own, "size", grams.alias("grams"), "parts")

    def piece(part):
        """A stretch of a text's shingles, so that no window's row holds them all."""
        low = F.greatest(part["no"] * stretch(part["length"]), F.lit(0))
        cut_out = F.slice("grams", low + 1, (part["no"] + 1) * stretch(part["length"]) + part["length"] - low)
        return F.struct(part["length"].alias("length"), part["starts"].alias("starts"), low.alias("low"), cut_out.alias("grams"))

    held = held.select(*own, "size", F.explode(F.transform("parts", piece)).alias("p"))
    held = held.select(*own, "size", "p.length", "p.low", "p.grams", F.explode("p.starts").alias("start"))
    first = F.greatest(F.col("start"), F.lit(0))
    last = F.col("start") + F.col("length") - F.col("size")
    inside = F.slice("grams", first - F.col("low") + 1, F.greatest(last - first + 1, F.lit(0)))
    held = held.select(*own, "size", F.sort_array(inside).alias("inside"))
    # Windows of equal content are one: copies and shared passages are compared once.
    held = held.withColumn("window", F.xxhash64("size", "inside")).withColumn("window2", F.xxhash64(F.lit("second"), "inside"))
    held = cut(held.where(F.size("inside") > 0))
    distinct = held.groupBy("window", "window2").agg(F.first("size").alias("size"), F.first("inside").alias("inside"))
    rows = distinct.select(F.struct("window", "window2").alias("window"), "size", F.explode("inside").alias("shingle"))

    marks = fingerprints(rows.select("window", "shingle"), "window")
    item_marks = fingerprints(items.select("item", "shingle"), "item")
    near = F.expr(f"filter(sequence(0, {(1 << BLOCK_BITS) - 1}), m -> bit_count(m) <= {radius // BLOCKS})")
    entries = item_marks.select("item", F.col("mark").alias("item_mark"), F.posexplode(_blocks("mark")).alias("no", "block"))
    entries = entries.select("item", "item_mark", "no", F.explode(F.transform(near, lambda m: F.col("block").bitwiseXOR(m))).alias("key"))
    probes = marks.select("window", "mark", F.posexplode(_blocks("mark")).alias("no", "key"))
    # The entries are many times the items, which a plan does not foresee: no broadcast.
    pairs = probes.join(entries.hint("merge"), ["no", "key"]).where(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= radius)
    pairs = pairs.select("window", "item").distinct()

    # Exact weighted similarity: what the two have in common, shingle by shingle.
    window_counts = rows.groupBy("window", "shingle").agg(F.count("*").alias("c"))
    item_counts = items.groupBy("item", "shingle").agg(F.count("*").alias("k"))
    window_size = rows.groupBy("window").agg(F.count("*").alias("nw"))
    item_size = items.groupBy("item_id", "item").agg(F.count("*").alias("ni"))
    common = pairs.join(window_counts, "window").join(item_counts, ["item", "shingle"])
    common = common.groupBy("window", "item").agg(F.sum(F.least("c", "k")).alias("both"))
    scored = common.join(window_size, "window").join(item_size, "item")
    scored = scored.select("window", "item_id", (F.col("both") / (F.col("nw") + F.col("ni") - F.col("both"))).alias("similarity"))
    scored = scored.where(F.col("similarity") >= similarity)
    out = held.select(*own, F.struct("window", "window2").alias("window")).distinct().join(scored, "window")
    return out.groupBy(*own, "item_id").agg(F.max("similarity").alias("similarity"))
