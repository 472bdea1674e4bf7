"""Removal of long byte strings that stand more than once in the collection.

The order of the suffixes of many strings is built column by column: each round puts
one more symbol in front of every string, sorts by that symbol while keeping the order
of the round before, and updates the common prefixes of neighbours. A string repeats
where neighbours share a prefix of its length.

The rounds are as many as a string is long, so whole texts would take a pass over
everything for each byte of the longest one. Equal strings of ``LENGTH`` bytes choose
the same anchor among their shorter grams, the one of least hash, so the collections
are the surroundings of equal anchors: strings of bounded length, aligned at the
anchor, that Spark sorts and splits. Anchors that occur once cannot lie in a repeat
and leave first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, small_batches, text_bytes

LENGTH = 200
GRAM = 64
# Grams in a window of LENGTH bytes; bytes before an anchor that its windows may have.
GRAMS = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
# Surroundings sorted in one go, and the most of one anchor that go to one task.
AT_ONCE = 16_384
MOST_OF_ONE = 50_000
PLACE_BITS = 30
_random = np.random.Generator(np.random.Philox(key=[7, 20_011]))
LETTER = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, length: int = GRAM) -> np.ndarray:
    """Hashes of all runs of ``length`` bytes, a power of two."""
    out, width = LETTER[data], 1
    while width < length:
        out = out[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + out[width:] if len(out) > width else out[:0]
        width *= 2
    return mixed(out)


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of the anchors of all windows of ``LENGTH`` bytes in each text."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH or len(data) >= 1 << PLACE_BITS:
        if len(data) < LENGTH:
            return none, none, none
        # Too long to number the places together: text by text, in overlapping parts.
        return _anchors_in_parts(data, offsets)
    hashes = gram_hashes(data)
    places = np.arange(len(hashes), dtype=np.uint64)
    # The least hash of a window; of equal ones the first.
    least = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
    width = 1
    while width * 2 <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = GRAMS - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    begins = np.arange(len(least))
    owner = np.searchsorted(offsets, begins, side="right") - 1
    inside = begins + LENGTH <= offsets[owner + 1]
    chosen = (least[inside] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    owner = owner[inside]
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    chosen, owner = chosen[new], owner[new]
    return owner, chosen - offsets[owner], hashes[chosen].astype(np.int64)


def _anchors_in_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, part = [], 1 << (PLACE_BITS - 1)
    for i, (start, end) in enumerate(zip(offsets[:-1], offsets[1:])):
        for at in range(start, end, part):
            stop = min(end, at + part + LENGTH - 1)
            _, places, hashes = anchors_of(data[at:stop], np.array([0, stop - at]))
            found.append((np.full(len(places), i), places + at - start, hashes))
    owner, places, hashes = (np.concatenate(c) for c in zip(*found))
    # Parts share an anchor where they overlap.
    _, first = np.unique(np.stack([owner, places]), axis=1, return_index=True)
    return owner[first], places[first], hashes[first]


def repeated(strings: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For aligned strings (one a row) and each column: does the run of ``length`` bytes from
    there stand in another string of the group at the same column?

    A string has bytes from column ``low`` up to ``high``. Columns are added from the
    last one on; ``order`` is the order of the strings by what follows the column, and
    ``common`` how much each has in common with the one before it in that order.
    """
    count, width = strings.shape
    columns = np.ascontiguousarray(strings.T)
    out = np.zeros((width - length + 1, count), bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(count + 1, np.int32)
    # Numbers of groups in 16 bits are sorted in linear time.
    group = np.unique(group, return_inverse=True)[1]
    group = group.astype(np.uint16) if len(group) <= 1 << 16 else group
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order].astype(np.uint16)
        outside = (c < low[order]) | (c >= high[order])
        symbol[outside] = 256
        by_symbol = np.argsort(symbol, kind="stable")
        moved = by_symbol[np.argsort(group[order][by_symbol], kind="stable")]
        order, symbol = order[moved], symbol[moved]
        own = group[order]
        alike = (symbol[1:] == symbol[:-1]) & (own[1:] == own[:-1]) & (symbol[1:] != 256)
        later = np.nonzero(alike)[0] + 1
        after = np.zeros(count + 1, np.int32)
        if len(later):
            # What neighbours have in common is the least of all that lay between them.
            bounds = np.empty(2 * len(later), np.int64)
            bounds[::2], bounds[1::2] = moved[later - 1] + 1, moved[later] + 1
            after[later] = np.minimum.reduceat(common, bounds)[::2] + 1
        common = after
        if c <= width - length:
            same = np.nonzero(common[:-1] >= length)[0]
            out[c][order[same]] = True
            out[c][order[same - 1]] = True
    return out.T


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of marked columns."""
    edges = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edges == 1)
    return row, first, np.nonzero(edges == -1)[1] - 1


def _within(raw: bytes, offsets: np.ndarray, owner: np.ndarray, places: np.ndarray, hashes: np.ndarray):
    """Anchors whose whole surroundings stand in their text before, and the window starts that this settles.

    The windows in such surroundings repeat whatever other texts hold, so only the
    first of them goes on. A text that repeats itself thus sends few anchors.
    """
    order = np.lexsort((hashes, owner))
    alike = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    several = np.zeros(len(order), bool)
    several[1:] |= alike
    several[:-1] |= alike
    seen: dict[tuple[int, bytes], int] = {}
    later, ranges = np.zeros(len(order), bool), []
    for k in np.sort(order[several]).tolist():
        begin, end = int(offsets[owner[k]]), int(offsets[owner[k] + 1])
        low, high = max(begin, begin + int(places[k]) - LEFT), min(end, begin + int(places[k]) + LENGTH)
        first = seen.setdefault((int(owner[k]), raw[low:high]), k)
        if first != k:
            later[k] = True
            for at in (first, k):
                start = max(0, int(places[at]) - LEFT)
                ranges.append((int(owner[k]), start, start + high - low - LENGTH))
    merged: list[list[int]] = []
    for number, start, last in sorted(r for r in set(ranges) if r[2] >= r[1]):
        if merged and merged[-1][0] == number and start <= merged[-1][2] + 1:
            merged[-1][2] = max(merged[-1][2], last)
        else:
            merged.append([number, start, last])
    return later, np.array(merged, np.int64).reshape(-1, 3)


def _anchors(distinct: DataFrame) -> DataFrame:
    """``k1, k2, place, anchor, last`` of every anchor, with ``last`` -1.

    Rows with another ``last`` tell window starts from ``place`` on that repeat within their text.
    """
    names = ["k1", "k2", "place", "anchor", "last"]

    def find(batches):
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            owner, places, hashes = anchors_of(data, offsets)
            later, settled = _within(data.tobytes(), offsets, owner, places, hashes)
            owner, places, hashes = owner[~later], places[~later], hashes[~later]
            rows = pa.array(np.concatenate([owner, settled[:, 0]]))
            k1 = batch["k1"].take(rows)
            # Settled rows need no partner; their text's key spreads them.
            spread = np.concatenate([hashes, k1.to_numpy()[len(owner) :]])
            last = np.concatenate([np.full(len(owner), -1, np.int64), settled[:, 2]])
            columns = [k1, batch["k2"].take(rows), np.concatenate([places, settled[:, 1]]), spread, last]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return distinct.mapInArrow(find, "k1 long, k2 long, place long, anchor long, last long")


def _surroundings(texts: DataFrame) -> DataFrame:
    """``k1, k2, place, anchor, left, around``: the bytes around every anchor in ``found`` of a text."""
    names = ["k1", "k2", "place", "anchor", "left", "around"]

    def cut_out(batches):
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            raw = data.tobytes()
            lists = batch["found"]
            flat = lists.flatten()
            per = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(per)), per)
            places = flat.field("place").to_numpy(zero_copy_only=False)
            begin, end = offsets[owner], offsets[owner + 1]
            low = np.maximum(begin, begin + places - LEFT)
            high = np.minimum(end, begin + places + LENGTH)
            around = [raw[a:b] for a, b in zip(low.tolist(), high.tolist())]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch["k1"].take(rows), batch["k2"].take(rows), pa.array(places), flat.field("anchor"),
                 pa.array((begin + places - low).astype(np.int32)), pa.array(around, pa.binary())],
                names=names,
            )

    return texts.mapInArrow(cut_out, "k1 long, k2 long, place long, anchor long, left int, around binary")


def _sorted_repeats(surroundings: DataFrame) -> DataFrame:
    """``k1, k2, first, last``: ranges of window starts that repeat, anchor by anchor."""
    names = ["k1", "k2", "first", "last"]

    def judged(rows: pa.Table) -> pa.RecordBatch:
        anchor = rows["anchor"].to_numpy()
        around = rows["around"].combine_chunks()
        around = around.chunk(0) if isinstance(around, pa.ChunkedArray) else around
        left = rows["left"].to_numpy().astype(np.int64)
        offsets = np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + len(around) + 1].astype(np.int64)
        data = np.frombuffer(around.buffers()[2], np.uint8)
        low = LEFT - left
        size = np.diff(offsets)
        strings = np.zeros((len(anchor), WIDTH), np.uint8)
        row = np.repeat(np.arange(len(anchor)), size)
        strings[row, np.arange(offsets[0], offsets[-1]) - offsets[:-1][row] + low[row]] = data[offsets[0] : offsets[-1]]
        row, first, last = _runs(repeated(strings, low, low + size, anchor))
        base = rows["place"].to_numpy()[row] - LEFT
        picked = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [rows[k].take(picked).combine_chunks() for k in ("k1", "k2")] + [pa.array(base + first), pa.array(base + last)], names=names
        )

    def sort(batches):
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= AT_ONCE:
                rows = pa.Table.from_batches(held)
                anchor = rows["anchor"].to_numpy()
                # The last anchor may go on in the next batch.
                whole = int(np.nonzero(anchor != anchor[-1])[0][-1]) + 1 if anchor[0] != anchor[-1] else 0
                if whole:
                    yield judged(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                count = sum(b.num_rows for b in held)
        if count:
            yield judged(pa.Table.from_batches(held))

    columns = ["k1", "k2", "place", "anchor", "left", "around"]
    ordered = surroundings.select(*columns).repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(sort, "k1 long, k2 long, first long, last long")


def _hashed_repeats(surroundings: DataFrame) -> DataFrame:
    """The same for anchors with too many surroundings for one task: window by window.

    Counts are combined before they are shuffled, and a frequent window only joins
    its count.
    """
    starts = F.sequence(F.lit(0), F.octet_length("around") - LENGTH)
    wide = surroundings.where(F.octet_length("around") >= LENGTH)
    each = wide.select("k1", "k2", (F.col("place") - F.col("left")).alias("base"), "around", F.explode(starts).alias("at"))
    window = F.substring("around", F.col("at") + 1, F.lit(LENGTH))
    each = each.select("k1", "k2", (F.col("base") + F.col("at")).alias("start"), F.xxhash64(window).alias("w1"), F.xxhash64(F.lit("second"), window).alias("w2"))
    # A window may lie around several anchors; it counts once for each place.
    each = each.distinct()
    often = each.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    return each.join(often, ["w1", "w2"]).select("k1", "k2", F.col("start").alias("first"), F.col("start").alias("last"))


def remove_repeats(documents: DataFrame, most_of_one: int = MOST_OF_ONE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every document.

    A byte goes if a string of ``LENGTH`` bytes covers it that also starts elsewhere in
    the UTF-8 bytes of the texts; strings end with their text and are judged on the
    input. ``n_spans`` counts maximal removed runs. Null texts count as empty; texts of
    less than ``LENGTH`` bytes lose nothing. Every row gets a result, and rows that
    repeat are copies of each other. An empty table gives an empty result; other
    columns are not read.
    """
    small_batches(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"), "text")
    # Equal texts are one; shuffled once, as all three uses have the same columns.
    distinct = rows.select("k1", "k2", "text").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"))

    anchors = _anchors(distinct).withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1 OR last >= 0")

    def around(found: DataFrame) -> DataFrame:
        by_text = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "anchor")).alias("found"))
        return _surroundings(distinct.join(by_text, ["k1", "k2"]))

    open_ = anchors.where("last < 0")
    ranges = _sorted_repeats(around(open_.where(F.col("n") <= most_of_one)))
    ranges = ranges.union(_hashed_repeats(around(open_.where(F.col("n") > most_of_one))))
    ranges = ranges.union(anchors.where("last >= 0").select("k1", "k2", F.col("place").alias("first"), "last"))
    by_text = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    judged = distinct.join(by_text, ["k1", "k2"], "left").join(copies, ["k1", "k2"])
    names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def cut_off(batches):
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            out = []
            counts, lists = batch["n"].to_pylist(), batch["ranges"]
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                own = data[a:b]
                if len(own) < LENGTH:
                    gone = np.zeros(len(own), bool)
                elif counts[i] > 1:
                    gone = np.ones(len(own), bool)
                elif lists[i].values is None:
                    gone = np.zeros(len(own), bool)
                else:
                    first = lists[i].values.field("first").to_numpy()
                    last = lists[i].values.field("last").to_numpy()
                    steps = np.bincount(first, minlength=len(own) + 1) - np.bincount(last + LENGTH, minlength=len(own) + 1)
                    gone = np.cumsum(steps)[: len(own)] > 0
                kept = own[~gone].tobytes()
                spans = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((len(own), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch["k1"], batch["k2"], *columns], names=names)

    done = judged.mapInArrow(cut_off, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return rows.select("doc_id", "k1", "k2").join(done, ["k1", "k2"]).select("doc_id", *names[2:])
