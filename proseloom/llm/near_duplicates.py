"""Near duplicates by dart signatures of weighted word shingles.

Each occurrence of a shingle is a region of weight one. Darts hit a region at the
times of a Poisson process that its hash drives, and each dart falls on one coordinate
of the signature. A signature keeps the earliest dart of every coordinate, so two
texts agree on a coordinate with a probability equal to their weighted Jaccard
similarity. Only darts up to a time that fits the text's weight are thrown: a few
darts for each coordinate in all, however long the text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mixed, small_batches, stored, text_bytes
from .components import stars

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
# Rounds in which every text of a bucket is compared with one representative, before whole groups are.
PIVOTS = 3
# Ids of texts up to this number go to every executor, so that the other rows are not shuffled; more are joined.
BROADCAST_IDS = 1_000_000
_random = np.random.Generator(np.random.Philox(key=[10, 20_011]))
LETTER = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
# Bytes of a word once all other signs became spaces: letters and digits.
IN_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


def shingles_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of all texts, and the number of each text's.

    Words are runs of letters and digits in lower case. Shorter texts have one shingle of all
    their words; a text without words has none.
    """
    lowered = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    data, offsets = text_bytes(lowered)
    if len(data) and data.max() >= 128:
        # Signs beyond ASCII: only letters and digits stay.
        data, offsets = text_bytes(pc.replace_substring_regex(lowered, r"[^\p{L}\p{N}]+", " "))
    count = len(offsets) - 1
    inside = IN_WORD[data] if len(data) else np.zeros(0, bool)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first_bytes = offsets[:-1][offsets[:-1] < len(data)]
    begins[first_bytes] |= inside[first_bytes]
    places = np.nonzero(inside)[0]
    starts = np.nonzero(begins)[0]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(count, np.int64)
    word = np.cumsum(begins)[places] - 1
    depth = (places - starts[word]).astype(np.uint64)
    words = np.add.reduceat(mixed(LETTER[data[places]] + depth * STEP), np.nonzero(begins[places])[0])
    words = mixed(words)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    in_text = np.bincount(owner, minlength=count)
    firsts = np.concatenate([[0], np.cumsum(in_text)])
    numbers = np.where(in_text >= SHINGLE, in_text - SHINGLE + 1, np.minimum(in_text, 1))
    begin = np.repeat(firsts[:-1] - np.concatenate([[0], np.cumsum(numbers)[:-1]]), numbers) + np.arange(numbers.sum())
    length = np.repeat(np.minimum(in_text, SHINGLE), numbers)
    hashes = np.zeros(len(begin), np.uint64)
    for k in range(SHINGLE):
        there = np.minimum(begin + k, len(words) - 1)
        hashes = np.where(k < length, mixed(hashes * STEP + words[there]), hashes)
    return hashes, numbers


def regions_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each occurrence of a shingle (its first, second, …), and their number by text.

    The weighted Jaccard similarity of two texts is the plain one of these sets.
    """
    hashes, numbers = shingles_of(column)
    owner = np.repeat(np.arange(len(numbers)), numbers)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
    return mixed(hashes + (np.arange(len(hashes)) - run).astype(np.uint64) * STEP), numbers


def signatures_of(regions: np.ndarray, numbers: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The earliest dart of every coordinate, text by text; rows of empty texts are zero."""
    count = len(numbers)
    owner = np.repeat(np.arange(count), numbers)
    best = np.full(count * coordinates, np.inf)
    mark = np.zeros(count * coordinates, np.uint64)
    darts = coordinates * np.log(coordinates) + 2 * coordinates
    limit = darts / np.maximum(numbers, 1)
    # A region's process goes on from its last dart when its text needs more time.
    time, dart = np.zeros(len(regions)), np.zeros(len(regions), np.uint64)
    pending = np.nonzero(numbers > 0)[0]
    while len(pending):
        lacking = np.zeros(count, bool)
        lacking[pending] = True
        live = np.nonzero(lacking[owner])[0]
        while len(live):
            seed = mixed(regions[live] + (dart[live] + np.uint64(1)) * STEP)
            gap = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
            after = time[live] + gap
            thrown = after <= limit[owner[live]]
            live, after, seed = live[thrown], after[thrown], seed[thrown]
            time[live] = after
            dart[live] += np.uint64(1)
            token = mixed(seed + STEP)
            at = owner[live] * coordinates + (token % np.uint64(coordinates)).astype(np.int64)
            # Latest first, so that the earliest dart of a coordinate is written last.
            order = np.argsort(-after, kind="stable")
            at, after, token = at[order], after[order], token[order]
            early = after < best[at]
            at, after, token = at[early], after[early], token[early]
            best[at] = after
            mark[at] = token
        full = np.isfinite(best.reshape(count, coordinates)).all(axis=1)
        pending = pending[~full[pending]]
        limit[pending] *= 2
    return mark.reshape(count, coordinates)


def signatures(documents: DataFrame) -> DataFrame:
    """``text_id, bands``: band keys of every distinct text that has words.

    ``documents`` needs ``text_id`` and ``text``.
    """
    small_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            regions, numbers = regions_of(batch["text"])
            marks = signatures_of(regions, numbers)[numbers > 0]
            keys = np.zeros((len(marks), BANDS), np.uint64)
            for k in range(ROWS):
                keys = mixed(keys * STEP + marks.reshape(len(marks), BANDS, ROWS)[:, :, k])
            keys = mixed(keys + np.arange(BANDS, dtype=np.uint64) * STEP).astype(np.int64)
            ends = pa.array(np.arange(len(marks) + 1, dtype=np.int32) * BANDS)
            ids = batch["text_id"].filter(pa.array(numbers > 0))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=["text_id", "bands"])

    return documents.select("text_id", "text").mapInArrow(run, "text_id long, bands array<long>")


def regions(documents: DataFrame) -> DataFrame:
    """``text_id, size, regions``: the weighted shingle set of every text, for exact comparison."""

    def run(batches):
        for batch in batches:
            found, numbers = regions_of(batch["text"])
            ends = pa.array(np.concatenate([[0], np.cumsum(numbers)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(found.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["text_id"], pa.array(numbers, pa.int64()), lists], names=["text_id", "size", "regions"])

    return documents.select("text_id", "text").mapInArrow(run, "text_id long, size long, regions array<long>")


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``text_id`` is among ``ids``, distinct ones."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "text_id", "left_semi")


def _open_bands(placed: DataFrame) -> DataFrame:
    """The buckets in which two texts of different components were not compared yet, and the next representative of each.

    ``placed``: band, text_id, weight, root, used (was the representative of the bucket, which
    was compared with all others of it). Returns ``band, next, part``: the most central text outside the
    components of the representatives before, and its component; both are null if there is none.
    """
    central = F.struct("weight", (-F.col("text_id")).alias("low"))
    parts = placed.groupBy("band", "root").agg(
        F.bool_or("used").alias("had"), (~F.bool_and("used")).cast("int").alias("rest"), F.max(central).alias("top")
    )
    fresh = F.when(~F.col("had"), F.col("top"))
    found = parts.groupBy("band").agg(F.sum("rest").alias("parts"), F.max_by(F.struct("top.low", "root"), fresh).alias("p"))
    return found.where("parts > 1").select("band", (-F.col("p.low")).alias("next"), F.col("p.root").alias("part"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, str]:
    """Of the pairs ``a, b`` of texts those whose exact weighted similarity reaches the limit, and a folder they need."""
    # Sizes alone rule out pairs that cannot be similar enough, before any set is sent.
    sized = pairs.join(sets.select(F.col("text_id").alias("a"), F.col("size").alias("na")), "a")
    sized = sized.join(sets.select(F.col("text_id").alias("b"), F.col("size").alias("nb")), "b")
    fits = F.least("na", "nb") >= similarity * F.greatest("na", "nb")
    pairs, folder = stored(sized.where(fits).select("a", "b"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("text_id")).distinct()
    sets = _of_ids(sets, ids)
    left = sets.select(F.col("text_id").alias("a"), F.col("regions").alias("ra"))
    right = sets.select(F.col("text_id").alias("b"), F.col("regions").alias("rb"))
    common = F.size(F.array_intersect("ra", "rb"))
    found = pairs.join(left, "a").join(right, "b")
    found = found.where(common >= similarity * (F.size("ra") + F.size("rb") - common)).select("a", "b")
    return found, folder


def _able(sets: DataFrame, similarity: float, rounds: int = 2) -> DataFrame:
    """``text_id, size, regions`` of the texts that can be similar to another one at all.

    What two texts have in common is at most what either shares with any text. So a
    text of which too much stands nowhere else is similar to none, and leaves; then
    the same is asked of the rest once more.
    """
    left = sets.select("text_id", "size", "regions")
    for _ in range(rounds):
        counts = left.select("text_id", F.explode("regions").alias("region")).groupBy("region")
        alone = counts.agg(F.count("*").alias("n"), F.min("text_id").alias("text_id")).where("n = 1")
        alone = alone.groupBy("text_id").agg(F.count("*").alias("alone"))
        left = left.join(alone, "text_id", "left").where(F.col("size") - F.coalesce("alone", F.lit(0)) >= similarity * F.col("size"))
        left = left.select("text_id", "size", "regions")
    return left


def _possible(able: DataFrame, roots: DataFrame, similarity: float) -> tuple[DataFrame, str]:
    """Pairs ``a, b`` (and the folder they are read from) of texts from different components that their rarest shingles do not rule out.

    Shingles are put in order from the rarest on. Two texts that are similar enough
    share one among the first of both: with fewer, too little would be left to share.
    The places of the first shared one bound what they can share from there on.
    """
    each = able.select("text_id", "size", F.explode("regions").alias("region"))
    counts = each.groupBy("region").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("text_id").orderBy("n", "region")
    placed = each.join(counts, "region").withColumn("place", F.row_number().over(ordered))
    first = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1
    rare = placed.where((F.col("place") <= first) & (F.col("n") > 1)).join(roots.select(F.col("a").alias("text_id"), F.col("b").alias("root")), "text_id", "left")
    rare, folder = stored(rare.select("region", "text_id", "size", "place", F.coalesce("root", "text_id").alias("root")))
    left = rare.select("region", *[F.col(c).alias(f"{c}_a") for c in ("text_id", "size", "place", "root")])
    right = rare.select("region", *[F.col(c).alias(f"{c}_b") for c in ("text_id", "size", "place", "root")])
    rest = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + 1
    needed = similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-9
    fits = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")
    met = (left["region"] == right["region"]) & (F.col("text_id_a") > F.col("text_id_b")) & (F.col("root_a") != F.col("root_b")) & fits & (rest >= needed)
    pairs = left.join(right, met).select(F.col("text_id_a").alias("a"), F.col("text_id_b").alias("b")).distinct()
    return pairs, folder


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, kept``: the class of near duplicates of every document.

    Documents are near duplicates if the weighted Jaccard similarity of their
    five-word shingles is at least ``similarity``; a class is a connected set of them,
    named by its least ``doc_id``, whose row is ``kept``. Equal texts always share a class. Null
    and empty texts, and texts without words, have no shingles: only equal ones among
    those with characters are copies, null and empty texts are in a class of their own
    each. Rows of one ``doc_id`` are one document: they share a class, and one of them
    at most is kept. Null ids stay apart from all others, with ``kept`` true. An empty
    table gives an empty result; other columns are not read.

    Of equal texts only one goes on. In a bucket of equal band keys every text is compared
    with a representative: the text that meets most others, over all its buckets, as it has
    least of its own. While a bucket is in several components, the next representative is
    the one among the texts outside the components of those before. Where a few rounds
    leave a bucket in several components, all pairs across components are compared that
    their sizes and rarest shingles do not rule out; none is compared within a component,
    which cannot change the classes.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    keyed = named.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    groups = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("text_id"))
    members, _ = stored(keyed.join(groups, ["h1", "h2"]).select("doc_id", "text_id").distinct())
    heads = members.where("doc_id = text_id").select("text_id")
    # Several texts of one id are tied to each other.
    tied = members.groupBy("doc_id").agg(F.min("text_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    tied = members.join(tied, "doc_id").where("text_id <> b").select(F.col("text_id").alias("a"), "b")
    # A signature is far smaller than its text, so copies leave after signing.
    whole = named.select(F.col("doc_id").alias("text_id"), "text")
    bands = signatures(whole).join(heads, "text_id", "left_semi").select("text_id", F.explode("bands").alias("band")).distinct()
    bands, bands_folder = stored(bands)
    busy = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met, met_folder = stored(bands.join(busy, "band"))
    discard(spark, bands_folder)
    weights = met.groupBy("text_id").agg(F.sum("n").alias("weight"))
    shared, shared_folder = stored(met.join(weights, "text_id").select("band", "text_id", "weight"))
    discard(spark, met_folder)
    # An id with several texts has the sets of all of them.
    sets, sets_folder = stored(regions(_of_ids(whole, shared.select("text_id").distinct())))

    old, compared = [sets_folder, shared_folder], None
    roots, roots_folder = stars(tied)

    def rooted(rows: DataFrame) -> DataFrame:
        """The rows, each with the least text of its component."""
        return rows.join(roots.select(F.col("a").alias("text_id"), F.col("b").alias("root")), "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))

    placed = rooted(shared.withColumn("used", F.lit(False)))
    for _ in range(PIVOTS):
        chosen, folder = stored(_open_bands(placed))
        met = placed.join(chosen, "band").where("root <> part").select(F.col("text_id").alias("a"), F.col("next").alias("b"))
        met = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        if compared is not None:
            met = met.join(compared, ["a", "b"], "left_anti")
        met, met_folder = stored(met)
        old += [folder, met_folder]
        if not met.take(1):
            break
        like, like_folder = verified(met, sets, similarity)
        found, found_folder = stored(like)
        old += [like_folder, found_folder]
        compared = met if compared is None else compared.union(met)
        if found.take(1):
            old.append(roots_folder)
            roots, roots_folder = stars(roots.union(found))
        # A bucket that is not open stays so: only the others go on.
        used = F.col("used") | F.coalesce(F.col("text_id") == F.col("next"), F.lit(False))
        placed, folder = stored(rooted(placed.join(chosen, "band").select("band", "text_id", "weight", used.alias("used"))))
        old.append(folder)

    # Buckets whose texts are not all in one component yet: compare across components.
    open_, open_folder = stored(placed.join(_open_bands(placed), "band", "left_semi").select("text_id").distinct())
    old.append(open_folder)
    if compared is not None and open_.take(1):
        able, able_folder = stored(_able(_of_ids(sets, open_), similarity))
        across, rare_folder = _possible(able, roots, similarity)
        like, like_folder = verified(across.join(compared, ["a", "b"], "left_anti"), sets, similarity)
        more, more_folder = stored(like)
        old += [able_folder, rare_folder, like_folder, more_folder]
        if more.take(1):
            old.append(roots_folder)
            roots, roots_folder = stars(roots.union(more))
    for folder in old:
        discard(spark, folder)

    classes = rooted(members).groupBy("doc_id").agg(F.min("root").alias("class_id"))
    known = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    known = known.join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n")
    known = known.select("doc_id", "class_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    known = known.select("doc_id", "class_id", ((F.col("doc_id") == F.col("class_id")) & (F.col("k") == 1)).alias("kept"))
    unnamed = rows.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return known.union(unnamed)
