"""Codes of vectors by a codebook for each part, refined with metric trees over the parts.

Vectors become whole numbers and are cut into equal parts. Blocks of vectors get one tree
for each part position, built once by the anchors hierarchy from the middle out: about
``sqrt(n)`` anchors, each the point farthest from those before, take over the points
nearest to them; anchors are then joined upwards, the pair with the smallest joint ball
first, and large ones are divided again in the same way. Every ball caches the sum and the
number of its parts.

A round goes down the trees with lists of candidate entries. A ball passes on only the
entries that can be nearest to a point in it; a ball with one entry left is wholly owned,
and its cached sum and number are added at once. Only the points of leaves that several
entries share are compared one by one. The bounds leave a margin for rounding, so codes
are those of a full comparison.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
# Vectors whose trees are built together, and points of a ball that is not divided.
BLOCK, LEAF = 2048, 96
# Components from here on would let squared distances leave 64 bits.
LARGEST = 1 << 26
MARGIN = 1e-9


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact for whole numbers."""
    largest = max(float(np.abs(points).max(initial=0)), float(np.abs(entries).max(initial=0)))
    if points.dtype.kind == "f" or 8 * points.shape[1] * largest**2 < 1 << 53:
        points, entries = points.astype(np.float64), entries.astype(np.float64)
        return np.maximum((points**2).sum(1)[:, None] - 2 * points @ entries.T + (entries**2).sum(1), 0)
    out = np.zeros((len(points), len(entries)), np.int64)
    for k in range(points.shape[1]):
        out += (points[:, k, None] - entries[None, :, k]) ** 2
    return out


class PartTree:
    """Balls over the distinct parts of one position in a block, with their sums and numbers."""

    def __init__(self, parts: np.ndarray):
        points, self.place, self.weight = np.unique(parts, axis=0, return_inverse=True, return_counts=True)
        self.place = self.place.reshape(-1)
        self.balls: list[tuple] = []
        self.leaves: list[np.ndarray] = []
        self.far = points.astype(np.float64)
        self._grow(np.arange(len(points)))
        del self.far
        # Points in the order of the leaves, so that a ball is a range of them.
        order = np.concatenate(self.leaves)
        ends = np.cumsum([len(leaf) for leaf in self.leaves])
        self.points, self.weight = points[order], self.weight[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.place = back[self.place]
        self.centre = np.array([ball[0] for ball in self.balls])
        self.radius = np.array([ball[1] for ball in self.balls])
        self.children = np.array([ball[2] for ball in self.balls])
        leaf = np.array([ball[3] for ball in self.balls])
        self.first = np.where(leaf >= 0, ends[leaf] - np.array([len(x) for x in self.leaves])[leaf], 0)
        self.last = np.where(leaf >= 0, ends[leaf], 0)
        del self.balls, self.leaves
        weighted = self.points * self.weight[:, None]
        self.count = np.zeros(len(leaf), np.int64)
        self.sums = np.zeros((len(leaf), points.shape[1]), np.int64)
        # Children stand before their parents.
        for k, (left, right) in enumerate(self.children):
            if left < 0:
                span = slice(self.first[k], self.last[k])
                self.count[k], self.sums[k] = self.weight[span].sum(), weighted[span].sum(0)
            else:
                self.count[k], self.sums[k] = self.count[left] + self.count[right], self.sums[left] + self.sums[right]

    def _ball(self, members: np.ndarray, children: tuple[int, int], leaf: int) -> int:
        points = self.far[members]
        centre = points.mean(0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(1).max()))
        self.balls.append((centre, radius, children, leaf))
        return len(self.balls) - 1

    def _grow(self, members: np.ndarray) -> int:
        """The ball of these points, with all balls below it."""
        if len(members) <= LEAF:
            self.leaves.append(members)
            return self._ball(members, (-1, -1), len(self.leaves) - 1)
        groups = self._anchors(members)
        return self._joined(groups, [self._grow(group) for group in groups])

    def _anchors(self, members: np.ndarray) -> list[np.ndarray]:
        """The points by their nearest anchor; each new anchor is the point farthest from its own."""
        points = self.far[members]
        owner = np.zeros(len(members), np.int64)
        distance = ((points - points[0]) ** 2).sum(1)
        anchors = [0]
        for new in range(1, int(np.ceil(np.sqrt(len(members))))):
            far = int(distance.argmax())
            if distance[far] == 0:
                break
            between = ((points[anchors] - points[far]) ** 2).sum(1)
            # A point nearer to its anchor than half the way to the new one stays.
            asked = np.nonzero(4 * distance > between[owner] * (1 - MARGIN))[0]
            own = ((points[asked] - points[far]) ** 2).sum(1)
            taken = asked[own < distance[asked]]
            distance[taken] = own[own < distance[asked]]
            owner[taken] = new
            anchors.append(far)
        order = np.argsort(owner, kind="stable")
        cuts = np.nonzero(np.diff(owner[order]))[0] + 1
        return [members[part] for part in np.split(order, cuts)]

    def _joined(self, groups: list[np.ndarray], balls: list[int]) -> int:
        """One ball above all, by joining the two whose joint ball is smallest, again and again."""
        centre = np.array([self.balls[b][0] for b in balls])
        radius = np.array([self.balls[b][1] for b in balls])
        size = np.array([len(g) for g in groups], np.float64)

        def joint(k: int) -> np.ndarray:
            apart = np.sqrt(((centre - centre[k]) ** 2).sum(1))
            share = size / (size + size[k])
            found = np.maximum(share * apart + radius[k], (1 - share) * apart + radius)
            found[gone] = np.inf
            found[k] = np.inf
            return found

        gone = np.zeros(len(balls), bool)
        cost = np.array([joint(k) for k in range(len(balls))])
        groups, balls = list(groups), list(balls)
        for _ in range(len(balls) - 1):
            a, b = np.unravel_index(cost.argmin(), cost.shape)
            groups[a] = np.concatenate([groups[a], groups[b]])
            balls[a] = self._ball(groups[a], (balls[a], balls[b]), -1)
            centre[a], radius[a], size[a] = *self.balls[balls[a]][:2], len(groups[a])
            gone[b] = True
            cost[b] = cost[:, b] = np.inf
            cost[a] = cost[:, a] = joint(a)
            last = balls[a]
        return last if len(groups) > 1 else balls[0]

    def assign(self, entries: np.ndarray, compared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest entry of every distinct point, and sums and numbers by entry.

        ``compared`` gets the number of single comparisons.
        """
        sums = np.zeros((len(entries), self.points.shape[1]), np.int64)
        counts = np.zeros(len(entries), np.int64)
        codes = np.zeros(len(self.points), np.int64)
        between = np.sqrt(squared(entries, entries).astype(np.float64))
        # Of equal entries only the first one can be nearest.
        _, first = np.unique(entries, axis=0, return_index=True)
        able = np.zeros((1, len(entries)), bool)
        able[0, first] = True
        balls, shared, shared_able = np.array([len(self.centre) - 1]), [], []
        covers: list[tuple[np.ndarray, np.ndarray]] = []
        while len(balls):
            distance = np.where(able, squared(self.centre[balls], entries.astype(np.float64)), np.inf)
            best = distance.argmin(1)
            least = distance[np.arange(len(balls)), best][:, None]
            reach = 2 * self.radius[balls][:, None] * between[best]
            able = able & ~(distance - least > reach + MARGIN * (reach + distance + least) + MARGIN)
            owned = able.sum(1) == 1
            np.add.at(counts, best[owned], self.count[balls[owned]])
            np.add.at(sums, best[owned], self.sums[balls[owned]])
            covers.append((balls[owned], best[owned]))
            leaf = self.children[balls, 0] < 0
            shared.append(balls[~owned & leaf])
            shared_able.append(able[~owned & leaf])
            down = ~owned & ~leaf
            able = np.repeat(able[down], 2, axis=0)
            balls = self.children[balls[down]].reshape(-1)
        leaves, able = np.concatenate(shared), np.concatenate(shared_able)
        if len(leaves):
            sizes = self.last[leaves] - self.first[leaves]
            at = np.repeat(self.first[leaves] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            able = np.repeat(able, sizes, axis=0)
            distance = squared(self.points[at], entries)
            distance = np.where(able, distance, np.iinfo(np.int64).max if distance.dtype.kind == "i" else np.inf)
            codes[at] = distance.argmin(1)
            np.add.at(counts, codes[at], self.weight[at])
            np.add.at(sums, codes[at], self.points[at] * self.weight[at, None])
            if compared is not None:
                compared.append(int(able.sum()))
        self._cover(codes, covers)
        return codes, sums, counts

    def _cover(self, codes: np.ndarray, covers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Write the entry of wholly owned balls to the points below them."""
        for balls, best in covers:
            while len(balls):
                leaf = self.children[balls, 0] < 0
                for ball, entry in zip(balls[leaf].tolist(), best[leaf].tolist()):
                    codes[self.first[ball] : self.last[ball]] = entry
                best = np.repeat(best[~leaf], 2)
                balls = self.children[balls[~leaf]].reshape(-1)


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of whole numbers."""
    flat = np.floor(np.asarray(vectors.flatten(), np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"components must be below {LARGEST // SCALE} in size")
    return flat.astype(np.int64).reshape(len(vectors), -1)


def trees(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """``vec_ids, labels, trees``: blocks of vectors with the trees of all parts."""
    small_batches(vectors.sparkSession)

    def build(batches):
        def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            numbers = whole_numbers(table["vector"])
            narrow = np.int16 if np.abs(numbers).max() < 1 << 15 else np.int32
            found = [PartTree(part) for part in np.split(numbers, parts, axis=1)]
            for tree in found:
                tree.points, tree.place = tree.points.astype(narrow), tree.place.astype(np.uint16)
                tree.weight, tree.centre = tree.weight.astype(np.uint16), tree.centre.astype(np.float64)
            ends = pa.array([0, table.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, table[name]) for name in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays(
                [*lists, pa.array([pickle.dumps(found, protocol=5)], pa.binary())], names=["vec_ids", "labels", "trees"]
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                more = batch.slice(at, BLOCK - sum(map(len, held)))
                held.append(more)
                at += more.num_rows
                if sum(map(len, held)) == BLOCK:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    kinds = f"vec_ids array<long>, labels array<{vectors.schema['label'].dataType.simpleString()}>, trees binary"
    return vectors.select("vec_id", "label", "vector").mapInArrow(build, kinds)


def _loaded(content: bytes) -> list[PartTree]:
    found = pickle.loads(content)
    for tree in found:
        tree.points, tree.place, tree.weight = (x.astype(np.int64) for x in (tree.points, tree.place, tree.weight))
    return found


def refined(blocks: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries, each replaced by the floor of the mean of its parts; unused ones stay.

    At most one row for each number of the codebooks reaches the driver.
    """
    parts, size, width = entries.shape

    def sums(batches):
        total, count = np.zeros(entries.shape, np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            for content in batch["trees"]:
                for part, tree in enumerate(_loaded(content.as_py())):
                    _, more, number = tree.assign(entries[part])
                    total[part] += more
                    count[part] += number
        part, entry = np.nonzero(count)
        columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part))]
        columns += [total[part, entry].reshape(-1), np.repeat(count[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "total", "n"])

    found = blocks.select("trees").mapInArrow(sums, "part long, entry long, place long, total long, n long")
    found = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    after = entries.copy()
    for row in found:
        after[row["part"], row["entry"], row["place"]] = row["total"] // row["n"]
    return after


def coded(blocks: DataFrame, entries: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector of the blocks."""
    parts = len(entries)

    def code(batches):
        for batch in batches:
            for ids, labels, content in zip(batch["vec_ids"], batch["labels"], batch["trees"]):
                codes = np.zeros((len(ids), parts), np.uint8)
                error = np.zeros(len(ids), np.int64)
                for part, tree in enumerate(_loaded(content.as_py())):
                    own, _, _ = tree.assign(entries[part])
                    codes[:, part] = own[tree.place]
                    error += ((tree.points - entries[part][own]) ** 2).sum(1)[tree.place]
                text = codes.tobytes().hex()
                names = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array(names, pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    label = blocks.schema["labels"].dataType.elementType.simpleString()
    return blocks.mapInArrow(code, f"vec_id long, label {label}, code string, error long")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the rows whose vector is whole: no null, no component null or not finite."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce((x < float("inf")) & (x > float("-inf")), F.lit(False)))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.where(F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every usable vector.

    ``vectors`` needs ``vec_id`` and ``embedding`` (an array of numbers), ``label`` may
    lack; other columns are not read. Rows whose vector is null or holds null, infinite or
    NaN components leave. The vector of the smallest ``vec_id`` sets the length, which
    must be a multiple of ``parts`` (else ``ValueError``); vectors of another length leave
    too, as they have no code in these books. Components of 262,144 or more in size raise
    an error in the task, as errors would leave 64 bits.

    Components become ``floor(256 * x)``. Codebooks begin as the parts of the ``entries``
    (256 at most) smallest ids, ties by the vectors; with fewer vectors they are smaller.
    ``code`` has two hex digits for each part, ``error`` is the squared distance to the
    entries, ``label_error`` its sum over equal labels (nulls together), and
    ``codebooks_sha256`` digests all entries. Null ids come last in order and are coded like
    others; rows that repeat are rows each. An empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry has two hex digits: 1 to 256 entries")
    rows = usable(vectors)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not start:
        return rows.select(
            "vec_id", "label", *[F.lit(None).cast(k).alias(n) for n, k in
            (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]
        )
    length = len(start[0]["vector"])
    if length == 0 or length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    if any(len(row["vector"]) != length for row in start):
        fit = rows.where(F.size("vector") == length).orderBy(F.col("vec_id").asc_nulls_last(), "vector")
        start = fit.limit(entries).select("vector").collect()
    books = whole_numbers(pa.array([row["vector"] for row in start], pa.list_(pa.float64())))
    books = np.stack(np.split(books, parts, axis=1))
    blocks, folder = stored(trees(rows.where(F.size("vector") == length), parts))
    for _ in range(rounds):
        books = refined(blocks, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    codes, _ = stored(coded(blocks, books))
    discard(vectors.sparkSession, folder)
    totals = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(totals, codes["label"].eqNullSafe(totals["__label"]))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


# The same rows by full comparison, for the given tables.
def _round_sql(name: str, before: str) -> str:
    return f"""{name}_near AS (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, b.entry, sum((p.v - b.v) * (p.v - b.v)) AS d
    FROM parts p JOIN {before} b ON p.part = b.part AND p.place = b.place GROUP BY ALL
  ) GROUP BY ALL
)"""


def _books_sql(name: str, before: str, near: str) -> str:
    return f"""{name} AS (
  SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v FROM {before} b LEFT JOIN (
    SELECT n.part, n.entry, p.place, floor(sum(p.v)::DOUBLE / count(*))::BIGINT AS v
    FROM {near} n JOIN parts p ON n.vec_id = p.vec_id AND n.part = p.part GROUP BY ALL
  ) m ON b.part = m.part AND b.entry = m.entry AND b.place = m.place
)"""


COMPRESS_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {PARTS} AS w FROM kept
), parts AS (
  SELECT vec_id, i // w AS part, i % w AS place, floor({SCALE} * x::DOUBLE)::BIGINT AS v FROM flat
), b0 AS (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, place, v FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})
), {_round_sql("r1", "b0")}, {_books_sql("b1", "b0", "r1_near")},
{_round_sql("r2", "b1")}, {_books_sql("b2", "b1", "r2_near")}, {_round_sql("r3", "b2")},
coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry::INT)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM r3_near GROUP BY 1
), digest AS (
  SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""
