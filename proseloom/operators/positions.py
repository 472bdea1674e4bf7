"""Positional index of books: where a passage stands, without moving the book to it.

Every word of a book is a row with its place, the hash of all that stands before it, and
keys of the few words from it on. A passage is looked up by the key of its own first
words; the hashes at its two ends then tell whether everything between them is equal.
The first word of a passage may be the end of a word of the book, and its last word the
beginning of one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Two moduli below 2^31, so that products stay within 64 bits; together they tell passages apart.
MODULI = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_103_515_245, 1_299_709_117)
# Rows sent at once, and words a worker remembers.
SENT, KEPT = 1 << 16, 500_000
# Characters at the ends of a passage of two words that its key holds.
ENDS = ((2, 2), (2, 1), (1, 2), (1, 1))
_known: dict[str, tuple[int, ...]] = {}


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _marks(word: str) -> tuple[int, ...]:
    """Hashes of a word, of its last one and two characters and of its first ones; 0 where it is too short."""
    known = _known.get(word)
    if known is None:
        two = len(word) > 1
        known = (_hash(word), _hash(word[-1:]), _hash(word[-2:]) * two, _hash(word[:1]), _hash(word[:2]) * two)
        if len(_known) >= KEPT:
            _known.clear()
        _known[word] = known
    return known


def _powers(count: int, base: int, modulus: int) -> np.ndarray:
    out, filled = np.ones(count, np.int64), 1
    while filled < count:
        more = min(filled, count - filled)
        out[filled : filled + more] = out[:more] * pow(base, filled, modulus) % modulus
        filled += more
    return out


def _sums(tokens: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each modulus the hashes of all beginnings of the tokens, and the powers at them."""
    found = []
    for base, modulus in zip(BASES, MODULI):
        powers = _powers(len(tokens) + 1, base, modulus)
        terms = (tokens % np.uint64(modulus)).astype(np.int64) * powers[:-1] % modulus
        found.append((np.concatenate([[0], np.cumsum(terms) % modulus]), powers))
    return found


def _mixed(*parts: np.ndarray) -> np.ndarray:
    key = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.astype(np.int64)


class _Text:
    """Words of a text with their places, and hashes over words and the gaps between them."""

    def __init__(self, text: str, exact: bool):
        found = list(re.finditer(r"\S+", text))
        self.words = [m.group() for m in found]
        self.origin = [m.start() for m in found]
        count = len(self.words)
        self.starts = self.origin if exact else list(accumulate((len(w) + 1 for w in self.words), initial=0))[:count]
        self.marks = np.array([_marks(w) for w in self.words], np.uint64).reshape(count, 5)
        # Word, gap, word, gap, …: only the exact search tells gaps apart.
        self.tokens = np.ones(2 * count, np.uint64)
        self.tokens[::2] = self.marks[:, 0]
        if exact:
            gaps = [text[a.end() : b.start()] for a, b in zip(found, found[1:])]
            self.tokens[1 : 2 * count - 1 : 2] = [_marks(g)[0] for g in gaps]

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys by first word for passages of four and more, three or two words, and whether there are such."""
        marks, count = self.marks, len(self.words)
        span = {0: 4, 1: 3}.get(kind, 2)
        rows = max(count - span + 1, 0)
        at = lambda column, step: marks[step : step + rows, column]
        if kind == 0:
            found = [at(1, 0), at(0, 1), at(0, 2), at(3, 3)]
        elif kind == 1:
            found = [at(1, 0), at(0, 1), at(3, 2)]
        else:
            tail, head = ENDS[kind - 2]
            found = [at(tail, 0), at(2 + head, 1)]
        able = np.zeros(count, bool)
        able[:rows] = (found[0] != 0) & (found[-1] != 0)
        keys = np.zeros(count, np.int64)
        keys[:rows] = _mixed(np.full(rows, kind + 1, np.uint64), *found)
        return keys, able


def _kind(words: Sequence[str]) -> int:
    if len(words) != 2:
        return 0 if len(words) >= 4 else 1
    return 2 + ENDS.index((min(2, len(words[0])), min(2, len(words[1]))))


def _repeated(batch: pa.RecordBatch, keys: Sequence[str], row: int, count: int) -> list[pa.Array]:
    return [batch[k].take(pa.array(np.full(count, row))) for k in keys]


def _spelled(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


WORD = ["at", "word", "start", "src", "ahead1", "ahead2", "past1", "past2", "power1", "power2", "lookup"]


def book_words(books: DataFrame, keys: Sequence[str], kinds: Sequence[int], exact: bool) -> DataFrame:
    """A row for each word of each book (``keys, source``), with ``lookup``: its keys of the asked kinds."""
    keys, kinds = list(keys), list(kinds)

    def run(batches):
        for batch in batches:
            for row, source in enumerate(batch["source"]):
                text = _Text(source.as_py() or "", exact)
                count, sums = len(text.words), _sums(text.tokens)
                looked = [text.keys(kind) for kind in kinds]
                able = np.array([a for _, a in looked], bool).reshape(len(kinds), count)
                found = np.array([k for k, _ in looked], np.int64).reshape(len(kinds), count)
                for a in range(0, count, SENT):
                    b = min(a + SENT, count)
                    of_word = able[:, a:b].T
                    ends = np.concatenate([[0], np.cumsum(of_word.sum(1))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[:, a:b].T[of_word]))
                    columns = [pa.array(np.arange(a, b)), pa.array(text.words[a:b], pa.string())]
                    columns += [pa.array(text.starts[a:b], pa.int64()), pa.array(text.origin[a:b], pa.int64())]
                    columns += [pa.array(s[2 * a : 2 * b : 2]) for s, _ in sums]
                    columns += [pa.array(s[2 * a + 1 : 2 * b + 1 : 2]) for s, _ in sums]
                    columns += [pa.array(p[2 * a + 1 : 2 * b + 1 : 2]) for _, p in sums]
                    yield pa.RecordBatch.from_arrays([*_repeated(batch, keys, row, b - a), *columns, lists], names=[*keys, *WORD])

    longs = ", ".join(f"{c} long" for c in WORD[2:-1])
    return books.select(*keys, "source").mapInArrow(run, f"{_spelled(books, keys)}, at long, word string, {longs}, lookup array<long>")


def _number(tokens: Sequence[int], base: int, modulus: int) -> int:
    """The hash that :func:`_sums` gives for all tokens."""
    found = 0
    for token in reversed(tokens):
        found = (found * base + token) % modulus
    return found


def _key(kind: int, parts: Sequence[int]) -> int:
    """The key that :meth:`_Text.keys` gives for one word."""
    key = 0
    for part in (kind + 1, *parts):
        key = (key ^ part) * 0x9E3779B97F4A7C15 & _ALL
        key ^= key >> 29
    return key - (1 << 64) if key >> 63 else key


_ALL = (1 << 64) - 1
PASSAGE = ["passage", "words", "length", "first", "last", "inner1", "inner2", "kind", "key"]


def _passage(number: int, needle: str, exact: bool) -> tuple:
    words = needle.split()
    count, marks = len(words), [_marks(w) for w in words]
    if count == 1:
        return number, 1, len(needle), words[0], words[0], 0, 0, -1, 0
    gaps = [_marks(g)[0] for g in re.findall(r"\s+", needle)] if exact else [1] * (count - 1)
    inner = [gaps[0]]
    for mark, gap in zip(marks[1:-1], gaps[1:]):
        inner += (mark[0], gap)
    kind = _kind(words)
    if kind == 0:
        parts = marks[0][1], marks[1][0], marks[2][0], marks[3][3]
    elif kind == 1:
        parts = marks[0][1], marks[1][0], marks[2][3]
    else:
        tail, head = ENDS[kind - 2]
        parts = marks[0][tail], marks[1][2 + head]
    numbers = [_number(inner, base, modulus) for base, modulus in zip(BASES, MODULI)]
    return number, count, len(needle), words[0], words[-1], *numbers, kind, _key(kind, parts)


def passages(texts: DataFrame, keys: Sequence[str], exact: bool) -> DataFrame:
    """What to look for, once each, from rows ``keys, passage, needle`` with at least one word each."""
    keys = list(keys)

    def run(batches):
        for batch in batches:
            rows = [_passage(n, t, exact) for n, t in zip(batch["passage"].to_pylist(), batch["needle"].to_pylist())]
            columns = [pa.array(c, pa.string() if n in ("first", "last") else pa.int64()) for n, c in zip(PASSAGE, zip(*rows))]
            if rows:
                yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *columns], names=[*keys, *PASSAGE])

    kinds = ", ".join(f"{c} {'string' if c in ('first', 'last') else 'long'}" for c in PASSAGE)
    found = texts.select(*keys, "passage", "needle").mapInArrow(run, f"{_spelled(texts, keys)}, {kinds}")
    return found.dropDuplicates([*keys, "passage"])


def occurrences(asked: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, passage, pos, start, end``: every place of every passage.

    ``pos`` counts in the text that was searched, ``start`` and ``end`` in the book as it is.
    """
    keys = list(keys)
    several = asked.where("words > 1")
    places = words.select(*keys, "at", F.explode("lookup").alias("key"))
    met = several.join(places, [*keys, "key"])
    head = words.select(*keys, "at", F.col("word").alias("w"), F.col("start").alias("s"), F.col("src").alias("o"), *WORD[6:10])
    tail = words.select(*keys, F.col("at").alias("end_at"), F.col("word").alias("v"), F.col("src").alias("q"), "ahead1", "ahead2")
    met = met.join(head, [*keys, "at"]).where(F.endswith("w", "first")).withColumn("end_at", F.col("at") + F.col("words") - 1)
    met = met.join(tail, [*keys, "end_at"]).where(F.startswith("v", "last"))
    for k, modulus in enumerate(MODULI, 1):
        between = F.pmod(F.col(f"ahead{k}") - F.col(f"past{k}"), F.lit(modulus))
        met = met.where(between == F.pmod(F.col(f"inner{k}") * F.col(f"power{k}"), F.lit(modulus)))
    skipped = F.length("w") - F.length("first")
    found = met.select(
        *keys, "passage", (F.col("s") + skipped).alias("pos"), (F.col("o") + skipped).alias("start"),
        (F.col("q") + F.length("last")).alias("end"),
    )

    # A single word stands inside words of the book: their spellings are searched by runs of characters.
    single = asked.where("words = 1").select(*keys, "passage", "first", F.substring("first", 1, 3).alias("run"))
    sizes = sorted(r["size"] for r in single.select(F.length("run").alias("size")).distinct().collect())
    if not sizes:
        return found

    def runs(size: int):
        starts = F.sequence(F.lit(1), F.greatest(F.length("word") - size + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substr(F.col("word"), i, F.lit(size)))

    every = F.array_distinct(F.concat(*map(runs, sizes)))
    asking = words.join(single.select(*keys).distinct(), keys, "left_semi")
    spelled = asking.select(*keys, "word").distinct()
    inside = spelled.select(*keys, "word", F.explode(every).alias("run")).join(single, [*keys, "run"])
    inside = inside.where(F.contains("word", "first")).select(*keys, "passage", "first", "word")
    placed = inside.join(asking.select(*keys, "word", "start", "src"), [*keys, "word"])
    steps = F.sequence(F.lit(0), F.length("word") - F.length("first"))
    at = F.filter(steps, lambda i: F.substr(F.col("word"), (i + 1).cast("int"), F.length("first")) == F.col("first"))
    placed = placed.select(*keys, "passage", "start", "src", F.length("first").alias("length"), F.explode(at).alias("step"))
    begin = F.col("src") + F.col("step")
    return found.unionByName(
        placed.select(*keys, "passage", (F.col("start") + F.col("step")).alias("pos"), begin.alias("start"), (begin + F.col("length")).alias("end"))
    )
