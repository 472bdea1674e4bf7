"""Token counts of every prefix of a text, by dynamic programming over prefixes.

A word is encoded from left to right. The encoding of a prefix ends in exactly one
token, and what stands before that token is the encoding of the shorter prefix; two
tokens may follow each other only if merging their joined symbols gives the same two
tokens. One row per prefix therefore holds its last token and its count, and the
longer prefix is found from those rows. Words end in a marked symbol, so each prefix
has two rows: as the inside of a longer word, and as a word that ends there.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import accumulate
from math import inf
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import resident, ship, shipped, small_batches, texts
from .merges import LETTERS, MergeModel

# White space, and the pattern of words, as the tokenizer has them.
SPACE = "\t-\r \x85\xa0  -     　"
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+")

CHUNK = re.compile(f"[^{SPACE}]+[{SPACE}]*")
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))
BLANK = re.compile(f"[{SPACE}]*")
KEPT_CHUNKS = 400_000
KEPT_PREFIXES = 400_000
KEPT_LENGTH = 64
# Prefixes from one stored count to the next.
EVERY = 256
# Bytes of prefixes after which a batch is sent.
SENT_BYTES = 1 << 26


def normalised(text: str) -> str:
    """As the tokenizer normalises text without white space; letters get lower-case one by one."""
    if text.isascii():
        return text.lower()
    return "".join(c.lower() for c in unicodedata.normalize("NFC", text))


@lru_cache(1)
def _joining() -> frozenset[str]:
    """Characters that can melt into the one before them."""
    found = set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))
    for code in range(0x110000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


class _Suffix:
    """Node of a tree of token endings, read from the last symbol backwards."""

    __slots__ = ("longer", "token", "stands", "after")

    def __init__(self):
        self.longer: dict[str, _Suffix] = {}
        self.token: str | None = None
        #: Whether merging its symbols makes the token; found when first needed.
        self.stands: bool | None = None
        #: By the token before it: whether the two can stand side by side.
        self.after: dict[str, bool] = {}


class PrefixCounter:
    """Counts of all prefixes, chunk by chunk; chunks end after white space."""

    def __init__(self, model: MergeModel):
        self.model = model
        self.inside, self.ending = _Suffix(), _Suffix()
        for token in model.vocab:
            marked = bool(model.end) and token.endswith(model.end)
            node = self.ending if marked else self.inside
            for symbol in reversed(token.removesuffix(model.end) if marked else token):
                node = node.longer.setdefault(symbol, _Suffix())
            node.token = token
        if not model.end:
            self.ending = self.inside
        self.edges: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        #: By prefix: count and last token inside a longer word.
        self.rows: dict[str, tuple[int, str]] = {}
        #: By prefix: count as a word that ends there.
        self.ends: dict[str, int] = {}
        #: By word: counts of its prefixes.
        self.words: dict[str, list[int]] = {}
        self.kept: dict[str, bytes] = {}
        self.special = regex.compile("|".join(map(regex.escape, model.special)) or r"(?!)")

    def _edge(self, token: str, right: bool) -> list[tuple[str, float]]:
        """The symbols that form one edge of a token while it grows, each with the rank that ends it."""
        known = self.edges.get((token, right))
        if known is None:
            pair = self.model.halves(token)
            if pair is None:
                known = [(token, inf)]
            else:
                inner = self._edge(pair[right], right)
                known = [*inner[:-1], (pair[right], self.model.ranks[pair]), (token, inf)]
            self.edges[token, right] = known
        return known

    def _side_by_side(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border while both tokens grow; ranks rise as they grow."""
        ranks, before, after = self.model.ranks, self._edge(left, True), self._edge(right, False)
        i = j = 0
        while True:
            (x, ends), (y, closes) = before[i], after[j]
            rank = ranks.get((x, y), inf)
            if rank < ends and rank <= closes and rank != inf:
                return False
            if ends == closes == inf:
                return True
            if ends <= closes:
                i += 1
            else:
                j += 1

    def _last(self, symbols: str, end: int, node: _Suffix, row) -> tuple[int, str]:
        """Count and last token of the prefix of ``end`` symbols, from the rows of shorter ones."""
        at = end
        while at:
            at -= 1
            node = node.longer.get(symbols[at])
            if node is None:
                break
            token = node.token
            if token is None:
                continue
            if node.stands is None:
                node.stands = self.model.merge(self.model.split(token)) == [token]
            if not node.stands:
                continue
            if not at:
                return 1, token
            count, before = row(at)
            fits = node.after.get(before)
            if fits is None:
                fits = node.after[before] = self._side_by_side(before, token)
            if fits:
                return count + 1, token
        raise ValueError("the vocabulary lacks a symbol")

    def _row(self, symbols: str):
        """Access to the rows of a word's inner prefixes, filling in those that lack."""
        if len(symbols) > KEPT_LENGTH:
            # Kept by place: as keys the prefixes of a long word would fill the memory.
            own: list[tuple[int, str]] = [(0, "")]
            for end in range(1, len(symbols)):
                own.append(self._last(symbols, end, self.inside, own.__getitem__))
            return own.__getitem__
        rows = self.rows
        if len(rows) >= KEPT_PREFIXES:
            rows.clear()
            self.ends.clear()
        row = lambda end: rows[symbols[:end]]
        known = len(symbols) - 1
        while known and symbols[:known] not in rows:
            known -= 1
        for end in range(known + 1, len(symbols)):
            rows[symbols[:end]] = self._last(symbols, end, self.inside, row)
        return row

    def _symbols(self, text: str) -> tuple[str, list[int] | range]:
        """Byte symbols of a word, and where its characters end in them."""
        if text.isascii() and text.isprintable():
            return text, range(1, len(text) + 1)
        spelled = ["".join(LETTERS[b] for b in c.encode("utf-8", "surrogatepass")) for c in text]
        return "".join(spelled), [*accumulate(map(len, spelled))]

    def _ends(self, symbols: str, places) -> list[int]:
        """Counts of the prefixes of a word's symbols as words of their own; each is found once."""
        if len(symbols) > KEPT_LENGTH:
            row = self._row(symbols)
            return [self._last(symbols, end, self.ending, row)[0] for end in places]
        known = self.ends
        out = [known.get(symbols[:end]) for end in places]
        if None in out:
            row = self._row(symbols)
            for k, end in enumerate(places):
                if out[k] is None:
                    out[k] = known[symbols[:end]] = self._last(symbols, end, self.ending, row)[0]
        return out

    def word(self, text: str) -> list[int]:
        """Counts of the prefixes of one word, by characters."""
        known = self.words.get(text)
        if known is None:
            known = self._ends(*self._symbols(text))
            if len(text) <= KEPT_LENGTH:
                if len(self.words) >= KEPT_CHUNKS // 2:
                    self.words.clear()
                self.words[text] = known
        return known

    def word_total(self, text: str) -> int:
        symbols, ends = self._symbols(text)
        return self._ends(symbols, ends[-1:])[0]

    def plain(self, text: str) -> list[int]:
        """Counts of the prefixes of normalised text without white space, from the empty one on."""
        counts = [0]
        for found in WORD.finditer(text):
            word, base = found.group(), counts[-1]
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():
                # Its prefixes fall apart into other words.
                for end in range(1, len(word)):
                    counts.append(base + sum(map(self.word_total, WORD.findall(word[:end]))))
                counts.append(base + self.word_total(word))
            else:
                counts += [base + c for c in self.word(word)]
        return counts

    def total(self, text: str) -> int:
        return sum(map(self.word_total, WORD.findall(text)))

    def normal(self, text: str) -> list[int]:
        """Counts of the prefixes of raw text that has neither white space nor special tokens."""
        if text.isascii() and text.isprintable():
            low = text.lower()
            return [0, *self.word(low)] if low.isalpha() else self.plain(low)
        if unicodedata.is_normalized("NFC", text):
            lowered = [c.lower() for c in text]
            low = "".join(lowered)
            counts = [0, *self.word(low)] if low.isalpha() else self.plain(low)
            return counts if len(low) == len(text) else [counts[i] for i in accumulate(map(len, lowered), initial=0)]
        return self._melting(text)

    def _melting(self, text: str) -> list[int]:
        """As ``normal``, where characters join into others: cut before those that cannot."""
        low = normalised
        starts = [i for i, c in enumerate(text) if i == 0 or not (unicodedata.combining(c) or c in _joining())]
        pieces = [low(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)])]
        whole = "".join(pieces)
        counts, words = self.plain(whole), [m.start() for m in WORD.finditer(whole)]
        out, at, w = [0], 0, 0
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)])):
            while w + 1 < len(words) and words[w + 1] < at:
                w += 1
            base = words[w] if at else 0
            for end in range(a + 1, b):
                out.append(counts[base] + self.total(whole[base:at] + low(text[a:end])))
            at += len(pieces[k])
            out.append(counts[at])
        return out

    def _with_special(self, body: str) -> list[int]:
        """Counts of the prefixes of raw text without white space that holds special tokens."""
        counts, base, at = [0], 0, 0
        for found in self.special.finditer(body):
            piece = self.normal(body[at : found.start()])
            counts += [base + c for c in piece[1:]]
            base += piece[-1]
            cut = found.group()
            # Before its last character a special token is still plain text.
            head = body[at : found.start()]
            for end in range(1, len(cut)):
                counts.append(base - piece[-1] + self.normal(head + cut[:end])[-1])
            base += 1
            counts.append(base)
            at = found.end()
        piece = self.normal(body[at:])
        counts += [base + c for c in piece[1:]]
        return counts

    def chunk(self, chunk: str) -> bytes:
        """Steps from one prefix of a chunk to the next, as 32-bit numbers."""
        known = self.kept.get(chunk)
        if known is not None:
            return known
        body = chunk.rstrip(SPACES)
        counts = self._with_special(body) if self.special.search(body) else self.normal(body)
        steps = array("i", map(sub, counts[1:], counts)).tobytes() + bytes(4 * (len(chunk) - len(body)))
        if len(chunk) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_CHUNKS:
                self.kept.clear()
            self.kept[chunk] = steps
        return steps

    def steps(self, text: str) -> bytes:
        """Steps of the count from each prefix of a text to the next."""
        blank, kept, chunk = BLANK.match(text).end(), self.kept.get, self.chunk
        return bytes(4 * blank) + b"".join([kept(c) or chunk(c) for c in CHUNK.findall(text, blank)])

    def count(self, text: str) -> int:
        """Tokens of a text: the last of its prefix counts."""
        return _last_count(self.steps(text))


def _last_count(steps: bytes) -> int:
    return int(np.frombuffer(steps, "<i4").sum())


def _counts(steps: bytes) -> np.ndarray:
    """The counts at every ``EVERY``-th prefix."""
    return np.cumsum(np.frombuffer(steps, "<i4"))[EVERY - 1 :: EVERY]


def _counter(name: str) -> PrefixCounter:
    return resident(("counter", name), lambda: PrefixCounter(MergeModel.load(shipped(name))))


def count_tokens(documents: DataFrame, tokenizer: str, keep_prefixes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` and, if asked for, ``prefixes`` and ``counts`` of every text.

    ``prefixes`` holds for each code point, as little-endian 32-bit numbers, by how
    much it changes the count of the prefix that ends with it, ``counts`` the counts at
    every 256th code point; ``n_tokens`` is the last count. Null and empty texts have no
    tokens and empty ``prefixes`` and ``counts``. Rows that repeat are counted each; other
    columns are not read; an empty table gives an empty result.

    ``tokenizer`` is a local file of the driver. Every executor gets a copy.
    """
    spark = documents.sparkSession
    small_batches(spark)
    name = ship(spark, tokenizer)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())]
        + [("prefixes", pa.binary()), ("counts", pa.list_(pa.int32()))] * keep_prefixes
    )

    def count(batches):
        counter = _counter(name)
        for batch in batches:
            done, totals, kept, held = 0, [], [], 0
            for at, text in enumerate(texts(batch["text"]), 1):
                steps = counter.steps(text)
                totals.append(_last_count(steps))
                if keep_prefixes:
                    kept.append(steps)
                    held += len(steps)
                if at == batch.num_rows or held >= SENT_BYTES:
                    columns = [batch[c].slice(done, at - done) for c in ("doc_id", "n_bytes")]
                    columns.append(pa.array(totals, pa.int64()))
                    if keep_prefixes:
                        columns += [pa.array(kept, pa.binary()), pa.array(map(_counts, kept), pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    done, totals, kept, held = at, [], [], 0

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("text").cast("string").alias("text"),
    )
    kinds = "doc_id long, n_bytes long, n_tokens long" + ", prefixes binary, counts array<int>" * keep_prefixes
    return rows.mapInArrow(count, kinds)


def tokens_before(prefixes: Column, length: Column, counts: Column | None = None) -> Column:
    """Tokens of the first ``length`` code points, read from the stored prefixes.

    With ``counts`` the last stored count before is taken and only the steps after it are read.
    """

    @F.pandas_udf("long")
    def total(steps: pd.Series) -> pd.Series:
        return steps.map(_last_count)

    most = F.least(F.greatest(length.cast("long"), F.lit(0)), F.floor(F.octet_length(prefixes) / 4))
    begin = F.floor(most / EVERY) * EVERY if counts is not None else F.lit(0).cast("long")
    base = F.coalesce(F.get(counts, (most / EVERY).cast("int") - 1), F.lit(0)) if counts is not None else F.lit(0)
    piece = F.substr(prefixes, (4 * begin + 1).cast("int"), (4 * (most - begin)).cast("int"))
    return base.cast("long") + total(piece)


def longest_prefix(prefixes: Column, budget: Column) -> Column:
    """Code points of the longest prefix that has at most ``budget`` tokens."""

    @F.pandas_udf("long")
    def look(steps, budgets):
        def longest(s, most):
            within = np.nonzero(np.cumsum(np.frombuffer(s, "<i4")) <= most)[0]
            return int(within[-1]) + 1 if len(within) else 0

        return steps.combine(budgets, longest)

    return look(prefixes, budget.cast("long"))
