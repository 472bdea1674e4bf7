"""Byte-level BPE: encoding through a lexicon of frequent words, and decoding."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, resident, ship, shipped, small_batches, texts
from .lexicon import Lexicon, compile_lexicon
from .merges import MergeModel

# Fixed value: the pattern that cuts a text into words, as the tokenizer has it.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# The same for the standard library, which is faster but has other classes beyond ASCII,
# and takes four more characters for white space.
QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
ODD_SPACE = re.compile("[\x1c-\x1f]")

LEXICON_WORDS = 50_000
LONGEST_WORD = 64
COUNTED_AT_ONCE = 200_000
KEPT_WORDS = 400_000


def _cut(text: str) -> list[str]:
    return QUICK.findall(text) if text.isascii() and ODD_SPACE.search(text) is None else WORD.findall(text)


def _pieces(text: str, special: regex.Pattern) -> list[str]:
    """Text and special tokens in turn: text, token, text, …, text."""
    out, at = [], 0
    for found in special.finditer(text):
        out += [text[at : found.start()], found.group()]
        at = found.end()
    return [*out, text[at:]]


def _words(text: str, special: regex.Pattern) -> list[str]:
    """The words and special tokens of a text."""
    if special.search(text) is None:
        return _cut(text)
    return [w for i, piece in enumerate(_pieces(text, special)) for w in ([piece] if i % 2 else _cut(piece))]


def _special(model: MergeModel) -> regex.Pattern:
    return regex.compile("|".join(map(regex.escape, model.special)) or r"(?!)")


def word_counts(documents: DataFrame, special: str) -> DataFrame:
    """How often each word of at most 64 characters stands in all texts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        counts = Counter()
        marks = regex.compile(special)
        for batch in batches:
            for text in texts(batch["text"]):
                counts.update(_words(text, marks))
            if len(counts) > COUNTED_AT_ONCE:
                yield partial(counts)
                counts = Counter()
        yield partial(counts)

    def partial(counts):
        kept = {w: n for w, n in counts.items() if len(w) <= LONGEST_WORD}
        return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], schema=schema)

    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> str:
    """Compile up to ``words`` of the most frequent words of all texts; returns the name of the shipped file.

    The lexicon speeds encoding up; what it lacks is merged, so ids do not depend on
    it. Null and empty texts and an empty table add no words.
    """
    spark = documents.sparkSession
    small_batches(spark)
    model = MergeModel.load(tokenizer)
    counts = cut(word_counts(documents, _special(model).pattern).where("n > 1"))
    # Words by the size of their counts, in steps of an eighth of a doubling, as far as all of a step fit.
    level = F.floor(8 * F.log2("n"))
    held, least = 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        held += row.words
        if held > words:
            break
        least = row.level
    frequent = counts.where(level >= least).select("word").collect() if least is not None else []
    encoded = sorted(row.word.encode() for row in frequent if row.word not in model.special)
    content = compile_lexicon((word, model.ids(word)) for word in encoded)
    # One name and place for one content, as a file may be sent once only.
    path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(content).hexdigest()[:32]}.bin")
    with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as file:
        file.write(content)
    os.replace(file.name, path)
    return ship(spark, path)


class Encoder:
    """Ids of whole texts: words from the lexicon, all others by exact merging."""

    def __init__(self, model: MergeModel, lexicon: Lexicon):
        self.model, self.lexicon = model, lexicon
        self.special = _special(model)
        self.kept: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Find the ids of words that are not kept yet."""
        if len(self.kept) + len(words) > KEPT_WORDS:
            self.kept.clear()
        new = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for word, spelled, ids in zip(new, raw, self.lexicon.find(raw)):
            own = self.model.special.get(word)
            if own is not None:
                ids = array("i", [own]).tobytes()
            elif ids is None:
                ids = array("i", self.model.ids(spelled)).tobytes()
            self.kept[word] = ids

    def texts(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        words = [_words(text, self.special) for text in batch]
        found = [list(map(self.kept.get, own)) for own in words]
        lacking = [i for i, ids in enumerate(found) if None in ids]
        missing = {w for i in lacking for w, ids in zip(words[i], found[i]) if ids is None}
        if missing:
            self.learn(missing)
            for i in lacking:
                found[i] = [self.kept[w] if ids is None else ids for w, ids in zip(words[i], found[i])]
        out = list(map(b"".join, found))
        # Very long words are not worth keeping.
        for word in missing:
            if len(word) > LONGEST_WORD:
                del self.kept[word]
        return out


def _encoder(tokenizer: str, lexicon: str) -> Encoder:
    return resident(("encoder", tokenizer, lexicon), lambda: Encoder(MergeModel.load(shipped(tokenizer)), Lexicon(shipped(lexicon))))


@lru_cache(1)
def _spellings(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens after each other, and where each id begins."""
    found = MergeModel.load(shipped(tokenizer)).token_bytes()
    spelled = [found.get(i, b"") for i in range(max(found) + 1)]
    starts = np.cumsum([0, *map(len, spelled)])
    return np.frombuffer(b"".join(spelled), np.uint8), starts


def _spelled(ids: np.ndarray, per: np.ndarray, tokenizer: str) -> list[str]:
    """The texts that runs of ``per`` ids spell."""
    data, starts = _spellings(tokenizer)
    lengths = starts[ids + 1] - starts[ids]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    places = np.repeat(starts[ids] - (ends - lengths), lengths)
    places += np.arange(total)
    raw = data[places].tobytes()
    marks = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(marks[:-1], marks[1:])]


def encode(documents: DataFrame, tokenizer: str, lexicon: str, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` of every whole text and, if asked for, ``text``: the ids decoded again.

    ``tokenizer`` is a local file of the driver, ``lexicon`` the name that
    ``build_lexicon`` gave. Null and empty texts have no ids. Rows that repeat are
    encoded each; other columns are not read; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    small_batches(spark)
    name = ship(spark, tokenizer)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("text", pa.string())] * decoded)

    def run(batches):
        encoder = _encoder(name, lexicon)
        for batch in batches:
            packed = encoder.texts(list(texts(batch["text"])))
            per = np.array([len(p) // 4 for p in packed], np.int64)
            ids = np.frombuffer(b"".join(packed), np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
            columns = [batch["doc_id"], pa.ListArray.from_arrays(ends, pa.array(ids))]
            if decoded:
                columns.append(pa.array(_spelled(ids, per, name), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids, text``: the text that the ids spell, special tokens included.

    Bytes that are no UTF-8 become replacement characters. Null ids give null text,
    no ids an empty one.
    """
    small_batches(encoded.sparkSession)
    name = ship(encoded.sparkSession, tokenizer)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            lists = batch["ids"]
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            per = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            out = _spelled(ids, per, name)
            spelled = pc.if_else(lists.is_null(), None, pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, spelled], schema=schema)

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")
