"""Toxicity of texts whose words may be disguised.

A disguised word went through a noisy channel: letters became look-alike signs, were
repeated, or got separators between them. All its readings form a lattice of letters.
The Viterbi search finds the reading of least cost under a character language model,
which is counted over all texts, and the costs of the channel. A classifier then
scores the restored words.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from array import array
from dataclasses import dataclass, field
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, shipped, small_batches, texts

# What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "(": "c", "<": "c",
    "#": "h", "%": "x", "^": "a", "¡": "i", "*": "aeiou", "?": "aeiou",
}
SEPARATORS = frozenset(" .-_*~'`,:/\\|+=")
# Costs in natural-log units: reading a sign as a letter, dropping a sign or a
# separator, one more of a repeated letter, a sign or separator as the end of a word.
SIGN, DROP, JOIN, REPEAT, BREAK = 0.5, 7.0, 0.5, 0.2, 5.0
# Tokens up to this length are kept; longer ones settle what is read after as many signs.
LONGEST = 48
KEPT = 300_000

CLASSES = 64
# The model looks back four letters.
ORDER = 5
SMOOTH = 0.1
# Runs a task holds before it merges equal ones.
HELD_RUNS = 4_000_000
OPENING = "\"'([{«“‘„-_.,;:/<>…"
TRIMMED = "&%#^=~.,;:!?\"'()[]{}«»“”‘’„|…*_-<>/"

# Classifier: labelled rows it is fitted on, words it knows, and its fitting.
SAMPLE = 20_000
FEATURES = 2_000
LEAST_TEXTS = 8
RIDGE = 0.02
STEPS = 400


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """Class of every character: 0 for none, 1 to 26 for a to z, the rest shared by other letters."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if chr(code).isalpha():
            low = chr(code).lower()[0]
            table[code] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (CLASSES - 27)
    return table


def grams(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all three-letter runs in words, and every five-letter run by its number.

    Letters are classes, a repeated letter counts once, the gap between words is class
    0, and nothing before the gap belongs to a run.
    """
    codes = np.frombuffer("\n".join(["", *batch, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = letter_classes()[codes].astype(np.int64)
    kept = np.ones(len(classes), bool)
    kept[1:] = classes[1:] != classes[:-1]
    classes = np.concatenate([np.zeros(ORDER - 1, np.int64), classes[kept]])
    size = len(classes) - ORDER + 1
    context, inside, short = np.zeros(size, np.int64), np.ones(size, bool), None
    for back in range(1, ORDER):
        letter = classes[ORDER - 1 - back : ORDER - 1 - back + size]
        inside &= letter != 0
        context += np.where(inside, letter, 0) * CLASSES ** (back - 1)
        if back == 2:
            short = context.copy()
    last = classes[ORDER - 1 :]
    # The gap at the beginning is no event.
    real = np.nonzero((last != 0) | (context != 0))[0]
    last, context, short = last[real], context[real], short[real]
    return np.bincount(short * CLASSES + last, minlength=CLASSES**3), context * CLASSES + last


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(codes, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def character_model(documents: DataFrame) -> tuple[np.ndarray, str]:
    """Costs of a letter after two others, and a file with counts of letters after four, over all texts.

    The file has the number and the count of every five-letter run there is, so it grows with
    the variety of the texts; executors get a copy and map it into memory. Null and empty
    texts add nothing; without any text all letters cost the same.
    """
    spark = documents.sparkSession
    small_batches(spark)

    def count(batches):
        three, codes, counts = np.zeros(CLASSES**3, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            found, runs = grams(list(texts(batch["text"])))
            three += found
            held.append(runs)
            if sum(map(len, held)) >= HELD_RUNS:
                held.append(codes)
                ones = np.ones(sum(map(len, held[:-1])), np.int64)
                codes, counts = _merged(np.concatenate(held), np.concatenate([ones, counts]))
                held = []
        ones = np.ones(sum(map(len, held)), np.int64)
        codes, counts = _merged(np.concatenate([*held, codes]), np.concatenate([ones, counts]))
        seen = np.nonzero(three)[0]
        for kind, keys, numbers in ((0, seen, three[seen]), (1, codes, counts)):
            for at in range(0, len(keys), 100_000):
                part = slice(at, at + 100_000)
                columns = [pa.array(np.full(len(keys[part]), kind, np.int32)), pa.array(keys[part]), pa.array(numbers[part])]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "code", "n"])

    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "kind int, code long, n long")
    summed = parts.groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow()
    kind, code, n = (summed[c].to_numpy() for c in ("kind", "code", "n"))
    three = np.zeros(CLASSES**3)
    three[code[kind == 0]] = n[kind == 0]
    order = np.argsort(code[kind == 1])
    path = os.path.join(tempfile.mkdtemp(prefix="proseloom-"), f"runs-{uuid.uuid4().hex}.npy")
    np.save(path, np.stack([code[kind == 1][order], n[kind == 1][order]]).astype(np.int64))
    three = three.reshape(CLASSES, CLASSES, CLASSES)
    two = three.sum(0)
    one = two.sum(0)
    back = (one + SMOOTH) / (one.sum() + SMOOTH * CLASSES)
    pairs = (two + 2 * back) / (two.sum(1, keepdims=True) + 2)
    chances = (three + 2 * pairs) / (three.sum(2, keepdims=True) + 2)
    return chances.astype(np.float32), ship(spark, path)


@lru_cache(10_000)
def _options(sign: str) -> list[tuple[str, float]]:
    """Readings of a character with their costs; no letter means that it is dropped."""
    if sign.isalpha():
        return [(sign.lower()[0], 0.0)]
    found = [(letter, SIGN) for letter in LOOKALIKES.get(sign, "")]
    if sign in SEPARATORS:
        return [*found, ("", DROP / 2 if found else JOIN), (" ", BREAK)]
    return [*found, ("", DROP), (" ", BREAK)]


class Restorer:
    """Restores disguised words; readings of tokens are kept.

    In a restored word a letter never follows itself, as repetition may be disguise.
    """

    def __init__(self, model: tuple[np.ndarray, str]):
        self.chances = model[0]
        self.runs, self.counts = np.load(shipped(model[1]), mmap_mode="r")
        self.kept: dict[str, str] = {}
        self.after: dict[str, array] = {}
        self.classes: dict[str, int] = {" ": 0}

    def _class(self, letter: str) -> int:
        known = self.classes.get(letter)
        if known is None:
            known = self.classes[letter] = int(letter_classes()[ord(letter)])
        return known

    def _costs(self, context: str) -> array:
        """Costs of all letter classes after the last four letters of a word."""
        classes, code = [self._class(c) for c in context], 0
        for c in classes:
            code = code * CLASSES + c
        begin, end = np.searchsorted(self.runs, [code * CLASSES, (code + 1) * CLASSES])
        seen = np.zeros(CLASSES, np.float32)
        seen[self.runs[begin:end] - code * CLASSES] = self.counts[begin:end]
        first, second = ([0, 0] + classes)[-2:]
        # Rarer contexts lean more on the shorter one.
        chances = (seen + 2 * self.chances[first, second]) / (seen.sum() + 2)
        if len(self.after) >= KEPT // 8:
            self.after.clear()
        known = self.after[context] = array("f", (-np.log(chances + 1e-9)).astype(np.float32).tobytes())
        return known

    def _cost(self, context: str, letter: str) -> float:
        return (self.after.get(context) or self._costs(context))[self.classes.get(letter) or self._class(letter)]

    def read(self, token: str) -> str:
        """The reading of least cost, in lower-case; it may fall into several words."""
        # State: the last four letters of the word so far. Its value: cost and reading.
        states: dict[str, tuple[float, str]] = {"": (0.0, "")}
        settled: list[str] = []
        for place, sign in enumerate(token, 1):
            after: dict[str, tuple[float, str]] = {}
            options = _options(sign)
            for context, (cost, reading) in states.items():
                for letter, price in options:
                    if not letter or context.endswith(letter):
                        key, value = context, (cost + price + REPEAT * bool(letter), reading)
                    elif letter == " ":
                        key, value = "", (cost + price, reading)
                        if context:
                            value = (value[0] + self._cost(context, " "), reading + " ")
                    else:
                        key = (context + letter)[1 - ORDER :]
                        value = (cost + price + self._cost(context, letter), reading + letter)
                    known = after.get(key)
                    if known is None or value < known:
                        after[key] = value
            states = after
            if place % LONGEST == 0:
                # What all readings begin with stands; it leaves them, so that they stay short.
                start = commonprefix([reading for _, reading in states.values()])
                settled.append(start)
                states = {key: (cost, reading[len(start) :]) for key, (cost, reading) in states.items()}
        ends = ((cost + (self._cost(context, " ") if context else 0.0), reading) for context, (cost, reading) in states.items())
        return ("".join(settled) + min(ends)[1]).strip()

    def token(self, token: str) -> str:
        """The words of a token without white space: itself if nothing is disguised."""
        bare = token.lstrip(OPENING).rstrip(TRIMMED)
        if bare.isalpha() or not any(c.isalpha() for c in token) and not STRONG.search(token):
            # Repetition is the only disguise, or there is none.
            known = DOUBLED.sub(r"\1", bare.lower())
        else:
            known = self.read(token)
        if len(token) <= LONGEST:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[token] = known
        return known

    def words(self, text: str) -> list[str]:
        """The restored tokens of a text; a run of single characters is one token."""
        tokens = text.split()
        if [*map(len, tokens)].count(1) >= 3:
            tokens = self._joined(tokens)
        found = list(map(self.kept.get, tokens))
        if None in found:
            found = [self.token(t) if f is None else f for t, f in zip(tokens, found)]
        return found

    @staticmethod
    def _joined(tokens: list[str]) -> list[str]:
        """Tokens, with runs of three and more single characters joined by spaces."""
        out, i = [], 0
        while i < len(tokens):
            j = i
            while j < len(tokens) and len(tokens[j]) == 1:
                j += 1
            if j - i >= 3:
                out.append(" ".join(tokens[i:j]))
                i = j
            else:
                out.append(tokens[i])
                i += 1
        return out

    def text(self, text: str) -> str:
        return " ".join(word for word in self.words(text) if word)


DOUBLED = re.compile(r"(.)\1+", re.DOTALL)
STRONG = re.compile(r"[@$!|+€£].*[0-9]|[0-9].*[@$!|+€£]")


def restore(documents: DataFrame, model: tuple[np.ndarray, str]) -> DataFrame:
    """``doc_id, restored``: lower-case words of every whole text with disguises undone.

    Null and empty texts give an empty one. Rows that repeat are restored each; an empty table
    gives an empty result; other columns are not read.
    """
    small_batches(documents.sparkSession)

    def run(batches):
        restorer = Restorer(model)
        for batch in batches:
            out = [restorer.text(text) for text in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string())], names=["doc_id", "restored"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, restored string")


@dataclass
class Classifier:
    """Weights of words that a restored text holds or lacks."""

    bias: float = -4.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, words: list[str]) -> float:
        distinct = set(words)
        # A restored token may fall into several words.
        distinct.update(part for w in list(distinct) if " " in w for part in w.split(" "))
        z = self.bias + sum(sorted(self.weights[w] for w in self.weights.keys() & distinct))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def learn(documents: DataFrame, labels: DataFrame, model: tuple[np.ndarray, str], sample: int = SAMPLE) -> Classifier:
    """Fit the classifier on at most ``sample`` labelled documents, drawn by a hash of their ids.

    Of equal restored texts one counts. ``labels`` needs ``doc_id`` and ``toxic``; null labels and labels of absent documents
    are left out; an id with several labels is toxic if one says so. Without labels
    every text scores alike.
    """
    drawn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    drawn = drawn.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("__id"), "toxic")
    chosen = documents.join(F.broadcast(drawn), documents["doc_id"].cast("long") == F.col("__id"))
    restored = restore(chosen, model).join(F.broadcast(drawn), F.col("doc_id") == F.col("__id"))
    restored = restored.select("doc_id", "toxic", F.array_distinct(F.split("restored", " ")).alias("words"))
    one = restored.groupBy(F.xxhash64(F.array_sort("words")).alias("content")).agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"), F.first("words").alias("words"))
    one = cut(one)
    sizes = one.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not sizes["n"] or not sizes["bad"] or sizes["bad"] == sizes["n"]:
        return Classifier()
    n, bad = sizes["n"], sizes["bad"]
    counts = one.select("toxic", F.explode("words").alias("word")).where("word <> ''")
    counts = counts.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).where(F.col("n") >= LEAST_TEXTS)
    # Words that stand in toxic texts more or less often than chance allows.
    expected = F.col("n") * bad / n
    surprise = F.abs(F.col("bad") - expected) / F.sqrt(expected * (1 - bad / n) + 1)
    known = counts.where(surprise > 4).orderBy(F.desc(surprise), "word").limit(FEATURES).select("word").collect()
    place = {row.word: i for i, row in enumerate(known)}
    words = one.sparkSession.createDataFrame([(w,) for w in place] or [("",)], "word string")
    held = one.select("doc_id", F.explode("words").alias("word")).join(F.broadcast(words), "word").select("doc_id", "word").collect()
    targets = {row.doc_id: row.toxic for row in one.select("doc_id", "toxic").collect()}
    index = {doc_id: i for i, doc_id in enumerate(sorted(targets))}
    # The distinct words of a text come once; a row for each pair is bounded by the sample.
    rows = np.array([index[r.doc_id] for r in held], np.int64)
    columns = np.array([place[r.word] for r in held], np.int64)
    y = np.array([targets[d] for d in sorted(targets)], float)
    weights, bias = np.zeros(len(place)), float(np.log(bad / (n - bad)))
    # Gradient steps scaled by how often a word was seen.
    seen_w, seen_b = np.full(len(place), 1e-8), 1e-8
    for _ in range(STEPS):
        z = bias + np.bincount(rows, weights[columns], minlength=len(y)) if len(rows) else np.full(len(y), bias)
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        slope = np.bincount(columns, error[rows], minlength=len(place)) / len(y) + RIDGE * weights / len(y) if len(rows) else np.zeros(len(place))
        seen_w += slope**2
        seen_b += error.mean() ** 2
        weights -= 0.5 * slope / np.sqrt(seen_w)
        bias -= 0.5 * error.mean() / np.sqrt(seen_b)
    return Classifier(float(bias), {w: float(weights[i]) for w, i in place.items()})


def score(documents: DataFrame, model: tuple[np.ndarray, str], classifier: Classifier, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns and ``name`` (0 to 1, higher: likelier toxic) of every whole text.

    Null and empty texts get the score of a text without known words. Rows that repeat
    are scored each; an empty table gives an empty result. ``name`` must not be one of ``keep``.
    """
    small_batches(documents.sparkSession)
    kept = keep or ["doc_id"]
    # The text travels once if it is among the columns that stay.
    source = "text" if "text" in kept else "__text"
    rows = documents.select(*kept, *[F.col("text").cast("string").alias(source)] * (source not in kept))

    def run(batches):
        restorer = Restorer(model)
        for batch in batches:
            out = [classifier.score(restorer.words(text)) for text in texts(batch[source])]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in kept), pa.array(out, pa.float64())], names=[*kept, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{name}` double")
