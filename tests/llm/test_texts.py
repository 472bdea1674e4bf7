"""Toxicity, language and chunk fingerprints."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseloom.llm import chunks, language, toxicity

TOXIC = ["idiot", "stupid", "worthless", "trash"]
PLAIN = "the house near river under a bright morning sky with trees and quiet people walking along slow water".split()


def corpus(count=600, seed=7):
    draw = random.Random(seed)
    rows = []
    for i in range(count):
        words = [draw.choice(PLAIN) for _ in range(draw.randint(20, 60))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(draw.randrange(len(words)), draw.choice(TOXIC))
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def taught(ready):
    table = ready.createDataFrame(corpus(), "doc_id long, text string, toxic int")
    model = toxicity.character_model(table)
    return model, toxicity.learn(table, table.select("doc_id", "toxic"), model)


@pytest.mark.parametrize(
    "disguised, word",
    [("1d10t", "idiot"), ("$tup!d", "stupid"), ("w0rthl3ss", "worthless"), ("i d i o t", "idiot"), ("t.r.a.s.h", "trash"),
     ("stuuuupid", "stupid"), ("id*ot", "idiot"), ("tr@sh!!", "trash"), ("s t u p 1 d", "stupid"), ("iii-ddd-i-o-t", "idiot")],
)
def test_disguises_are_undone(taught, disguised, word):
    bare = toxicity.DOUBLED.sub(r"\1", word)
    assert bare in " ".join(toxicity.Restorer(taught[0]).words(f"the {disguised} near")).split()


def test_long_disguises_are_read_as_one(taught, monkeypatch):
    restorer = toxicity.Restorer(taught[0])
    for mark in " .":
        for before in range(1, 12):
            token = mark.join("".join(["water"] * before) + "idiot" + "water" * 3)
            found = " ".join(restorer.words(token))
            assert "idiot" in found.replace(" ", ""), (mark, before)
            # Where the reading is settled does not change it.
            with monkeypatch.context() as patch:
                patch.setattr(toxicity, "LONGEST", 10**9)
                assert found == restorer.read(token)
                assert len(restorer.words(token)) == 1
    gap = "w.a.t.e.r." * 4 + "n.e.a.r - r.i.v.e.r"
    assert restorer.words(gap.replace(" ", "")) == [restorer.read(gap.replace(" ", ""))]


def test_reading_is_the_cheapest_of_all(taught):
    """The search against all readings of short tokens."""
    restorer = toxicity.Restorer(taught[0])

    def cheapest(token):
        best = []

        def go(at, context, cost, reading):
            if at == len(token):
                best.append((cost + (restorer._cost(context, " ") if context else 0.0), reading))
                return
            for letter, price in toxicity._options(token[at]):
                if not letter or context.endswith(letter):
                    go(at + 1, context, cost + price + toxicity.REPEAT * bool(letter), reading)
                elif letter == " ":
                    more = restorer._cost(context, " ") if context else 0.0
                    go(at + 1, "", cost + price + more, reading + " " * bool(context))
                else:
                    key = (context + letter)[1 - toxicity.ORDER :]
                    go(at + 1, key, cost + price + restorer._cost(context, letter), reading + letter)

        go(0, "", 0.0, "")
        return min(best)

    draw = random.Random(3)
    for _ in range(150):
        token = "".join(draw.choice("idot10!$.* as") for _ in range(draw.randint(1, 6)))
        assert restorer.read(token) == cheapest(token)[1].strip(), token


def test_held_out_texts_are_told_apart(ready, taught):
    table = ready.createDataFrame(corpus(200, 8), "doc_id long, text string, toxic int")
    rows = toxicity.score(table, *taught, ["doc_id", "toxic"]).collect()
    assert all((r.score >= 0.3) == bool(r.toxic) for r in rows)
    hidden = [(r.doc_id, "the quiet 1d10t and w.o.r.t.h.l.e.s.s people") for r in rows[:5]]
    assert all(r.score >= 0.3 for r in toxicity.score(ready.createDataFrame(hidden, "doc_id long, text string"), *taught).collect())


def test_toxicity_of_odd_rows(odd, nothing, ready, taught):
    rows = toxicity.score(odd, *taught).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert {r.doc_id: r.restored for r in toxicity.restore(odd, taught[0]).collect()}[3] == ""
    assert toxicity.score(nothing, *taught).collect() == []
    empty = toxicity.character_model(nothing)
    labels = ready.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    alike = toxicity.learn(odd, labels, empty)
    assert len({r.score for r in toxicity.score(odd, empty, alike).collect()}) == 1


def test_bundles_by_definition():
    texts = ["The the", "", "1 2", "Ab ba-c", "漢字 é"]
    found = language.bundles(texts)
    for text, vector in zip(texts, found):
        letters = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
        letters = [c for i, c in enumerate(letters) if c or i == 0 or letters[i - 1]]
        want = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            if b:
                v = [language._letter_vector(x).astype(float) for x in (a, b, c)]
                want += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        assert np.array_equal(vector, want)


def test_many_letters_take_the_other_table(monkeypatch):
    texts = ["abc def", "the quick brown fox"]
    plain = language.bundles(texts)
    monkeypatch.setattr(language, "MOST_CODES", 1)
    assert np.array_equal(language.bundles(texts), plain)


def test_languages_are_told_apart(ready, odd, nothing):
    words = {"en": "the and of house with that this there water".split(), "de": "der und die haus mit dass dieses wasser nicht".split()}
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice(words[k]) for _ in range(15)), k) for i in range(100) for k in [("en", "de")[i % 2]]]
    table = ready.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.profiles(table.where("doc_id < 60"))
    found = language.identify(table.where("doc_id >= 60"), learned).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and 0 < r.score <= 1 for r in found)
    judged = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, learned).collect()}
    assert judged[3] == judged[4] == judged[5] == judged[9] == ("und", 0.0)
    assert language.profiles(nothing) == {}
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    with pytest.raises(ValueError):
        language.profiles(table, 1)


def test_chunks_cover_the_text_and_survive_shifts():
    draw = random.Random(2)
    text = "".join(draw.choice("abcdefgh ") for _ in range(6000)).encode()
    one, shifted, other = chunks.fingerprints_of([text, b"12345 " + text, text[::-1]])
    assert (one & np.uint64(255)).sum() == len(text)
    assert chunks.contained(one, shifted) > 0.95 and chunks.contained(one, other) < 0.05
    assert all(np.array_equal(chunks.read(chunks.written(x)), x) for x in (one, shifted, other))
    # Neighbours in a batch do not matter.
    assert np.array_equal(chunks.fingerprints_of([other.tobytes(), text])[1], one)
    sizes = (one & np.uint64(255)).astype(int)
    assert sizes.max() <= chunks.MOST and (sizes < chunks.LEAST).sum() <= 1


def edited(texts):
    out = []
    for text, following in zip(texts, [*texts[1:], *texts[:1]]):
        quarter = len(text) // 4
        out.append(text[: len(text) - quarter] + following[:quarter])
    return out


@pytest.mark.parametrize("count", [1, 2, 700])
def test_edited_texts_follow_the_order_of_ids(ready, count):
    draw = random.Random(count)
    ids = sorted(draw.sample(range(-(10**12), 10**12), count))
    texts = [" ".join(draw.choice(PLAIN) for _ in range(draw.randint(0, 90))) for _ in ids]
    table = ready.createDataFrame(draw.sample([*zip(ids, texts)], count), "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in chunks.compare_with_next(table).collect()}
    assert len(rows) == count
    for i, text, change, following in zip(ids, texts, edited(texts), [*texts[1:], *texts[:1]]):
        row = rows[i]
        prints = [chunks.fingerprints_of([t.encode()])[0] for t in (text, change, following)]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(change.encode()).hexdigest()
        assert row.fingerprint == chunks.written(prints[0]) and row.edited_fingerprint == chunks.written(prints[1])
        assert row.near_edited == chunks.contained(*prints[:2]) and row.near_next == chunks.contained(prints[0], prints[2])


def test_chunks_of_odd_rows(odd, nothing):
    rows = chunks.compare_with_next(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.fingerprint for r in chunks.fingerprint(odd).collect()}[3] == ""
    # The two rows of one id are neighbours of equal text.
    assert sorted(r.near_next for r in rows if r.doc_id == 2)[-1] == 1.0
    assert chunks.compare_with_next(nothing).collect() == []
    both = chunks.fingerprint(odd).select(chunks.containment(F.col("fingerprint"), F.col("fingerprint")).alias("x"))
    assert {r.x for r in both.collect()} == {1.0}
