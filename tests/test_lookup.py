"""Passages in books, rules in lines and the streamed state against plain loops."""

import random
import re
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from proseloom.operators import lexicon as L
from proseloom.operators import ranges as RG
from proseloom.operators import staging as S
from proseloom.session import ship_package
from proseloom.streaming import qc as SQ


def located(source, texts, exact, fallback):
    """The search pointer over the whole text."""
    found = [(m.group(), m.start()) for m in re.finditer(r"\S+", source)]
    origin = {}
    hay, at = source, 0
    if not exact:
        hay = " ".join(w for w, _ in found)
        for word, start in found:
            origin.update({at + k: start + k for k in range(len(word))})
            at += len(word) + 1
    pointer, out = 0, []
    for text in texts:
        needle = (text or "").strip() if exact else " ".join((text or "").split())
        at = hay.find(needle, pointer) if needle else -1
        if at >= 0:
            pointer = at + len(needle)
        elif needle and fallback:
            at = hay.find(needle)
        stop = at + len(needle)
        if at < 0:
            out.append((-1, -1))
        else:
            out.append((at, stop) if exact else (origin[at], origin[stop - 1] + 1))
    return out


def books(seed, count):
    """Books of few words, so that passages stand at many places, and pieces of them in any order."""
    draw = random.Random(seed)
    words = ["a", "an", "no.", "the", "bananas", "yes", "é", "ananas", "No", "thethe", '"go"', "x-y"]
    for doc in range(count):
        source = "".join(draw.choice(words) + draw.choice([" ", "  ", "\n", " \t\n", " "]) for _ in range(draw.randint(0, 120)))
        segments = []
        for k in range(draw.randint(1, 40)):
            a = draw.randint(0, max(0, len(source) - 1))
            piece = source[a : a + draw.choice([1, 2, 3, 5, 9, 14, 30, 60])]
            piece = draw.choice([piece, re.sub(r"\s+", " ", piece), piece.replace(" ", "\n ")])
            segments.append(draw.choice([piece] * 8 + ["absent", "", None, " "]))
        # Most of them in order, as pieces of a book are.
        if doc % 2:
            segments = [m for m in re.findall(r"\S+(?:\s+\S+){0,3}", source)] or [""]
        yield doc, source, segments


@pytest.mark.parametrize("exact, fallback, block_rows", [(False, True, 4096), (False, False, 3), (True, False, 4096), (True, True, 2)])
def test_passages_equal_the_search_pointer(spark, exact, fallback, block_rows):
    ship_package(spark)
    given = list(books(block_rows, 24))
    rows = [(d, k, t) for d, _, texts in given for k, t in enumerate(texts)]
    segments = spark.createDataFrame(rows, "doc_id bigint, seg_idx int, text string")
    texts = spark.createDataFrame([(d, s) for d, s, _ in given] + [(99, None)], "doc_id bigint, text string")
    found = RG.locate_in_source(segments, texts, exact=exact, fallback=fallback, block_rows=block_rows)
    got = {(r.doc_id, r.seg_idx): (r.start, r.end) for r in found.collect()}
    assert len(got) == len(rows)
    for doc, source, own in given:
        want = located(source, own, exact, fallback)
        assert [got[doc, k] for k in range(len(own))] == want


@pytest.mark.parametrize("long_chars, exact, fallback", [(1 << 16, True, False), (60, True, False), (1 << 16, False, True), (60, False, True)])
def test_spans_of_short_and_long_passages(spark, long_chars, exact, fallback):
    ship_package(spark)
    given = list(books(7, 24))
    rows = [(d, m, k, t, f"{m}{k}") for d, _, texts in given for m in ("x", "y") for k, t in enumerate(texts[:: -1 if m == "y" else 1])]
    segments = spark.createDataFrame(rows, "doc_id bigint, method string, seg_idx int, text string, mark string")
    texts = spark.createDataFrame([(d, s) for d, s, _ in given] + [(99, None)], "doc_id bigint, text string")
    found = RG.locate_in_passages(segments, texts, ("doc_id", "method"), ("doc_id",), exact=exact, fallback=fallback, long_chars=long_chars)
    got = {(r.doc_id, r.method, r.seg_idx): (r.start, r.end, r.mark) for r in found.collect()}
    assert len(got) == len(rows)
    for doc, source, own in given:
        for m, listed in (("x", own), ("y", own[::-1])):
            want = located(source, listed, exact, fallback)
            assert [got[doc, m, k] for k in range(len(own))] == [(*place, f"{m}{k}") for k, place in enumerate(want)]


def test_passages_of_absent_books_and_empty_tables(spark):
    segments = spark.createDataFrame([(1, 0, "gone"), (2, 0, "here"), (3, 0, "")], "doc_id bigint, seg_idx int, text string")
    texts = spark.createDataFrame([(2, "it is here"), (3, "nothing")], "doc_id bigint, text string")
    found = {r.doc_id: (r.start, r.end) for r in RG.locate_in_source(segments, texts).collect()}
    assert found == {1: (-1, -1), 2: (6, 10), 3: (-1, -1)}
    assert RG.locate_in_source(segments.where("false"), texts).collect() == []


RULES = "doc_id bigint, target_word string, replacement string, type string, case_sensitive boolean, notes string"
LINE_RULES = "doc_id bigint, seg_idx int, target_word string, replacement string, type string, case_sensitive boolean, notes string"


def spoken(text, rules):
    """Every rule in turn on the whole line."""
    applied = []
    for word, replacement, exact in rules:
        pattern = re.escape(word)
        if re.match("[A-Za-z0-9_]", word):
            pattern = "(?<![A-Za-z0-9_])" + pattern
        if re.search("[A-Za-z0-9_]$", word):
            pattern += "(?![A-Za-z0-9_])"
        text, count = re.subn(pattern, lambda _: replacement, text, flags=0 if exact else re.I | re.A)
        if count:
            applied.append((word, count))
    return text, applied


def test_rules_meet_the_words_that_replacements_bring(spark):
    draw = random.Random(4)
    words = ["Dr.", "Smith", "DrSmith", "st", "St. John", "—", "…x", "don't", "O'Neil", "two words", "é", "B", "café au", "x_1"]
    lines = [(1, k, draw.choice(["", " "]).join(draw.choice(words + ["and", "DR.", "smith"]) for _ in range(draw.randint(1, 9)))) for k in range(60)]
    lines += [(2, 0, "Smith and B"), (1, 900, None), (1, 901, "")]
    book = [(w, draw.choice(words + ["done", "a $1 b"]), draw.random() < 0.5) for w in words]
    own = {k: [(draw.choice(["Dr.", "and", "B"]), draw.choice(["Doctor", "Dr", "st", "two"]), False)] for k in range(0, 60, 4)}
    lexicon = spark.createDataFrame([(1, w, r, "respelling", c, "") for w, r, c in book], RULES)
    rules = spark.createDataFrame([(1, k, w, r, "phoneme", c, "") for k, rs in own.items() for w, r, c in rs], LINE_RULES)
    segments = spark.createDataFrame(lines, "doc_id bigint, seg_idx int, text string")
    found = {(r.doc_id, r.seg_idx): (r.text, [(a.target_word, a.occurrences) for a in r.applied]) for r in L.apply_lexicon(segments, lexicon, rules).collect()}
    ordered = sorted(book, key=lambda r: (-len(r[0]), r[0]))
    for doc, k, text in lines:
        want = spoken(text or "", own.get(k, []) + ordered if doc == 1 else [])
        assert found[doc, k] == want


def test_lines_meet_few_of_ten_thousand_rules(spark):
    lexicon = spark.range(10_000).selectExpr(
        "id % 2 AS doc_id", "concat('word', id) AS target_word", "concat('said', id) AS replacement",
        "'respelling' AS type", "false AS case_sensitive", "'' AS notes",
    )
    segments = spark.range(4_000).selectExpr(
        "id % 2 AS doc_id", "CAST(id AS INT) AS seg_idx", "concat('the word', id, ' and WORD', id + 2, ', word', id + 1, '.') AS text"
    )
    start = time.perf_counter()
    rows = L.apply_lexicon(segments, lexicon).collect()
    assert time.perf_counter() - start < 60
    for r in rows:
        n = r.seg_idx
        assert r.text == f"the said{n} and said{n + 2}, word{n + 1}."
        assert len(r.applied) == 2


EVENTS = "doc_id bigint, char_id string, line_idx bigint, trigger_strength double, baseline double, lines_since int"


def test_stream_state_survives_restarts_drops_late_rows_and_expires(spark, tmp_path):
    ship_package(spark)

    def run(rows, label, idle):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{label}/in")
        stream = SQ.emotion_arc_stream(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/{label}/in"), idle)
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/{label}/state")
        writer.format("parquet").option("path", f"{tmp_path}/{label}/out").trigger(availableNow=True)
        with SQ.stateful(spark):
            assert writer.start().awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/{label}/out")

    first = [(1, "a", 3, 0.5, 0.2, 1), (1, "a", 1, 0.3, 0.2, 1), (1, "b", 2, 0.9, None, None)]
    second = [(1, "a", 9, 0.1, 0.2, 2), (1, "a", 2, 0.4, 0.2, 1), (1, "a", 3, 0.5, 0.2, 1)]
    run(first, "kept", timedelta(days=1))
    rows = run(second, "kept", timedelta(days=1))
    level, want = S.START, {}
    for line, trigger, lines in ((1, 0.3, 1), (3, 0.5, 1), (9, 0.1, 2)):
        level = S.step_intensity(level, 0.2, trigger, lines)
        want[line] = level
    kept = {r.line_idx: r.intensity for r in rows.where("char_id = 'a' AND NOT is_dropped").collect()}
    assert kept == want
    assert {(r.char_id, r["kept"], r.dropped) for r in SQ.dropped_rows(rows).collect()} == {("a", 3, 2), ("b", 1, 0)}
    run(first, "gone", timedelta(milliseconds=1))
    time.sleep(0.2)
    rows = run(second, "gone", timedelta(milliseconds=1))
    # The state had expired: the rows after the restart begin anew, none is late.
    begun = {r.line_idx: r.intensity for r in rows.where("char_id = 'a' AND line_idx IN (2, 9)").collect()}
    assert begun[2] == S.step_intensity(S.START, 0.2, 0.4, 1) and rows.where("is_dropped").count() == 0


def test_arc_state_is_asked_once_a_batch():
    import pandas as pd

    class Held:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    def batch(*rows):
        return pd.DataFrame(rows, columns=["line_idx", "baseline", "trigger", "lines"])

    state, want = SQ.ArcState(1000), SQ.START
    state.arc = Held()
    frames = [batch((5, 0.2, 0.3, 1), (1, 0.55, 0.9, 2)), batch((3, 0.2, -0.2, 3))]
    first = pd.concat(state.handleInputRows((1, "u1"), iter(frames), None))
    assert first["line_idx"].tolist() == [1, 3, 5] and not first["is_dropped"].any() and state.arc.calls == 2
    for level, step in zip(first["intensity"], [(0.55, 0.9, 2), (0.2, -0.2, 3), (0.2, 0.3, 1)], strict=True):
        want = SQ.step_intensity(want, *step)
        assert level == want
    again = pd.concat(state.handleInputRows((1, "u1"), iter([batch((5, 0.2, 0.3, 1), (6, 0.2, 0.0, 0 + 1))]), None))
    assert again["is_dropped"].tolist() == [True, False] and again["intensity"].isna().tolist() == [True, False]
    assert again["intensity"].iloc[1] == SQ.step_intensity(want, 0.2, 0.0, 1) and state.arc.value[1] == 6 and state.arc.calls == 4
