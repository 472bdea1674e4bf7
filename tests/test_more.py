"""Golden cases and brute-force checks of the other operators."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from proseloom.operators import calibration as K
from proseloom.operators import cast as C
from proseloom.operators import lexicon as L
from proseloom.operators import qc as Q
from proseloom.operators import relations as R
from proseloom.operators import screenplay as S
from proseloom.operators import staging as G
from proseloom.operators import timeline as TL


def test_emotion_arc_equals_the_loop(spark):
    rnd = random.Random(5)
    events = [
        (1, f"u{rnd.choice([0, 0, 0, 1])}", i, round(rnd.uniform(-0.7, 0.7), 2), rnd.choice([0.2, 0.55]), rnd.randint(0, 3))
        for i in range(300)
    ]
    df = spark.createDataFrame(
        events, "doc_id bigint, char_id string, line_idx bigint, trigger_strength double, baseline double, lines_since int"
    )
    want, level = {}, {}
    for _, who, i, trig, base, lines in events:
        n, prev = max(1, lines or 1), level.get(who, 0.2)
        raw = base + (prev - base) * (1 - 0.15) ** n + trig
        if abs(trig) < 0.4:
            raw = min(max(raw, prev - 0.3 * n), prev + 0.3 * n)
        level[who] = math.floor(min(max(raw, 0), 1) * 1000 + 0.5) / 1000
        want[(who, i)] = level[who]
    for rows in (1 << 18, 16):
        got = G.emotion_arc(df, block_rows=rows).collect()
        assert {(r.char_id, r.line_idx): r.intensity for r in got} == want
    assert G.step_intensity(0.9, 0.2, 0.0, 1) == 0.795


def test_emotion_arc_cuts_by_rows_not_by_numbers(spark, monkeypatch):
    # Lines far apart: no timeline is long, so no state tables are made.
    def lines(gap):
        rows = [(1, f"u{i % 3}", i * gap, (i * 7 % 13) / 13 - 0.4, 0.2, i % 4) for i in range(90)]
        return spark.createDataFrame(rows, "doc_id bigint, char_id string, line_idx bigint, trigger_strength double, baseline double, lines_since int")

    want = {(r.char_id, r.line_idx): r.intensity for r in G.emotion_arc(lines(1)).collect()}
    monkeypatch.setattr(G.ordered, "renumber", lambda *_: pytest.fail("a short timeline was cut"))
    far = G.emotion_arc(lines(1 << 18))
    assert {(r.char_id, r.line_idx >> 18): r.intensity for r in far.collect()} == want
    assert "FlatMapGroupsInPandas" not in far._jdf.queryExecution().toString()


def test_wer_and_differences(spark):
    pairs = [
        ("the path was dark", "the path dark"),
        ("Don't — stop, Zoë!", "don't stop zoe"),
        ("", ""),
        ("a b c d e", "a x c d e f"),
        ("same words", "same words"),
    ]
    segs = spark.createDataFrame([(1, f"s{i}", "x", a) for i, (a, _) in enumerate(pairs)], "doc_id bigint, seg_id string, speaker string, text string")
    heard = spark.createDataFrame([(1, f"s{i}", b) for i, (_, b) in enumerate(pairs)], "doc_id bigint, seg_id string, transcribed_text string")
    rows = {r.seg_id: r for r in Q.transcript_wer(segs, heard).collect()}
    assert rows["s0"].wer == 0.25 and rows["s0"].missing_words == ["was"]
    assert rows["s2"].wer == 0.0 and rows["s4"].match_pct == 100.0 and rows["s4"].status == "passed"
    assert rows["s3"].word_errors == 2 and rows["s3"].extra_words == ["x", "f"]
    ratio = difflib.SequenceMatcher(None, "the path was dark", "the path dark").ratio()
    assert rows["s0"].match_pct == round(ratio * 100, 1)
    total = Q.corpus_wer(Q.transcript_wer(segs, heard), "doc_id").first()
    assert total.lines == 5 and total.errors == sum(r.word_errors for r in rows.values())


def test_wer_reads_each_line_once(spark):
    rnd = random.Random(8)
    said = [" ".join(rnd.choice(["a", "b", "cc", "dd'd", "é"]) for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    told = [" ".join(w for w in s.split() if rnd.random() < 0.8) + rnd.choice(["", " b", " new words"]) for s in said]
    segs = spark.createDataFrame([(1, f"s{i}", "x", s) for i, s in enumerate(said)], "doc_id bigint, seg_id string, speaker string, text string")
    heard = spark.createDataFrame([(1, f"s{i}", s) for i, s in enumerate(told)], "doc_id bigint, seg_id string, transcribed_text string")
    scored = Q.transcript_wer(segs, heard)
    # No word is looked up in a list that is made anew for it.
    assert "array_position" not in scored._jdf.queryExecution().toString()
    for r in scored.collect():
        a, b = Q._normalise(said[int(r.seg_id[1:])]).split(), Q._normalise(told[int(r.seg_id[1:])]).split()
        row = list(range(len(b) + 1))
        for i, w in enumerate(a, 1):
            last, row[0] = row[:], i
            for j, v in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (w != v))
        assert (r.expected_words, r.word_errors) == (len(a), row[-1] if a else 0)
        assert r.wer == (min(1.0, row[-1] / len(a)) if a else float(bool(b)))


def test_fit_finds_the_minimum(spark):
    rnd = random.Random(11)
    rows = []
    for kind, t in (("a", 2.5), ("b", 0.6)):
        for i in range(400):
            p = rnd.uniform(0.02, 0.98)
            z = math.log(p / (1 - p))
            rows.append((kind, i, p, int(rnd.random() < 1 / (1 + math.exp(-z / t)))))
    df = spark.createDataFrame(rows, "question_type string, idx bigint, p double, y int")
    for r in K.fit_temperature(df).collect():
        mine = [(math.log(p / (1 - p)), y) for k, _, p, y in rows if k == r.question_type]

        def loss(t, mine=mine):
            return -sum(math.log(1 / (1 + math.exp(-z / t)) if y else 1 - 1 / (1 + math.exp(-z / t))) for z, y in mine)

        best = loss(r.fitted_temperature)
        assert all(best <= loss(r.fitted_temperature + d) + 1e-9 for d in (-0.01, -0.002, 0.002, 0.01))
        assert not r.boundary_pegged and not r.is_provisional


def test_thresholds_with_a_shared_probability(spark):
    rnd = random.Random(2)
    rows = [("a", i, rnd.choice([0.97, 0.9, 0.9, 0.9, 0.3]), 0) for i in range(200)]
    rows = [(k, i, p, int(rnd.random() < (0.99 if p >= 0.9 else 0.2))) for k, i, p, _ in rows]
    df = spark.createDataFrame(rows, "question_type string, idx bigint, p double, y int")
    best, right = 0.90, 0
    for n, (_, _, p, y) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])), 1):
        right += y
        if right / n >= 0.95:
            best = p
        elif n >= 5:
            break
    want = (round(max(0.70, min(0.98, best)), 2), round(max(0.40, min(0.60, best - 0.35)), 2))
    for hot in (100_000, 7):
        r = K.derive_thresholds(df, piece_rows=hot).first()
        assert (r.auto_approve_threshold, r.review_threshold) == want


def test_span_eval_counts_characters(spark):
    text = "Go now, he said. Rain fell. Why me? she asked. Night."
    truth = [("p", 0, "dialogue", "Ann", "Go now,"), ("p", 1, "narrator", "Narrator", "he said. Rain fell."), ("p", 2, "dialogue", "Bob", "Why me?")]
    pred = [("p", "m", 0, "dialogue", "ann", "Go now, he said."), ("p", "m", 1, "dialogue", "Cy", "me?"), ("p", "m", 2, "dialogue", "Cy", "not there")]
    r = K.span_eval(
        spark.createDataFrame(truth, "passage_id string, ord int, type string, speaker string, text string"),
        spark.createDataFrame(pred, "passage_id string, method string, ord int, type string, speaker string, text string"),
        spark.createDataFrame([("p", text)], "passage_id string, text string"),
    ).first()
    tp, p_len, t_len = 7 + 3, 16 + 3, 7 + 7
    assert r.precision == round(tp / p_len * 100, 1) and r.recall == round(tp / t_len * 100, 1)
    assert r.iou == round(tp / (p_len + t_len - tp) * 100, 1) and r.speaker_accuracy == 70.0
    assert (r.tag_bleeds, r.predicted_spans, r.dialogue_spans) == (1, 3, 3)


def test_relationship_state_before_between_and_reversed(spark):
    states = spark.createDataFrame(
        [(1, "josh", "Maren", 10, "family", "warm", None, "a_over_b", None), (1, "josh", "Maren", 214, "family", "tense", "estranged", "equal", "quarrel")],
        "doc_id bigint, a string, b string, from_segment bigint, relation_type string, relation_tone string, status string, power_dynamic string, trigger string",
    )
    asked = spark.createDataFrame(
        [(1, 3, "Josh ", "maren"), (1, 50, "maren", "josh"), (1, 216, "josh", "maren"), (1, 5, "josh", "zed"), (1, 6, "", "x")],
        "doc_id bigint, seg_idx bigint, a string, b string",
    )
    rows = {r.seg_idx: r for r in R.relationship_asof(asked, states).collect()}
    assert rows[3].relation_tone == "warm" and rows[3].status == "current"
    assert rows[50].power_dynamic == "b_over_a" and rows[216].trigger == "quarrel"
    assert rows[5].relation_type == "stranger" and rows[6].relation_type == "unknown" and rows[6].pair_id is None


def test_alias_folding(spark):
    cast = spark.createDataFrame(
        [(1, 0, "Maren Hale", ["Mare", "the captain"]), (1, 1, "Robert Smith", ["Bob"])],
        "doc_id bigint, ord int, name string, aliases array<string>",
    )
    said = spark.createDataFrame([(1, n) for n in ["Doctor Smith", "BOB", "the Captain", "Unknown Stranger", None]], "doc_id bigint, speaker string")
    got = [r.resolved_speaker for r in C.resolve_alias(said, C.alias_index(cast)).collect()]
    assert sorted(got) == sorted(["Robert Smith", "Robert Smith", "Maren Hale", "Unknown Stranger", "unknown"])
    text = spark.createDataFrame([(1, "Ms. Hale met Captain Hale. Doctor  Smith's hat. Miss Smithson.")], "doc_id bigint, text string")
    found = {r.suggested_alias: r.occurrence_count for r in C.discover_aliases(text, cast).collect()}
    assert found == {"Ms. Hale": 1, "Captain Hale": 1, "Doctor Smith": 1}


def test_lexicon_longest_first_and_literal(spark):
    lex = spark.createDataFrame(
        [(1, "New York", "Nu Yark $1", "x", False, ""), (1, "York", "Yorrk", "phoneme", False, ""), (1, "IT", "eye tee", "expansion", True, "")],
        "doc_id bigint, target_word string, replacement string, type string, case_sensitive boolean, notes string",
    )
    segs = spark.createDataFrame([(1, 0, "new york, York and Yorkshire. it is IT.")], "doc_id bigint, seg_idx int, text string")
    r = L.apply_lexicon(segs, lex).first()
    assert r.text == "Nu Yark $1, Yorrk and Yorkshire. it is eye tee."
    assert [(a.target_word, a.type, a.occurrences) for a in r.applied] == [("New York", "respelling", 1), ("York", "phoneme", 1), ("IT", "expansion", 1)]


SCRIPT = """Title: The Book
Author: Someone

===

# One

INT. HALL
= A quiet start
/* [[relationship_snapshot: {"a": "warm"}]] */

It rained.
All night.
/* [[meta: {"id": "n1", "hash": "h1"}]] */

@Ada Moss
(softly)
Are you there?
/* [[meta: {"id": "d1", "conf": 0.9}]] */
Say something.

/* a note
over lines */
BRAM (V.O.)
No.

.CELLAR
Dust
@Ada
Gone.

CLEO

The end.
"""


@pytest.mark.parametrize("step", [1, 70_000])
def test_screenplay_forms(spark, step):
    lines = [(1, i * step, s) for i, s in enumerate(SCRIPT.split("\n"))]
    titles, segs = S.screenplay_import(spark.createDataFrame(lines, "doc_id bigint, line_no bigint, line string"))
    assert {r.key: r.value for r in titles.collect()} == {"title": "The Book", "author": "Someone"}
    rows = segs.orderBy("seg_idx").collect()
    assert [(r.seg_id, r.type, r.speaker, r.text) for r in rows] == [
        ("n1", "narrator", "Narrator", "It rained. All night."),
        ("d1", "dialogue", "Ada Moss", "Are you there? Say something."),
        ("seg_3", "dialogue", "BRAM", "No."),
        ("seg_4", "narrator", "Narrator", "Dust"),
        ("seg_5", "dialogue", "Ada", "Gone."),
        ("seg_6", "narrator", "Narrator", "The end."),
    ]
    assert [r.scene_heading for r in rows] == ["INT. HALL"] * 3 + ["CELLAR"] * 3
    assert [r.scene_synopsis for r in rows] == ["A quiet start"] * 3 + [None] * 3
    assert rows[1].direction == "softly" and rows[1].confidence == 0.9 and rows[0].hash == "h1"
    assert rows[1].relationship_snapshot == {"a": "warm"} and rows[4].relationship_snapshot is None


def test_staging_reads_the_next_then_the_last_narrator(spark):
    segs = [
        (1, 0, "narrator", "Narrator", "Her voice was low and cold. Rain.", "", "calm"),
        (1, 1, "dialogue", "Ada", "Come in.", "", ""),
        (1, 2, "narrator", "Narrator", "A door.", "", ""),
        (1, 3, "dialogue", "Bram", "No.", "", "calm"),
        (1, 4, "narrator", "Narrator", "he whispered softly.", "", ""),
    ]
    df = spark.createDataFrame(segs, "doc_id bigint, seg_idx int, type string, speaker string, text string, direction string, emotion string")
    cast = spark.createDataFrame([(1, "Bram", "Adult", "Male", "high")], "doc_id bigint, name string, age string, gender string, voice_profile string")
    rows = {r.seg_idx: r for r in G.stage_segments(df, cast).collect()}
    assert rows[1].direction == "Low and cold." and rows[1]["style"].acting_persona == "ada persona"
    assert rows[3].emotion == "whisper" and rows[3]["style"].pitch == "low" and rows[3]["style"].gender == "Male"
    assert rows[0]["style"].acting_persona == "omniscient storyteller"


def test_pauses_and_marker_math(spark):
    segs = [(1, 0, "a", "x", None), (1, 1, "b", "SCENE two", None), (1, 2, "c", "x", None), (1, 3, "c", "x", None), (1, 4, "d", "x", 0.8)]
    df = spark.createDataFrame(segs, "doc_id bigint, seg_idx int, speaker string, text string, gap_before double").withColumn("type", F.lit("dialogue"))
    got = TL.inter_segment_pause(df).orderBy("seg_idx").collect()
    assert [r.pause_seconds for r in got] == [0.0, 1.0, 0.45, 0.25, 0.8]


def test_risk_queue_keeps_ties_in_order(spark):
    rows = [(1, i, 0.5 if i % 3 else 0.9, "high") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, seg_idx bigint, risk_score double, risk_tier string")
    got = Q.risk_queue(df, top_pct=50.0).orderBy("queue_pos").collect()
    want = sorted(rows, key=lambda r: (-r[2], r[1]))[:15]
    assert [r.seg_idx for r in got] == [w[1] for w in want]
