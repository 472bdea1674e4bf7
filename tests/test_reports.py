"""Reports over casts, prompts and methods, and operators that lost their row-wise form."""

import random

import pytest
from pyspark.sql import functions as F

from proseloom.operators import attribution as A
from proseloom.operators import calibration as K
from proseloom.operators import cast as C
from proseloom.operators import screenplay as S
from proseloom.operators import staging as G
from proseloom.operators import text as X


def test_leaderboard_means(spark):
    rows = [("m", 50.0, 20.0, 10.0, 1), ("m", 75.5, 40.0, 20.5, 2), ("n", 1.0, 2.0, 3.0, 0)]
    table = spark.createDataFrame(rows, "method string, f1 double, iou double, speaker_accuracy double, tag_bleeds int")
    found = {r.method: tuple(r)[1:] for r in K.method_leaderboard(table).collect()}
    assert found == {"m": (62.8, 30.0, 15.3, 3, 2), "n": (1.0, 2.0, 3.0, 0, 1)}


def test_cue_patterns_are_searched_once(spark):
    texts = ["Her voice was flat and low. She said softly, no.", "His voice trembling as he went, on", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = G.acoustic_cues(df).select("doc_id", "cues.*")
    rows = {r.doc_id: r for r in found.collect()}
    assert (rows[0].vocal_clause, rows[0].speech_verb, rows[0].speech_adverb, rows[0].is_flat, rows[0].is_soft) == ("flat and low", "said", "softly", True, True)
    assert rows[1].is_hesitant and rows[2].speech_verb is None and rows[3].is_flat is None
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 10


def test_mean_confidence_follows_line_order(spark):
    by_line = [0.12, 0.26, 0.73, 0.86, 0.55, 0.75]  # added in another order, the mean rounds to 0.55
    given = [4, 5, 2, 0, 3, 1]
    rows = [(1, k, "dialogue", "Ada", "a b", by_line[k]) for k in given] + [(1, 6, "dialogue", "Ada", "c", None), (1, 7, "dialogue", "Bo", "d", None)]
    script = spark.createDataFrame(rows, "doc_id long, seg_idx int, type string, speaker string, text string, confidence double").coalesce(1)
    people = spark.createDataFrame([(1, "Ada", "v")], "doc_id long, name string, voice_id string")
    for parts in (script, script.repartition(4)):
        found = {r.speaker: r for r in S.character_breakdown(parts, people).collect()}
        assert (found["Ada"].average_confidence, found["Ada"].line_count, found["Ada"].word_count) == (0.54, 7, 13)
        assert (found["Bo"].average_confidence, found["Bo"].line_count) == (1.0, 1)
        assert "averages 0.54" in S.sanity_flags(S.character_breakdown(parts, people)).where("severity = 'medium'").first().message


def test_ablation_levels_and_risk(spark):
    rows = [(1, 0, "Go now.", "angry", 3, "angry", 4, "Bram", "near", "low", ["tired"], ["now"], "softer"), (1, 1, "Yes, I will come with you, of course, tomorrow.", *[None] * 10)]
    schema = (
        "doc_id long, seg_idx int, text string, displayed_emotion string, displayed_band int, felt_emotion string, felt_band int, "
        "addressee string, distance string, expression string, physical_state array<string>, emphasis array<string>, director_note string"
    )
    grid = G.prompt_ablation_grid(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.seg_idx, r.level) for r in grid) == [(s, n) for s in (0, 1) for n in range(1, 9)]
    assert {(r.level, r.name) for r in grid} == {(n, name) for n, name, _ in G.ABLATION}
    spoken = {0: 2, 1: 9}
    for r in grid:
        words, commas = len(r.instruction.split()), r.instruction.count(",")
        assert (r.instruction_chars, r.instruction_words, r.clause_count) == (len(r.instruction), words, commas or 1)
        ratio = words / spoken[r.seg_idx]
        assert r.leakage_risk == ("high" if ratio > 6 and words > 35 else "medium" if ratio > 3.5 or (commas or 1) > 5 else "low")
    text = {(r.seg_idx, r.level): r.instruction for r in grid}
    assert "softer" in text[0, 8] and G.DEFAULT_NOTE in text[1, 8] and "Bram" in text[0, 4] and "the listener" in text[1, 4]
    assert "Bram" not in text[0, 3] and "softer" not in text[0, 7] and "tired" in text[1, 6]


def test_ablation_counts_a_line_once(spark):
    texts = [None, "", "  ,a b,\n", "\x85x y", "\u180ez", "' , '"]
    segments = spark.createDataFrame([(1, i, s) for i, s in enumerate(texts)], "doc_id long, seg_idx int, text string")
    grid = G.prompt_ablation_grid(segments)
    assert "regexp_extract_all(instruction" not in grid._jdf.queryExecution().optimizedPlan().toString()
    rows = grid.select("*", G.T.words(F.col("instruction")).alias("w"), F.regexp_count("instruction", F.lit(",")).alias("c")).collect()
    assert len(rows) == 8 * len(texts)
    for r in rows:
        assert (r.instruction_words, r.clause_count, r.instruction_chars) == (r.w, r.c or 1, len(r.instruction))


def test_profiles_fold_into_the_cast(spark):
    cast = spark.createDataFrame(
        [(1, 0, "Ada Moss", "Female", "Adult", "calm", False), (1, 1, "Bram Vale", "Male", "Adult", "deep", True)],
        "doc_id long, ord int, name string, gender string, age string, voice_profile string, is_locked boolean",
    )
    found = [
        (1, 0, "Ada", None, "", "A young woman, low", "", "curious"),
        (1, 1, "Ada", None, "", "an old female voice", "", ""),
        (1, 2, "Vale", "Other", "Child", "x", "", "y"),
        (1, 3, "Cleo", "", "", "", "an elderly male", ""),
    ]
    schema = "doc_id long, ord int, name string, gender string, implied_age string, voice_profile string, base_voice string, personality_traits string"
    rows = {r.name: r for r in C.merge_cast_profiles(cast, spark.createDataFrame(found, schema)).collect()}
    assert set(rows) == {"Ada Moss", "Bram Vale", "Cleo"}
    ada, bram, cleo = rows["Ada Moss"], rows["Bram Vale"], rows["Cleo"]
    # The last profile wins; a locked row stays.
    assert (ada.gender, ada.age, ada.voice_profile, ada.traits, ada.is_new) == ("Female", "Elderly", "an old female voice", "an old female voice", False)
    assert (bram.gender, bram.voice_profile, bram.traits, bram.is_locked) == ("Male", "deep", None, True)
    assert (cleo.gender, cleo.age, cleo.voice_profile, cleo.traits, cleo.is_new) == ("Male", "Elderly", "an elderly male", "Story character", True)
    assert cleo.seed is not None and ada.seed is None


@pytest.mark.parametrize("block_rows", [3, 1 << 16])
def test_context_over_block_borders(spark, block_rows):
    paragraphs = spark.createDataFrame([(1, n // 13, n, f"p{n} text") for n in range(40)], "doc_id long, scene_id int, para_idx int, text string")
    spans = spark.createDataFrame([(1, n, f"s{n}", "text", None) for n in range(40)], "doc_id long, para_idx int, span_id string, text string, start int")
    found = {r.span_id: r.context for r in A.context_window(spans, paragraphs, block_rows=block_rows).collect()}
    for n in range(40):
        shown = [k for k in range(n - 3, n + 2) if 0 <= k < 40 and k // 13 == n // 13]
        want = [f"p{k} [[LINE s{n}]]text[[/LINE]]" if k == n else f"p{k} text" for k in shown]
        assert found[f"s{n}"] == "\n\n".join(want)


@pytest.mark.parametrize("block_words", [25, 1 << 20])
def test_windows_of_a_long_book(spark, block_words):
    draw = random.Random(block_words)
    sizes = [draw.choice([1, 2, 3, 9, 40]) for _ in range(400)]
    text = "".join(f"{'w ' * (n - 1)}end. " for n in sizes).strip()
    rows = X.overlap_windows(spark.createDataFrame([(1, text), (2, "short one."), (3, ""), (4, None)], "doc_id long, text string"), 30, 6, block_words).collect()
    windows, lo = [], 0
    while True:
        hi, total = lo, 0
        while hi < len(sizes) and (hi == lo or total + sizes[hi] <= 30):
            total, hi = total + sizes[hi], hi + 1
        windows.append((lo, hi, total))
        if hi == len(sizes):
            break
        back, shared = hi, 0
        while back - 1 > lo and shared < 6:
            back, shared = back - 1, shared + sizes[back - 1]
        lo = max(back, lo + 1)
    found = sorted((r.window_idx, r.word_count, r.text) for r in rows if r.doc_id == 1)
    assert [(n, w) for n, w, _ in found] == [(n, w) for n, (_, _, w) in enumerate(windows)]
    assert found[0][2] == text[: len(found[0][2])] and text.endswith(found[-1][2])
    assert {(r.doc_id, r.window_idx, r.text) for r in rows if r.doc_id > 1} == {(2, 0, "short one."), (3, 0, ""), (4, 0, "")}


def test_style_table_has_a_row_for_every_mask(spark):
    table = G.style_table(spark)
    assert table.count() == 1 << len(G.ASKED)
    bits = {key: 1 << k for k, key in enumerate(G.ASKED)}
    asked = {0: "medium", bits["is_whisper"] | bits["is_shout"]: "low", bits["is_shout"] | bits["~low"]: "high", bits["~high"]: "high"}
    found = {r.mask: r["__s_pitch"] for r in table.where(F.col("mask").isin(*asked)).collect()}
    assert found == asked
