import random
import re

from pyspark.sql import functions as F

from proseloom.functions import hashing as H
from proseloom.operators import ranges as RG
from proseloom.operators import text as X


def _one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id bigint, text string")


def test_clean_marks_and_breaks(spark):
    raw = "“Hi”--he said[2]\r\nand left   \n\n\n\nNext [note 3] day. ‘Tis…. so–so"
    got = X.sanitize_text(_one(spark, raw)).first().text
    assert got == "\"Hi\"—he said and left\n\nNext  day. 'Tis... so—so"


def test_british_quotes_keep_apostrophes(spark):
    raw = "He said 'don't go,' and 'em too.\n'Yes, it's Yay's,' she said. ('No!')"
    got = X.normalize_british_quotes(_one(spark, raw), auto=True).first().text
    assert got == "He said \"don't go,\" and 'em too.\n\"Yes, it's Yay's,\" she said. (\"No!\")"
    kept = 'A "b" and "c", \'d\''
    assert X.normalize_british_quotes(_one(spark, kept), auto=True).first().text == kept


def test_chapters_roman_repeat_and_prose_line(spark):
    front = "x" * 60
    raw = f"{front}\nCHAPTER 1: Dawn\nBody one.\n\nPart of the reason was rain.\n# Chapter IV\nTwo.\nChapter 1\nThree."
    rows = X.split_chapters(_one(spark, raw)).orderBy("chapter_pos").collect()
    assert [r.chapter_id for r in rows] == ["chapter_00", "chapter_01", "chapter_04", "chapter_01_2"]
    assert rows[1].raw_text == "Body one.\n\nPart of the reason was rain."
    assert rows[1].chapter_title == "CHAPTER 1: Dawn" and rows[2].chapter_title == "Chapter IV"
    plain = X.split_chapters(_one(spark, "No heading here.")).collect()
    assert [(r.chapter_id, r.chapter_title) for r in plain] == [("chapter_01", "Chapter 1")]


def test_chapters_by_line(spark):
    raw = "lost\nPrologue\nOnce.\nBOOK two — The River\nThen.\nchapter 3: Ends\n"
    rows = X.detect_chapters_by_line(_one(spark, raw)).orderBy("index").collect()
    assert [r.title for r in rows] == ["Prologue", "Book two — The River", "Chapter 3 — Ends"]
    assert [r.text for r in rows] == ["Once.", "Then.", ""]
    kept = X.detect_chapters_by_line(_one(spark, raw), keep_prologue=True).orderBy("index").collect()
    assert kept[0].text == "lost" and len(kept) == 4


def test_scenes_skip_breaks(spark):
    raw = "a\nb\n***\n* * *\nc\nChapter Two\nd\n---"
    rows = X.split_paragraphs_scenes(_one(spark, raw)).orderBy("para_idx").collect()
    assert [(r.para_idx, r.scene_id) for r in rows] == [(0, 0), (1, 0), (4, 1), (6, 2)]


def test_quoted_pieces_rebuild_the_paragraph(spark):
    para = 'He ran. "Stop," she said, "now!" A stray " mark and ""empty"" ones.'
    df = spark.createDataFrame([(1, 0, para)], "doc_id bigint, para_idx int, text string")
    rows = X.segment_quoted(df).orderBy("piece_idx").collect()
    assert [r.text for r in rows if r.type == "dialogue"] == ["Stop,", "now!", "mark and", "empty"]
    for r in rows:
        assert r.text in para[r.start :]
    spoken = next(r for r in rows if r.type == "dialogue")
    assert spoken.preceding_context == "He ran." and spoken.following_context.startswith("she said")


def test_unmarked_speech(spark):
    para = "It was late. The rain fell. Are you coming? he said. Nobody moved. he asked, who is there. Look at that."
    df = spark.createDataFrame([(1, 0, para)], "doc_id bigint, para_idx int, text string")
    rows = X.segment_unmarked(df).orderBy("piece_idx").collect()
    assert [(r.type, r.text) for r in rows] == [
        ("narrator", "It was late. The rain fell."),
        ("dialogue", "Are you coming?"),
        ("narrator", "he said. Nobody moved. he asked"),
        ("dialogue", "who is there."),
        ("dialogue", "Look at that."),
    ]


def test_unmarked_suffix_tag(spark):
    df = spark.createDataFrame([(1, 0, "I will go now, she whispered. The door shut.")], "doc_id bigint, para_idx int, text string")
    rows = X.segment_unmarked(df).orderBy("piece_idx").collect()
    assert [(r.type, r.text) for r in rows] == [
        ("dialogue", "I will go now"),
        ("narrator", "she whispered. The door shut."),
    ]


def _windows(words, limit, overlap):
    """Greedy packing, written as a loop over sentence sizes."""
    if sum(words) <= limit:
        return [(0, len(words))]
    out, start = [], 0
    while start < len(words):
        total, end = 0, start
        while end < len(words) and not (total + words[end] > limit and end > start):
            total += words[end]
            end += 1
        out.append((start, end))
        if end >= len(words):
            break
        shared, back = 0, end - 1
        while back > start and shared < overlap:
            shared += words[back]
            back -= 1
        start = start + 1 if back + 1 <= start else back + 1
    return out


def test_windows_cover_the_text(spark):
    text = "".join(f"{'w ' * (i % 7)}end{i}. " for i in range(60)).strip() + " tail without stop 3.14"
    rows = X.overlap_windows(_one(spark, text), max_words=30, overlap=6).orderBy("window_idx").collect()
    pieces = re.split(r"(?<=[.!?])(?=\s)", text)
    assert rows[0].text == text[: len(rows[0].text)] and text.endswith(rows[-1].text)
    sizes = [len(p.split()) for p in pieces]
    assert len(rows) == len(_windows(sizes, 30, 6))
    whole = X.overlap_windows(_one(spark, text)).collect()
    assert [r.text for r in whole] == [text]


def test_locate_moves_forward_and_falls_back(spark):
    source = "One  two.\nOne two. Three\tfour."
    segs = [(1, 0, "One two."), (1, 1, "One two."), (1, 2, "Three four."), (1, 3, "One two."), (1, 4, "absent"), (1, 5, " ")]
    df = spark.createDataFrame(segs, "doc_id bigint, seg_idx int, text string")
    for how in ({}, {"block_rows": 2}):
        rows = RG.locate_in_source(df, _one(spark, source), **how).orderBy("seg_idx").collect()
        assert [(r.start, r.end) for r in rows] == [(0, 9), (10, 18), (19, 30), (0, 9), (-1, -1), (-1, -1)]


def test_name_seed_is_stable(spark):
    got = spark.range(1).select(H.name_hash(F.lit("Ada Moss")).alias("h"), H.name_seed(F.lit("Ada Moss")).alias("s")).first()
    h = 0
    for ch in "Ada Moss":
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    h = h - (1 << 32) if h >= 1 << 31 else h
    assert got.h == h and got.s == abs(h) % 90000 + 10000


def test_soft_breaks_are_found_from_the_newline(spark):
    """Same result as taking one sign on both sides of a break, also where breaks share a sign."""
    draw = random.Random(31)
    made = ["".join(draw.choice("ab.\n\n'\"—é😀 ") for _ in range(60)) for _ in range(300)] + ["a\nb\nc\nd", "\na", "a\n", "", "😀\na"]
    rows = spark.createDataFrame(list(enumerate(made)), "i int, text string")
    taken = F.regexp_replace("text", "([^\\n.!?\":;—…])\\n([a-zA-Z0-9\"'])", "$1 $2")
    found = rows.select(taken.alias("old"), F.regexp_replace("text", T.SOFT_BREAK, " $1").alias("new"))
    assert found.where("old <> new").count() == 0
    assert T.SOFT_BREAK.startswith("\\n")
