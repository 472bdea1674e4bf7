"""Operator inputs derived from the given tables.

The tables hold invented prose without dialogue, casts or takes. The views here
derive them row by row: who speaks, where quotes and tags stand, scores, verdicts
and takes all follow from the rows of the tables, so the work of every query
grows with them. Each view is plain SQL that runs on Spark and on other engines.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

_WRITTEN: dict[tuple[str, str, str], str] = {}

BASE = ["documents", "conversations", "events", "embeddings", "labels", "benchmark", "pages"]


def pick(words: list[str], index: str) -> str:
    """SQL for one of a few words by a non-negative integer expression."""
    return f"split_part('{'|'.join(words)}', '|', CAST(({index}) % {len(words)} AS INT) + 1)"


def name(doc: str, ord_: str) -> str:
    """SQL for the full name of a member of a book's cast."""
    first = pick(["Ada", "Bram", "Cleo", "Dario", "Esme", "Felix", "Greta", "Hugo"], f"{doc} + {ord_}")
    last = pick(["Moss", "Quill", "Rowe", "Stark", "Thorne", "Vale", "Wren"], f"{doc} * 3 + {ord_} * 2")
    return f"({first} || ' ' || {last})"


def given_name(doc: str, ord_: str) -> str:
    return f"split_part({name(doc, ord_)}, ' ', 1)"


_ORDS = "(SELECT 0 AS ord UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)"

VIEWS: dict[str, str] = {}

VIEWS["books"] = "SELECT DISTINCT conv_id AS doc_id FROM {conversations}"

# Four characters per book; the second has an alias with a title.
VIEWS["people"] = f"""
SELECT doc_id, ord, 'c' || CAST(ord AS STRING) AS char_id, {name("doc_id", "ord")} AS name,
       CASE WHEN ord = 1 THEN 'Dr. ' || split_part({name("doc_id", "ord")}, ' ', 2)
            WHEN ord = 2 THEN 'the captain' END AS alias,
       CASE WHEN ord = 3 AND doc_id % 4 = 0 THEN TRUE ELSE FALSE END AS always_present,
       {pick(["Female", "Male", "Unknown"], "doc_id + ord")} AS gender,
       {pick(["Adult", "Child", "Elderly"], "doc_id + ord * 2")} AS age,
       {pick(["low, slow voice", "high clipped voice", "ceremonial", ""], "doc_id + ord")} AS voice_profile,
       {pick(["warm; patient", "Dry, exact", ""], "doc_id + ord")} AS traits,
       CASE WHEN (doc_id + ord) % 5 = 0 THEN TRUE ELSE FALSE END AS is_locked,
       CASE WHEN ord < 2 THEN 'voice_' || CAST(doc_id % 4 AS STRING) END AS voice_id
FROM books CROSS JOIN {_ORDS} o
"""

# A script row per conversation turn.
VIEWS["script"] = f"""
SELECT conv_id AS doc_id, CAST(turn AS INT) AS seg_idx, 'seg_' || CAST(turn + 1 AS STRING) AS seg_id,
       CASE WHEN role = 'system' OR turn % 5 = 4 THEN 'narrator' ELSE 'dialogue' END AS type,
       CASE WHEN role = 'system' OR turn % 5 = 4 THEN 'Narrator'
            WHEN (conv_id + turn) % 11 = 3 THEN 'unknown'
            WHEN role = 'user' THEN {name("conv_id", "0")} ELSE {name("conv_id", "1")} END AS speaker,
       text,
       {pick(["expressive delivery", "whispered softly", "", "angry and sharp", "with warmth"], "conv_id + turn")}
           AS direction,
       CASE CAST(floor(turn / 2.0) AS INT) % 3 WHEN 0 THEN 'INT. HALL' WHEN 1 THEN 'EXT. COURT' ELSE '' END
           AS scene_heading,
       CASE WHEN (conv_id + turn) % 7 = 0 THEN NULL
            ELSE CAST((conv_id * 13 + turn * 29) % 101 AS DOUBLE) / 100 END AS confidence,
       (conv_id + turn) % 9 = 0 AS is_user_locked,
       (conv_id + turn * 3) % 17 = 0 AS is_flagged,
       {pick(["calm", "anger", "fear", "joy", "grief", "odd", ""], "conv_id + turn")} AS emotion,
       CAST((conv_id * 7 + turn * 11) % 21 AS DOUBLE) / 20 AS intensity,
       'voice_' || CAST(conv_id % 4 AS STRING) AS voice_id,
       CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL
            ELSE 'audio/' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) || '.wav' END AS audio_path,
       'chapter_0' || CAST(CAST(floor(turn / 3.0) AS INT) + 1 AS STRING) AS chapter_id,
       CASE WHEN (conv_id + turn) % 13 = 5 THEN CAST(turn AS DOUBLE) / 10 END AS gap_before,
       CASE WHEN (conv_id + turn) % 10 = 7 THEN 0.9 END AS pause_after,
       (conv_id + turn) % 12 = 1 AS is_interrupted,
       CAST(length(text) AS DOUBLE) / (6 + (conv_id + turn) % 24) AS duration_s
FROM {{conversations}}
"""

# First sentence and rest of a turn, on one line and without quotes.
VIEWS["turns"] = """
SELECT conv_id AS doc_id, CAST(turn AS INT) AS para_idx, x,
       trim(split_part(x, '.', 1)) AS s1, trim(substr(x, length(split_part(x, '.', 1)) + 2)) AS rest,
       CAST((conv_id + turn) % 7 AS INT) AS k
FROM (SELECT conv_id, turn, replace(replace(replace(text, chr(13), ' '), chr(10), ' '), '"', '') AS x
      FROM {conversations}) q
"""

# Prose with tagged, addressed, open and plain paragraphs and scene breaks.
VIEWS["prose"] = f"""
SELECT doc_id, para_idx, k, s1,
       CASE k
         WHEN 0 THEN '"' || s1 || '," said ' || {name("doc_id", "0")} || '. ' || rest
         WHEN 1 THEN '"' || s1 || '," ' || {name("doc_id", "1")} || ' softly muttered. ' || rest
         WHEN 2 THEN '"' || {name("doc_id", "0")} || ', ' || s1 || '." ' || rest
         WHEN 3 THEN x || ' "' || s1 || '?" And "' || s1 || '!"'
         WHEN 4 THEN '"' || s1 || '. ' || rest
         WHEN 5 THEN CASE WHEN para_idx % 2 = 0 THEN '***' ELSE x END
         ELSE '"' || s1 || '"' END AS text
FROM turns
"""

# Every closed quote of each paragraph, also where there are two.
VIEWS["spans"] = f"""
SELECT doc_id, para_idx, para_idx * 2 AS span_ord, 'sp_' || CAST(para_idx AS STRING) AS span_id,
       CASE WHEN k = 3 THEN length(text) - length(s1) * 2 - 10 ELSE 1 END AS start,
       CASE k WHEN 0 THEN s1 || ',' WHEN 1 THEN s1 || ','
              WHEN 2 THEN {name("doc_id", "0")} || ', ' || s1 || '.'
              WHEN 3 THEN s1 || '?' WHEN 4 THEN s1 || '.' ELSE s1 END AS text
FROM prose WHERE k <> 5 AND s1 <> ''
UNION ALL
SELECT doc_id, para_idx, para_idx * 2 + 1, 'sp_' || CAST(para_idx AS STRING) || 'b', length(text) - length(s1) - 2, s1 || '!'
FROM prose WHERE k = 3 AND s1 <> ''
"""

# Raw scores of two scorers, asked with the options in both orders.
VIEWS["scores"] = f"""
SELECT s.doc_id, s.span_id, a.adapter, r.ordering,
       CASE WHEN o.ord = 4 THEN 'unknown' ELSE 'c' || CAST(o.ord AS STRING) END AS option_id,
       o.ord AS option_ord,
       CAST((s.doc_id * 31 + s.para_idx * 17 + o.ord * 13 + a.a * 7 + r.r * 3) % 97 AS DOUBLE) / 97 - 0.1
         + CASE WHEN (s.doc_id + s.para_idx) % 3 <> 0 AND o.ord = (s.doc_id + s.para_idx) % 2 THEN 3.0
                WHEN (s.doc_id + s.para_idx) % 6 = 0 AND o.ord = 0 THEN 0.8 ELSE 0.0 END AS score
FROM spans s
CROSS JOIN (SELECT 'first' AS adapter, 0 AS a UNION ALL SELECT 'second', 1) a
CROSS JOIN (SELECT 'forward' AS ordering, 0 AS r UNION ALL SELECT 'reverse', 1) r
CROSS JOIN (SELECT 0 AS ord UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) o
"""

# Relationship states and the positions asked for, one book per user.
_PAIR = f"user_id AS doc_id, {name('user_id', '0')} AS a, {name('user_id', '1')} AS b"
_RPAIR = f"user_id AS doc_id, {name('user_id', '1')} AS a, {name('user_id', '0')} AS b"
_TYPES = ["family", "romantic", "friendship", "professional", "acquaintance", "service", "allied", "stranger"]
_STATE = f"""
{pick(_TYPES, "event_id")} AS relation_type, {pick(["warm", "neutral", "tense", "hostile"], "event_id + user_id")}
  AS relation_tone, {pick(["current", "former", "estranged", "developing"], "event_id * 3")} AS status,
{pick(["equal", "a_over_b", "b_over_a"], "event_id * 7")} AS power_dynamic,
CASE WHEN event_id % 4 = 0 THEN 'event ' || CAST(event_id AS STRING) END AS trigger
"""
VIEWS["states"] = f"""
SELECT {_PAIR}, CAST(NULL AS STRING) AS pair_id, event_id AS from_segment,
       CAST(floor(event_id / 100.0) AS BIGINT) + 1 AS from_chapter, {_STATE}
FROM {{events}} WHERE event_type IN ('signup', 'error')
"""
VIEWS["pairs"] = f"""
SELECT {_PAIR}, event_id AS seg_idx, CAST(floor(event_id / 100.0) AS BIGINT) + 1 AS chapter, event_id AS segment
FROM {{events}} WHERE event_type = 'click' AND event_id % 2 = 0
UNION ALL
SELECT {_RPAIR}, event_id AS seg_idx, CAST(floor(event_id / 100.0) AS BIGINT) + 1 AS chapter, event_id AS segment
FROM {{events}} WHERE event_type = 'click' AND event_id % 2 = 1
UNION ALL
SELECT user_id AS doc_id, {name("user_id", "2")} AS a, {name("user_id", "3")} AS b, event_id AS seg_idx,
       1 AS chapter, event_id AS segment
FROM {{events}} WHERE event_type = 'purchase'
"""
VIEWS["deltas"] = f"""
SELECT {_RPAIR}, CAST(NULL AS STRING) AS pair_id, event_id - event_id % 50 AS from_segment, {_STATE},
       event_id AS arrival_ord
FROM {{events}} WHERE event_type = 'view'
UNION ALL
SELECT user_id AS doc_id, '' AS a, {name("user_id", "1")} AS b, CAST(NULL AS STRING) AS pair_id,
       event_id AS from_segment, {_STATE}, event_id AS arrival_ord
FROM {{events}} WHERE event_type = 'purchase' AND event_id % 10 = 0
"""

# Logged model decisions; two thirds carry a human verdict.
_KINDS = ["character_existence", "relationship_evidence", "emotion", "speaker_attribution"]
VIEWS["decisions"] = f"""
SELECT 'd' || CAST(event_id AS STRING) AS id, event_id AS idx, ts, {pick(_KINDS, "event_id")} AS question_type,
       {name("user_id", "event_id % 2")} AS claim, {name("user_id", "event_id % 3")} AS answer,
       CAST((event_id * 37) % 1000 AS DOUBLE) / 1000 AS raw_probability,
       CASE WHEN event_id % 3 = 0 THEN NULL
            ELSE (event_id * 53 + user_id * 7) % 1000 < (event_id * 37) % 1000 + 120 - event_id % 4 * 60
       END AS human_verdict,
       event_id % 2 = event_id % 3 AS is_agreement,
       CASE WHEN event_id % 6 = 0 THEN 'checked' END AS notes
FROM {{events}}
"""
VIEWS["params"] = """
SELECT 'character_existence' AS question_type, 2.5 AS fitted_temperature, FALSE AS is_provisional,
       FALSE AS boundary_pegged, 0.8 AS auto_approve_threshold, 0.45 AS review_threshold
UNION ALL SELECT 'relationship_evidence', 0.05, TRUE, TRUE, 0.9, 0.5
UNION ALL SELECT 'emotion', 3.5, TRUE, TRUE, 0.0, 0.0
"""

# Takes and anchor voices.
VIEWS["voices"] = """
SELECT vec_id AS take_id, vec_id % 3 AS doc_id, 'c' || CAST(label AS STRING) AS char_id, embedding,
       CAST(vec_id % 5 AS INT) + 1 AS band, CAST(60 + vec_id % 41 AS DOUBLE) AS stt_accuracy_pct,
       CAST(5 + vec_id % 24 AS DOUBLE) AS chars_per_second, label
FROM {embeddings}
"""
VIEWS["anchors"] = """
SELECT v.doc_id, v.char_id, v.embedding, CAST(v.label AS BIGINT) AS ord
FROM voices v JOIN (SELECT doc_id, char_id, min(take_id) AS take_id FROM voices WHERE label < 9
                    GROUP BY doc_id, char_id) f
  ON v.take_id = f.take_id
"""

# Narration that says how a line is spoken.
_VERBS = ["whispered", "shouted", "snapped", "laughed", "said", "stammered"]
_ADVERBS = ["softly", "coldly", "urgently", "wearily", "firmly"]
VIEWS["narration"] = f"""
SELECT doc_id, para_idx AS seg_idx,
       CASE k WHEN 0 THEN 'Her voice was ' || s1 || '. ' || rest
              WHEN 1 THEN s1 || ', she ' || {pick(_VERBS, "doc_id + para_idx")} || ' '
                          || {pick(_ADVERBS, "doc_id * 3 + para_idx")} || '. ' || rest
              WHEN 2 THEN 'He spoke in a quiet ' || s1 || ' tone. ' || rest
              WHEN 3 THEN 'His voice trembling as he went, ' || x
              WHEN 4 THEN 'They ' || {pick(_VERBS, "doc_id * 5 + para_idx")} || ' with an amused growl. ' || x
              ELSE x END AS text
FROM turns
"""
# The script with its narration in place of the narrator's turns.
VIEWS["staged"] = """
SELECT s.doc_id, s.seg_idx, s.type, s.speaker,
       CASE WHEN s.type = 'narrator' THEN n.text ELSE s.text END AS text, s.direction, s.emotion,
       s.is_user_locked
FROM script s JOIN narration n ON s.doc_id = n.doc_id AND s.seg_idx = n.seg_idx
"""

# Documents with headings: numbered ones (with repeats), Roman ones and a plain word.
VIEWS["chaptered"] = """
SELECT doc_id,
       replace(replace(replace(replace(text, chr(13), ''),
         chr(10) || 'T', chr(10) || 'CHAPTER ' || CAST(doc_id % 20 + 1 AS STRING) || ': Turns' || chr(10) || 'T'),
         chr(10) || 'O', chr(10) || 'Part XIV' || chr(10) || 'O'),
         chr(10) || 'E', chr(10) || 'Part of it' || chr(10) || 'E') AS text
FROM {documents}
"""

# Character ranges of each document: one list with and one without gaps.
VIEWS["ranges_a"] = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS INT) AS idx,
       CAST(turn * 120 AS INT) AS lo, CAST(turn * 120 + 40 + n % 70 AS INT) AS hi
FROM (SELECT conv_id AS doc_id, turn, length(text) AS n FROM {conversations}) q
"""
VIEWS["ranges_b"] = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS INT) AS idx,
       CAST(CASE WHEN n % 9 = 0 THEN -1 ELSE turn * 100 + n % 60 END AS INT) AS lo,
       CAST(CASE WHEN n % 9 = 0 THEN -1 ELSE turn * 100 + n % 60 + 5 + n % 30 END AS INT) AS hi
FROM (SELECT conv_id AS doc_id, turn, length(text) AS n FROM {conversations}) q
"""

_NEEDS = {v: [u for u in VIEWS if u != v and f" {u} " in f"{s} ".replace("\n", " ")] for v, s in VIEWS.items()}


def closure(views: list[str]) -> list[str]:
    """The views and all views they read, in order of definition."""
    wanted = set()

    def add(view: str) -> None:
        if view not in wanted:
            wanted.add(view)
            for other in _NEEDS[view]:
                add(other)

    for view in views:
        add(view)
    return [v for v in VIEWS if v in wanted]


def with_views(views: list[str], body: str) -> str:
    """Statement text with the named views in front, over plain table names."""
    named = {t: t for t in BASE}
    ctes = [f"{v} AS ({VIEWS[v].strip().format(**named)})" for v in closure(views)]
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body[: len(start)].upper() == start:
            return f"{start}{', '.join([*ctes, body[len(start) :]])}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


class Inputs:
    """Given tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, table: str) -> DataFrame:
        """A given table. One that comes as fewer splits than there are cores is
        spread over them, because the work per row of text is much larger than the
        cost of moving it; a table with enough splits is read as it is."""
        df = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

    def view(self, view: str) -> DataFrame:
        """A derived view, written once per session as the table it stands for."""
        key = (self.spark.sparkContext.applicationId, self.folder, view)
        if key not in _WRITTEN:
            path = f"{checkpoint_dir(self.spark)}/inputs-{uuid.uuid4().hex}/{view}"
            self._derive(view).write.parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    def _derive(self, view: str) -> DataFrame:
        names = closure([view])
        used = [t for t in BASE if any("{" + t + "}" in VIEWS[v] for v in names)]
        ctes = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in names)
        return self.spark.sql(f"WITH {ctes} SELECT * FROM {view}", **{t: self.table(t) for t in used})

    @cached_property
    def people(self) -> DataFrame:
        return self.view("people").selectExpr(
            "*", "CASE WHEN alias IS NULL THEN CAST(array() AS array<string>) ELSE array(alias) END AS aliases"
        )

    @cached_property
    def script(self) -> DataFrame:
        return self.view("script")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")
