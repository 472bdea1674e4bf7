"""Queries over pauses, timelines, takes, word timings and production counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered
from ..operators import timeline as TL
from .inputs import Inputs
from .registry import SQL_NON_WS, query, rounded
from .text_queries import words

# ---------------------------------------------------------------- pauses and starts

_PAUSE = """
    pz AS (
      SELECT *, CASE WHEN lag(seg_idx) OVER w IS NULL THEN 0.0 WHEN lag(is_interrupted) OVER w THEN 0.0
               WHEN gap_before >= 0 THEN gap_before WHEN lag(pause_after) OVER w >= 0 THEN lag(pause_after) OVER w
               WHEN upper(text) LIKE 'SCENE%' THEN 1.0 WHEN lower(lag(speaker) OVER w) <> lower(speaker) THEN 0.45
               ELSE 0.25 END::DOUBLE AS pause_seconds
      FROM script WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx))"""


@query(
    "inter_segment_pause", f"WITH {_PAUSE} SELECT doc_id, seg_idx, pause_seconds FROM pz", ["script"]
)
def inter_segment_pause(t: Inputs):
    return TL.inter_segment_pause(t.script).select("doc_id", "seg_idx", "pause_seconds")


@query(
    "timeline_preview",
    f"""WITH {_PAUSE}, d AS (SELECT *, greatest(1.5, {words("text")} / 2.5)::DOUBLE AS dur FROM pz),
    r AS (SELECT *, sum(pause_seconds + dur) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS e FROM d)
    SELECT doc_id, seg_idx, speaker, substr(text, 1, 60) AS text_preview, pause_seconds AS pause_before_seconds,
           {rounded("e - dur", 6)} AS start_seconds, {rounded("dur", 6)} AS duration_seconds,
           {rounded("max(e) OVER (PARTITION BY doc_id)", 6)} AS total_seconds FROM r""",
    ["script"],
)
def timeline_preview(t: Inputs):
    return TL.timeline_preview(t.script)


# ---------------------------------------------------------------- takes

# Several take files per line; some in the directorial folder, some not audio.
_FILES = """
SELECT doc_id, seg_idx, CASE WHEN k % 2 = 0 THEN 'classic' ELSE 'directorial' END AS track,
       CASE WHEN k = 4 THEN 'notes.txt' ELSE 'take_' || CAST((doc_id + seg_idx * k) % 12 AS STRING) ||
         CASE k % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.mp3' ELSE '.flac' END END AS file_name
FROM script CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) x
WHERE (doc_id + seg_idx + k) % 3 <> 0 AND (seg_idx % 4 <> 1 OR k % 2 = 0) AND (doc_id + seg_idx) % 9 <> 4"""
_LATEST = f"""
    files AS ({_FILES}),
    n AS (SELECT *, CAST(regexp_extract(file_name, '[0-9]+') AS INT) AS take FROM files
          WHERE file_name LIKE 'take_%'),
    tracks AS (SELECT doc_id, seg_idx, max(track) AS track FROM files GROUP BY ALL),
    latest AS (
      SELECT n.* FROM n JOIN tracks USING (doc_id, seg_idx, track)
      QUALIFY row_number() OVER (PARTITION BY n.doc_id, n.seg_idx ORDER BY take DESC, file_name) = 1)"""


def _files(t: Inputs):
    return t.spark.sql(_FILES.replace("FROM script", "FROM {script}"), script=t.script)


@query(
    "latest_take",
    f"WITH {_LATEST} SELECT doc_id, seg_idx, track, take, file_name FROM latest",
    ["script"],
)
def latest_take(t: Inputs):
    return TL.latest_take(_files(t))


_VERSIONS = """
SELECT doc_id, seg_idx, CAST(k AS INT) AS take, 'f' || CAST(seg_idx AS STRING) || '_' || CAST(k AS STRING) AS file_path,
       (doc_id + seg_idx + k) % 3 = 0 AS is_active, duration_s + k AS duration_s
FROM script CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) x WHERE (doc_id + seg_idx * 2 + k) % 4 <> 0"""


@query(
    "active_take_playlist",
    f"""WITH v AS ({_VERSIONS}),
    c AS (SELECT * FROM v WHERE is_active OR take = 1
          QUALIFY row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY is_active DESC, take) = 1),
    j AS (SELECT s.doc_id, s.seg_idx, s.speaker, coalesce(take, 1) AS active_take,
                 coalesce(file_path, 'audio/takes/line_' || s.seg_idx || '/take_1.mp3') AS file_path, coalesce(c.duration_s, 0.0) AS d
          FROM script s LEFT JOIN c ON s.doc_id = c.doc_id AND s.seg_idx = c.seg_idx),
    r AS (SELECT *, sum(d + 0.6::DOUBLE) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS e FROM j)
    SELECT doc_id, seg_idx, speaker, active_take, file_path, {rounded("e - d - 0.6::DOUBLE", 6)} AS start_seconds,
           {rounded("d", 6)} AS duration_seconds FROM r""",
    ["script"],
)
def active_take_playlist(t: Inputs):
    versions = t.spark.sql(_VERSIONS.replace("FROM script", "FROM {script}"), script=t.script)
    return TL.active_take_playlist(t.script, versions)


_PLAN = f"""
    {_PAUSE}, {_LATEST},
    plan AS (SELECT p.doc_id, p.seg_idx, p.speaker, l.file_name,
                    CASE WHEN l.file_name IS NOT NULL THEN pause_seconds END AS pause_seconds, l.file_name IS NULL AS is_missing
             FROM pz p LEFT JOIN latest l ON p.doc_id = l.doc_id AND p.seg_idx = l.seg_idx)"""


@query("assembly_plan", f"WITH {_PLAN} SELECT * FROM plan", ["script"])
def assembly_plan(t: Inputs):
    return TL.assembly_plan(t.script, _files(t))


@query(
    "assembly_counts",
    f"""WITH {_PLAN} SELECT doc_id, count_if(NOT is_missing)::BIGINT AS clips, count_if(is_missing)::BIGINT AS missing
    FROM plan GROUP BY doc_id""",
    ["script"],
)
def assembly_counts(t: Inputs):
    return TL.assembly_counts(TL.assembly_plan(t.script, _files(t)))


# ---------------------------------------------------------------- word timings


def _timed(t: Inputs):
    return TL.word_timestamps(t.script.where("duration_s > 0").select("doc_id", "seg_id", "text", "duration_s"))


# Starts follow from the rounded lengths of the words before.
_WORDS = f"""
    w0 AS (SELECT doc_id, seg_id, duration_s, regexp_extract_all(text, '{SQL_NON_WS}+') AS w FROM script WHERE duration_s > 0),
    w1 AS (SELECT doc_id, seg_id, duration_s, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM w0),
    w2 AS (SELECT *, greatest(2, length(word) + CASE WHEN regexp_matches(word, '[,—;-]$') THEN 3
                                WHEN regexp_matches(word, '[.!?]$') THEN 5 ELSE 0 END) AS wt FROM w1),
    w3 AS (SELECT *, {rounded("wt * (duration_s / sum(wt) OVER (PARTITION BY doc_id, seg_id))", 3)} AS d0 FROM w2),
    w4 AS (SELECT *, {rounded("""coalesce(sum(d0) OVER (PARTITION BY doc_id, seg_id ORDER BY i
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)""", 3)} AS acc FROM w3),
    w5 AS (SELECT doc_id, seg_id, CAST(i AS INT) AS word_idx, word, {rounded("acc", 3)} AS start_seconds,
                  CASE WHEN i = n - 1 THEN greatest(0.05, {rounded("duration_s - acc", 3)}) ELSE d0 END AS duration_seconds FROM w4),
    timed AS (SELECT *, {rounded("start_seconds + duration_seconds", 3)} AS end_seconds FROM w5)"""


@query("word_timestamps", f"WITH {_WORDS} SELECT * FROM timed", ["script"])
def word_timestamps(t: Inputs):
    return _timed(t)


def _vtt(sec: str) -> str:
    def two(x: str, n: int = 2) -> str:
        return f"lpad(CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR), {n}, '0')"

    return (
        f"{two(f'{sec} / 3600')} || ':' || {two(f'({sec}) % 3600 / 60')} || ':' || {two(f'({sec}) % 60')} || '.' || "
        f"{two(f'({sec}) % 1 * 1000', 3)}"
    )


@query(
    "webvtt_export",
    f"""WITH {_WORDS}, o AS (SELECT *, start_seconds + 3661.5::DOUBLE AS a, end_seconds + 3661.5::DOUBLE AS b FROM timed)
    SELECT doc_id, seg_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(CAST(word_idx + 1 AS VARCHAR) || chr(10) || {_vtt("a")}
             || ' --> ' || {_vtt("b")} || chr(10) || word || chr(10), chr(10) ORDER BY word_idx) AS vtt FROM o GROUP BY ALL""",
    ["script"],
)
def webvtt_export(t: Inputs):
    return TL.webvtt_export(_timed(t), offset=3661.5)


_PAGE = "'text/' || chapter_id || '.xhtml?a=1&amp;b=2'"


def _bare(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '[.]0$', '')"


@query(
    "smil_export",
    f"""WITH {_WORDS},
    n AS (SELECT t.*, s.chapter_id, row_number() OVER (PARTITION BY t.doc_id, s.chapter_id ORDER BY s.seg_idx, word_idx) AS k
          FROM timed t JOIN script s USING (doc_id, seg_id)),
    c AS (SELECT DISTINCT doc_id, chapter_id FROM script)
    SELECT doc_id, chapter_id, 0 AS part_no, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) ||
           '<smil xmlns="http://www.w3.org/ns/SMIL" xmlns:epub="http://www.idpf.org/2007/ops" version="3.0">' || chr(10) ||
           '  <body id="' || chapter_id || '_overlay">' || chr(10) || '    <seq id="' || chapter_id || '_seq" epub:textref="' || {_PAGE} || '">' AS smil
    FROM c
    UNION ALL
    SELECT doc_id, chapter_id, k, '      <par id="par_' || k || '">' || chr(10) || '        <text src="' || {_PAGE} || '#w_' || k || '"/>' || chr(10) ||
           '        <audio src="audio/' || chapter_id || '.mp3" clipBegin="' || {_bare("start_seconds")} || 's" clipEnd="' || {_bare("end_seconds")} ||
           's"/>' || chr(10) || '      </par>' FROM n
    UNION ALL
    SELECT doc_id, chapter_id, coalesce(max(k), 0) + 1, '    </seq>' || chr(10) || '  </body>' || chr(10) || '</smil>' || chr(10)
    FROM c LEFT JOIN n USING (doc_id, chapter_id) GROUP BY ALL""",
    ["script"],
)
def smil_export(t: Inputs):
    place = t.script.select("doc_id", "seg_id", "seg_idx", "chapter_id")
    timed = _timed(t).join(place, ["doc_id", "seg_id"])
    numbered = ordered.rerank(timed, ["doc_id", "chapter_id"], ["seg_idx", "word_idx"], "word_no")
    words_ = numbered.selectExpr("doc_id", "chapter_id", "word_no + 1 AS word_no", "start_seconds", "end_seconds")
    chapters = place.select("doc_id", "chapter_id").distinct().selectExpr(
        "*", "concat('text/', chapter_id, '.xhtml?a=1&b=2') AS xhtml_path", "concat('audio/', chapter_id, '.mp3') AS audio_path"
    )
    return TL.smil_export(words_, chapters)


_CHAPTERS = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chapter_id) - 1 AS INT) AS chapter_idx,
       CASE WHEN chapter_id = 'chapter_02' THEN '' ELSE chapter_id END AS title, sum(duration_s) / 7 AS start_seconds,
       CASE WHEN chapter_id = 'chapter_03' THEN 0.0 ELSE sum(duration_s) END AS end_seconds
FROM script GROUP BY doc_id, chapter_id"""


@query(
    "chapter_marker_export",
    f"""WITH c AS ({_CHAPTERS})
    SELECT doc_id, CAST(0 AS BIGINT) AS part_no, ';FFMETADATA1' || chr(10) || 'title=Book ' || doc_id || chr(10) || 'artist=Author'
             || chr(10) || 'album=Book ' || doc_id AS meta FROM books
    UNION ALL
    SELECT doc_id, CAST(chapter_idx + 1 AS BIGINT), chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START='
             || CAST(floor(start_seconds * 1000 + 0.5) AS BIGINT) || chr(10) || 'END='
             || CAST(floor(coalesce(nullif(end_seconds, 0), start_seconds) * 1000 + 0.5) AS BIGINT) || chr(10) || 'title='
             || coalesce(nullif(title, ''), 'Chapter ' || (chapter_idx + 1)) FROM c""",
    ["script", "books"],
)
def chapter_marker_export(t: Inputs):
    chapters = t.spark.sql(_CHAPTERS.replace("FROM script", "FROM {script}"), script=t.script)
    books = t.view("books").selectExpr("doc_id", "concat('Book ', doc_id) AS title", "'' AS author")
    return TL.chapter_marker_export(chapters, books)


# ---------------------------------------------------------------- books

# Chapters stand in the reverse order of their ids.
_POS = """
SELECT doc_id, chapter_id, 'T ' || chapter_id AS chapter_title,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chapter_id DESC) - 1 AS INT) AS chapter_pos
FROM (SELECT DISTINCT doc_id, chapter_id FROM script) q"""


@query(
    "master_timeline",
    f"""WITH c AS ({_POS})
    SELECT s.doc_id, s.seg_idx, s.chapter_id, c.chapter_title, c.chapter_pos,
           row_number() OVER (PARTITION BY s.doc_id ORDER BY chapter_pos, seg_idx) - 1 AS global_segment_index,
           row_number() OVER (PARTITION BY s.doc_id, chapter_pos ORDER BY seg_idx) = 1 AS is_chapter_start
    FROM script s JOIN c ON s.doc_id = c.doc_id AND s.chapter_id = c.chapter_id""",
    ["script"],
)
def master_timeline(t: Inputs):
    chapters = t.spark.sql(_POS.replace("FROM script", "FROM {script}"), script=t.script)
    return TL.master_timeline(chapters, t.script.select("doc_id", "seg_idx", "chapter_id"))


_EDIT = """
SELECT doc_id, seg_idx * 10 AS seg_idx, chapter_id, speaker, 'Rewritten. ' || text AS text FROM script
WHERE chapter_id = 'chapter_02' AND doc_id % 2 = 0"""
_UPSERTED = f"""
    edit AS ({_EDIT}),
    up AS (
      SELECT doc_id, seg_idx, chapter_id, speaker, text FROM script
      WHERE NOT EXISTS (SELECT 1 FROM edit e WHERE e.doc_id = script.doc_id AND e.chapter_id = script.chapter_id)
      UNION ALL SELECT * FROM edit)"""


def _upserted(t: Inputs):
    edit = t.spark.sql(_EDIT.replace("FROM script", "FROM {script}"), script=t.script)
    return TL.chapter_upsert(t.script.select("doc_id", "seg_idx", "chapter_id", "speaker", "text"), edit)


@query("chapter_upsert", f"WITH {_UPSERTED} SELECT * FROM up", ["script"])
def chapter_upsert(t: Inputs):
    return _upserted(t)


@query(
    "chapter_counts",
    f"""WITH {_UPSERTED} SELECT doc_id, chapter_id, count(*) AS segments, CAST(sum({words("text")}) AS BIGINT) AS word_count
    FROM up GROUP BY ALL""",
    ["script"],
)
def chapter_counts(t: Inputs):
    return TL.chapter_counts(_upserted(t))


_DONE = "CASE WHEN event_id % 5 = 0 THEN 'modified' WHEN event_id % 5 = 1 THEN 'accepted' END"
_DEFECT = "CASE event_id % 6 WHEN 0 THEN 'stt_mismatch' WHEN 1 THEN 'timbre_drift' WHEN 2 THEN 'pacing_anomaly' ELSE 'cross_character_conflict' END"


@query(
    "production_metrics",
    f"""
    WITH b AS (SELECT user_id AS doc_id, count(*) AS n, sum(value) AS s, count_if(event_id % 12 = 0) AS f,
                      count_if(event_type = 'view') * 3 AS t, count_if(event_type = 'click' AND event_id % 5 = 0) AS m,
                      count_if(event_type = 'click' AND event_id % 5 = 1) AS a,
                      {", ".join(f"count_if(event_type = 'error' AND {_DEFECT} = '{d}')::BIGINT AS {d}" for d in TL.DEFECTS)}
               FROM events GROUP BY user_id)
    SELECT doc_id, n AS total_segments, {rounded("s / 3600.0", 2)} AS runtime_hours,
           CASE WHEN s > 0 THEN {rounded(f"{rounded('f * 1.5', 1)} / (s / 3600.0)", 1)} ELSE 0.0 END AS review_minutes_per_hour,
           {rounded("f * 1.5", 1)} AS review_minutes, {rounded("f / n::DOUBLE * 100.0", 1)} AS flagged_pct,
           CASE WHEN m + a > 0 THEN {rounded("a / (m + a)::DOUBLE * 100.0", 1)} ELSE 0.0 END AS false_positive_pct,
           CASE WHEN t > n THEN {rounded("(t - n) / n::DOUBLE * 100.0", 1)} ELSE 0.0 END AS rerender_pct,
           {rounded("t / n::DOUBLE", 2)} AS takes_per_segment, {", ".join(TL.DEFECTS)} FROM b""",
)
def production_metrics(t: Inputs):
    e = t.table("events").withColumn("doc_id", F.col("user_id"))
    segments = e.selectExpr("doc_id", "value AS duration_s", "event_id % 12 = 0 AS is_flagged")
    takes = e.where("event_type = 'view'").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("take"))
    reviews = e.where("event_type = 'click'").selectExpr("doc_id", f"{_DONE} AS outcome")
    defects = e.where("event_type = 'error'").selectExpr("doc_id", f"{_DEFECT} AS defect")
    return TL.production_metrics(segments, takes, reviews, defects)


@query(
    "synthesis_progress",
    """SELECT doc_id, track, count(*) AS total, count(audio_path) AS completed,
              CAST(floor(count(audio_path) / count(*)::DOUBLE * 100) AS INT) AS progress_pct
       FROM (SELECT doc_id, CASE WHEN seg_idx % 2 = 0 THEN 'classic' ELSE 'directorial' END AS track, audio_path FROM script) q
       GROUP BY ALL""",
    ["script"],
)
def synthesis_progress(t: Inputs):
    rows = t.script.selectExpr(
        "doc_id", "CASE WHEN seg_idx % 2 = 0 THEN 'classic' ELSE 'directorial' END AS track", "audio_path"
    )
    return TL.synthesis_progress(rows)


