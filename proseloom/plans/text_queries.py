"""Queries over cleaning, splitting, segmentation and ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranges as RG
from ..operators import text as X
from ..sources import readers
from .inputs import Inputs
from .registry import SQL_WS, SQL_NON_WS, SQL_WS_INLINE, query, rounded

SP = "'" + T.SPACE_CHARS + "'"
BREAK = X.SCENE_BREAK.replace(T.WS, SQL_WS)


def words(col: str) -> str:
    return f"len(regexp_extract_all({col}, '{SQL_NON_WS}+'))"


# The cleaning steps in another dialect: replace-all flags, no lookaround.
def _clean_sql(col: str) -> str:
    steps = [
        ("\\r\\n?", "\n"),
        ("[“”„‟«»]", '"'),
        ("[‘’‚‛`´]", "''"),
        ("--{1,3}", "—"),
        ("[–―]", "—"),
        ("…", "..."),
        ("\\.{4,}", "..."),
        (f"(?i)\\[{SQL_WS}*(?:[0-9]+|note{SQL_WS}*[0-9]+){SQL_WS}*\\]", ""),
        ("([^\\n.!?\":;—…])\\n([a-zA-Z0-9\"''])", "\\1 \\2"),
        (f"(?m){SQL_WS_INLINE}+$", ""),
        ("\\n{3,}", "\n\n"),
    ]
    for pattern, new in steps:
        col = f"regexp_replace({col}, '{pattern}', '{new}', 'g')"
    return f"trim({col}, {SP})"


@query("load_manuscripts", "SELECT doc_id, lang, source, text FROM documents")
def load_manuscripts(t: Inputs):
    return readers.manuscripts_from_table(t.documents)


@query("sanitize_text", f"SELECT doc_id, {_clean_sql('text')} AS text FROM documents")
def sanitize_text(t: Inputs):
    return X.sanitize_text(t.documents.select("doc_id", "text"))


@query("normalize_british_quotes")
def normalize_british_quotes(t: Inputs):
    rows = t.view("prose").select("doc_id", "para_idx", F.translate("text", '"', "'").alias("text"))
    return X.normalize_british_quotes(rows, auto=True)


_UNWRAP = f"trim(replace(text, chr(13) || chr(10), chr(10)), {SP})"
for _p, _n in [("[ \\t]+\\n", "\n"), ("\\n[ \\t]+", "\n")]:
    _UNWRAP = f"regexp_replace({_UNWRAP}, '{_p}', '{_n}', 'g')"
# Pairs of newlines are set aside, single ones become spaces, then the pairs return.
_UNWRAP = f"replace({_UNWRAP}, chr(10) || chr(10), chr(30) || chr(30))"
_UNWRAP = f"replace({_UNWRAP}, chr(30) || chr(10), chr(30) || chr(30))"
_UNWRAP = f"replace(replace({_UNWRAP}, chr(10), ' '), chr(30), chr(10))"
_UNWRAP = f"regexp_replace({_UNWRAP}, ' {{2,}}', ' ', 'g')"


@query("unwrap_lines", f"SELECT doc_id, {_UNWRAP} AS text FROM documents")
def unwrap_lines(t: Inputs):
    return X.unwrap_lines(t.documents.select("doc_id", "text"))


@query(
    "word_char_counts",
    f"""SELECT doc_id, CAST({words('text')} AS BIGINT) AS word_count, CAST(length(text) AS BIGINT) AS character_count,
        {rounded(f"{words('text')} / 150.0", 1)} AS estimated_minutes FROM documents""",
)
def word_char_counts(t: Inputs):
    return X.word_char_counts(t.documents.select("doc_id", "text")).drop("text")


@query(
    "book_totals",
    f"""SELECT doc_id, count(*) AS chapters, CAST(sum(w) AS BIGINT) AS word_count,
               CAST(sum(length(text)) AS BIGINT) AS character_count,
               {rounded('sum(w) / 150.0', 1)} AS estimated_minutes
        FROM (SELECT conv_id AS doc_id, text, {words('text')} AS w FROM conversations) q GROUP BY doc_id""",
)
def book_totals(t: Inputs):
    rows = t.table("conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return X.book_totals(X.word_char_counts(rows))


_CUT = "chr(30) || '\\1' || chr(30) || '\\2' || chr(30)"


@query(
    "split_chapters",
    f"""
    WITH cut AS (
      SELECT doc_id, string_split(regexp_replace(trim(text, {SP}),
        '(?m)^((?:CHAPTER|Part) ([0-9]+|XIV)(?:: Turns)?)$', {_CUT}, 'g'), chr(30)) AS p FROM chaptered),
    rows AS (
      SELECT doc_id, 0 AS i, NULL AS head, NULL AS mark, trim(p[1], {SP}) AS raw, len(p) AS n FROM cut
      UNION ALL
      SELECT doc_id, i, p[3 * i - 1], p[3 * i], trim(p[3 * i + 1], {SP}), len(p)
      FROM (SELECT doc_id, p, unnest(range(1, CAST((len(p) - 1) / 3 AS INT) + 1)) AS i FROM cut) q),
    numbered AS (
      SELECT *, CASE WHEN i = 0 THEN CASE WHEN n = 1 THEN 1 ELSE 0 END
                     WHEN mark = 'XIV' THEN 14 ELSE CAST(mark AS INT) END AS num FROM rows
      WHERE i > 0 OR n = 1 OR length(raw) > 50),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id, num, i = 0 ORDER BY i) AS again,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM numbered)
    SELECT doc_id, CAST(pos AS INT) AS chapter_pos,
           'chapter_' || lpad(CAST(num AS VARCHAR), 2, '0') ||
             CASE WHEN again > 1 THEN '_' || CAST(again AS VARCHAR) ELSE '' END AS chapter_id,
           num AS chapter_number,
           CASE WHEN i > 0 THEN head WHEN n = 1 THEN 'Chapter 1' ELSE 'Prologue' END AS chapter_title,
           raw AS raw_text, CAST({words('raw')} AS BIGINT) AS word_count, CAST(length(raw) AS BIGINT) AS character_count,
           {rounded(f"{words('raw')} / 150.0", 1)} AS estimated_minutes
    FROM ranked""",
    ["chaptered"],
)
def split_chapters(t: Inputs):
    return X.split_chapters(t.view("chaptered"))


@query(
    "detect_chapters_by_line",
    f"""
    WITH cut AS (
      SELECT doc_id, text, string_split(regexp_replace(text,
        '(?m)^[ \\t]*((?:CHAPTER|Part) ([0-9]+|XIV)(?:: Turns)?)[ \\t]*$', {_CUT}, 'g'), chr(30)) AS p FROM chaptered),
    rows AS (
      SELECT doc_id, i, p[3 * i - 1] AS head, p[3 * i] AS mark, trim(p[3 * i + 1], {SP}) AS body
      FROM (SELECT doc_id, p, unnest(range(1, CAST((len(p) - 1) / 3 AS INT) + 1)) AS i FROM cut) q)
    SELECT doc_id, CAST(i AS INT) AS index,
           CASE WHEN head LIKE 'Part%' THEN 'Part XIV' ELSE 'Chapter ' || mark || ' — Turns' END AS title,
           head AS heading_line, body AS text, CAST({words('body')} AS BIGINT) AS word_count FROM rows
    UNION ALL
    SELECT doc_id, 1, 'Chapter 1 (Full Manuscript)', 'Chapter 1', trim(text, {SP}),
           CAST({words('text')} AS BIGINT) FROM cut WHERE len(p) = 1 AND trim(text, {SP}) <> ''""",
    ["chaptered"],
)
def detect_chapters_by_line(t: Inputs):
    return X.detect_chapters_by_line(t.view("chaptered"))


_SCENES = f"""
    lines AS (
      SELECT doc_id, para_idx, text, regexp_matches(text, '{BREAK}') AS brk FROM paras),
    marked AS (
      SELECT *, coalesce(lag(brk) OVER (PARTITION BY doc_id ORDER BY para_idx), TRUE) AS after_brk FROM lines),
    scenes AS (
      SELECT doc_id, para_idx, text, scene_id FROM (
        SELECT *, CAST(sum(CASE WHEN NOT brk AND after_brk THEN 1 ELSE 0 END)
          OVER (PARTITION BY doc_id ORDER BY para_idx) - 1 AS INT) AS scene_id FROM marked) q WHERE NOT brk)"""


@query(
    "split_paragraphs_scenes",
    f"""
    WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM chaptered),
    paras AS (
      SELECT doc_id, CAST(i - 1 AS INT) AS para_idx, p[i] AS text
      FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM cut) q),
    {_SCENES} SELECT doc_id, para_idx, text, scene_id FROM scenes""",
    ["chaptered"],
)
def split_paragraphs_scenes(t: Inputs):
    return X.split_paragraphs_scenes(t.view("chaptered"))


SENTENCES = f"""
    flat AS (SELECT doc_id, {_UNWRAP} AS text FROM documents),
    paras AS (
      SELECT doc_id, i AS pi, trim(p[i], {SP}) AS para
      FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
            FROM (SELECT doc_id, regexp_split_to_array(text, '\\n+') AS p FROM flat) a) b),
    cut AS (
      SELECT doc_id, pi, string_split(regexp_replace(para, '([.?!]["'']?){SQL_WS}+([A-Z0-9"''])',
        '\\1' || chr(30) || '\\2', 'g'), chr(30)) AS s FROM paras),
    sent AS (
      SELECT doc_id, pi, si, trim(s[si], {SP}) AS text
      FROM (SELECT doc_id, pi, s, unnest(range(1, len(s) + 1)) AS si FROM cut) q)"""


@query(
    "sentence_split",
    f"""WITH {SENTENCES}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) - 1 AS INT) AS seg_idx,
           'narrator' AS type, 'Narrator' AS speaker, text,
           'informative and technical narrator, steady pace' AS direction
    FROM sent WHERE text <> ''""",
)
def sentence_split(t: Inputs):
    return X.sentence_split(t.documents)


_PIECES = f"""
    p0 AS (SELECT doc_id, para_idx, trim(text, {SP}) AS para FROM prose),
    cut AS (
      SELECT doc_id, para_idx, para, string_split(regexp_replace(para, '("[^"]+")',
        chr(30) || '\\1' || chr(30), 'g'), chr(30)) AS s FROM p0 WHERE para <> ''),
    pieces AS (
      SELECT doc_id, para_idx, para, i, s[i] AS raw, i % 2 = 0 AS spoken,
             CAST(coalesce(sum(length(s[i])) OVER (PARTITION BY doc_id, para_idx ORDER BY i
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start
      FROM (SELECT doc_id, para_idx, para, s, unnest(range(1, len(s) + 1)) AS i FROM cut) q),
    kept AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY i) - 1 AS INT) AS piece_idx
      FROM pieces WHERE trim(raw, {SP}) <> ''),
    quoted AS (
      SELECT doc_id, para_idx, piece_idx, CASE WHEN spoken THEN 'dialogue' ELSE 'narrator' END AS type,
             CASE WHEN spoken THEN 'Character' ELSE 'Narrator' END AS speaker,
             CASE WHEN spoken THEN trim(substr(raw, 2, length(raw) - 2), {SP}) ELSE trim(raw, {SP}) END AS text,
             start,
             CASE WHEN spoken THEN trim(substr(para, greatest(start - 120, 0) + 1, least(start, 120)), {SP}) END
               AS preceding_context,
             CASE WHEN spoken THEN trim(substr(para, start + length(raw) + 1, 120), {SP}) END AS following_context
      FROM kept)"""


@query("segment_quoted", f"WITH {_PIECES} SELECT * FROM quoted", ["prose"])
def segment_quoted(t: Inputs):
    return X.segment_quoted(t.view("prose"))


@query("segment_unmarked")
def segment_unmarked(t: Inputs):
    return X.segment_unmarked(t.view("narration").withColumnRenamed("seg_idx", "para_idx"))


@query(
    "overlap_windows",
    # Window after window from the first sentence on.
    f"""
    WITH RECURSIVE sized AS (SELECT doc_id, text, {words("text")} AS n FROM documents),
    cut AS (
      SELECT doc_id, list_filter(string_split(CASE WHEN regexp_matches(text, '[.!?]({SQL_WS}|$)')
          THEN regexp_replace(text, '([.!?]{SQL_WS}+)', '\\1' || chr(57344), 'g')
          ELSE regexp_replace(text, '(\\n+)', '\\1' || chr(57344), 'g') END, chr(57344)), lambda x: x <> '') AS s
      FROM sized WHERE n > 1500),
    sent AS MATERIALIZED (
      SELECT *, {words("s")} AS w FROM (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS i FROM cut) q),
    points AS MATERIALIZED (
      SELECT doc_id, i, sum(w) OVER (PARTITION BY doc_id ORDER BY i) - w AS b FROM sent
      UNION ALL SELECT doc_id, count(*), sum(w) FROM sent GROUP BY doc_id),
    tops AS (SELECT doc_id, b, max(i) AS i FROM points GROUP BY ALL),
    lasts AS (SELECT doc_id, max(i) AS n FROM points GROUP BY ALL),
    hops AS (
      SELECT a.doc_id, a.i AS lo, greatest(a.i + 1, p.i) AS hi FROM points a ASOF JOIN tops p ON a.doc_id = p.doc_id AND p.b <= a.b + 1500),
    nexts AS MATERIALIZED (
      SELECT h.doc_id, h.lo, h.hi, greatest(coalesce(q.i, -1), h.lo + 1) AS nxt, l.n
      FROM (SELECT h.*, e.b - 150 AS x FROM hops h JOIN points e ON e.doc_id = h.doc_id AND e.i = h.hi) h
      JOIN lasts l ON l.doc_id = h.doc_id ASOF LEFT JOIN tops q ON q.doc_id = h.doc_id AND q.b <= h.x),
    walk AS (
      SELECT doc_id, 0 AS window_idx, CAST(0 AS BIGINT) AS lo FROM lasts
      UNION ALL
      SELECT w.doc_id, w.window_idx + 1, x.nxt FROM walk w JOIN nexts x ON x.doc_id = w.doc_id AND x.lo = w.lo WHERE x.hi < x.n)
    SELECT w.doc_id, w.window_idx, string_agg(s.s, '' ORDER BY s.i) AS text, sum(s.w)::BIGINT AS word_count
    FROM walk w JOIN nexts x ON x.doc_id = w.doc_id AND x.lo = w.lo JOIN sent s ON s.doc_id = w.doc_id AND s.i >= x.lo AND s.i < x.hi
    GROUP BY w.doc_id, w.window_idx
    UNION ALL SELECT doc_id, 0, coalesce(text, ''), coalesce(n, 0) FROM sized WHERE coalesce(n, 0) <= 1500""",
)
def overlap_windows(t: Inputs):
    return X.overlap_windows(t.documents)


@query(
    "fixed_chunks",
    """SELECT doc_id, CAST(start / 3500 AS INT) AS chunk_idx, CAST(start AS INT) AS start,
              substr(text, CAST(start AS INT) + 1, 3500) AS text
       FROM (SELECT doc_id, text, unnest(range(0, length(text), 3500)) AS start FROM documents WHERE text <> '') q""",
)
def fixed_chunks(t: Inputs):
    return X.fixed_chunks(t.documents)


def _mixed(t: Inputs):
    return t.view("prose").selectExpr(
        "doc_id", "para_idx AS seg_idx", "'dialogue' AS type", "'Ada' AS speaker", "text", "k"
    )


@query(
    "split_segments_at_quotes",
    f"""
    WITH src AS (
      SELECT doc_id, para_idx, k, text,
             string_split(regexp_replace(text, '("[^"]*")', chr(30) || '\\1' || chr(30), 'g'), chr(30)) AS s FROM prose),
    parts AS (
      SELECT *, list_filter(s, lambda x: trim(x, {SP}) <> '') AS p FROM src),
    rows AS (
      SELECT doc_id, para_idx, 1 AS i, 'dialogue' AS type, 'Ada' AS speaker, text FROM parts
      WHERE NOT (k <> 4 AND len(p) > 1)
      UNION ALL
      SELECT doc_id, para_idx, i, CASE WHEN spoken THEN 'dialogue' ELSE 'narrator' END,
             CASE WHEN spoken THEN 'Ada' ELSE 'Narrator' END,
             CASE WHEN spoken THEN trim(substr(part, 2, length(part) - 2), {SP}) ELSE part END
      FROM (SELECT *, part LIKE '"%' AND part LIKE '%"' AS spoken
            FROM (SELECT doc_id, para_idx, unnest(range(1, len(p) + 1)) AS i, trim(unnest(p), {SP}) AS part
                  FROM parts WHERE k <> 4 AND len(p) > 1) a) b)
    SELECT doc_id, para_idx AS seg_idx, type, speaker, text,
           row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, i) - 1 AS new_idx FROM rows""",
    ["prose"],
)
def split_segments_at_quotes(t: Inputs):
    rows = _mixed(t)
    return X.split_segments_at_quotes(rows.drop("k"), rows.where("k <> 4"))


@query(
    "merge_adjacent",
    f"""
    WITH asked AS (
      SELECT doc_id, seg_idx, type, speaker, text, (doc_id + seg_idx) % 4 = 1 AS up, (doc_id + seg_idx) % 5 = 2 AS down
      FROM script),
    linked AS (
      SELECT *, lag(seg_idx) OVER w IS NOT NULL AND (up OR lag(down) OVER w) AS lnk FROM asked
      WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx)),
    grp AS (
      SELECT *, sum(CASE WHEN lnk THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS g FROM linked)
    SELECT doc_id, min(seg_idx) AS seg_idx, arg_min(type, seg_idx) AS type, arg_min(speaker, seg_idx) AS speaker,
           CASE WHEN count(*) > 1 THEN string_agg(trim(text, {SP}), ' ' ORDER BY seg_idx)
                ELSE min(text) END AS text,
           CAST(g - 1 AS BIGINT) AS new_idx, count(*) AS merged_rows
    FROM grp GROUP BY doc_id, g""",
    ["script"],
)
def merge_adjacent(t: Inputs):
    rows = t.script.select("doc_id", "seg_idx", "type", "speaker", "text")
    up = rows.where("(doc_id + seg_idx) % 4 = 1").selectExpr("doc_id", "seg_idx", "'above' AS direction")
    down = rows.where("(doc_id + seg_idx) % 5 = 2").selectExpr("doc_id", "seg_idx", "'below' AS direction")
    return X.merge_adjacent(rows, up.unionByName(down))


@query(
    "insert_rows",
    """
    WITH rows AS (
      SELECT doc_id, seg_idx, 1 AS side, type, speaker, text, FALSE AS is_inserted FROM script
      UNION ALL SELECT doc_id, seg_idx, 0, 'narrator', 'Narrator', '', TRUE FROM script WHERE (doc_id + seg_idx) % 4 = 0
      UNION ALL SELECT doc_id, seg_idx, 2, 'narrator', 'Narrator', '', TRUE FROM script WHERE (doc_id + seg_idx) % 5 = 0)
    SELECT doc_id, seg_idx, type, speaker, text, is_inserted,
           row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx, side) - 1 AS new_idx FROM rows""",
    ["script"],
)
def insert_rows(t: Inputs):
    rows = t.script.select("doc_id", "seg_idx", "type", "speaker", "text")
    above = rows.where("(doc_id + seg_idx) % 4 = 0").selectExpr("doc_id", "seg_idx", "'above' AS direction")
    below = rows.where("(doc_id + seg_idx) % 5 = 0").selectExpr("doc_id", "seg_idx", "'below' AS direction")
    return X.insert_rows(rows, above.unionByName(below)).drop("direction")


@query(
    "locate_in_source",
    # Sentence by sentence from the search pointer on, over the text with white space squeezed.
    f"""WITH RECURSIVE {SENTENCES},
    segs AS MATERIALIZED (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) - 1 AS i,
             regexp_replace(text, '{SQL_WS}+', ' ', 'g') AS needle
      FROM sent WHERE text <> ''),
    hay AS MATERIALIZED (SELECT doc_id, trim(regexp_replace(text, '{SQL_WS}+', ' ', 'g')) AS hay FROM documents),
    walk AS (
      SELECT doc_id, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS pointer, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n FROM hay
      UNION ALL
      SELECT doc_id, i, CASE WHEN p > 0 THEN pointer + p - 1 + n ELSE pointer END,
             CASE WHEN p > 0 THEN pointer + p - 1 ELSE strpos(hay, needle) - 1 END, n
      FROM (SELECT w.doc_id, s.i, w.pointer, s.needle, h.hay, length(s.needle) AS n, strpos(substr(h.hay, w.pointer + 1), s.needle) AS p
            FROM walk w JOIN segs s ON s.doc_id = w.doc_id AND s.i = w.i + 1 JOIN hay h ON h.doc_id = w.doc_id) q),
    toks AS MATERIALIZED (
      SELECT doc_id, k, t, ltrim(t, {SP}) AS w
      FROM (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS k
            FROM (SELECT doc_id, regexp_extract_all(text, '{SQL_WS}*{SQL_NON_WS}+') AS t FROM documents) a) b),
    words AS MATERIALIZED (
      SELECT doc_id, sum(length(t)) OVER o - length(w) AS src, sum(length(w) + 1) OVER o - length(w) - 1 AS flat
      FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
    first AS (
      SELECT w.doc_id, w.i, w.pos, w.n, x.src + w.pos - x.flat AS start
      FROM walk w ASOF JOIN words x ON w.doc_id = x.doc_id AND x.flat <= w.pos WHERE w.i >= 0 AND w.pos >= 0)
    SELECT f.doc_id, CAST(f.i AS INT) AS seg_idx, CAST(f.start AS INT) AS start, CAST(x.src + f.pos + f.n - x.flat AS INT) AS "end"
    FROM first f ASOF JOIN words x ON f.doc_id = x.doc_id AND x.flat <= f.pos + f.n - 1
    UNION ALL SELECT doc_id, CAST(i AS INT), -1, -1 FROM walk WHERE i >= 0 AND pos < 0""",
)
def locate_in_source(t: Inputs):
    docs = t.documents.select("doc_id", "text")
    sentences = X.sentence_split(docs).select("doc_id", "seg_idx", "text")
    return RG.locate_in_passages(sentences, docs, ("doc_id",), ("doc_id",), exact=False, fallback=True)


@query(
    "align_by_overlap",
    """
    WITH a AS (SELECT doc_id, idx, lo AS s, hi AS e FROM ranges_a),
    b AS (SELECT doc_id, idx, lo AS s, hi AS e FROM ranges_b WHERE lo <> -1),
    hits AS (
      SELECT a.doc_id, a.idx, b.idx AS match_idx, least(a.e, b.e) - greatest(a.s, b.s) AS overlap
      FROM a JOIN b ON a.doc_id = b.doc_id AND least(a.e, b.e) > greatest(a.s, b.s)),
    best AS (
      SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY overlap DESC, match_idx) = 1),
    lost AS (SELECT a.* FROM a LEFT JOIN best USING (doc_id, idx) WHERE match_idx IS NULL),
    near AS (
      SELECT lost.doc_id, lost.idx, b.idx AS match_idx FROM lost LEFT JOIN b ON lost.doc_id = b.doc_id
      QUALIFY row_number() OVER (PARTITION BY lost.doc_id, lost.idx ORDER BY abs(b.s - lost.s), b.idx) = 1)
    SELECT doc_id, idx, match_idx, CAST(overlap AS INT) AS overlap FROM best
    UNION ALL SELECT doc_id, idx, coalesce(match_idx, -1), 0 FROM near""",
    ["ranges_a", "ranges_b"],
)
def align_by_overlap(t: Inputs):
    a, b = (
        t.view(v).withColumnsRenamed({"lo": "start", "hi": "end"}) for v in ("ranges_a", "ranges_b")
    )
    return RG.align_by_overlap(a, b)
