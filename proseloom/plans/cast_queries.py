"""Queries over casts, attribution and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import attribution as A
from ..operators import cast as C
from ..operators import ordered
from ..operators import relations as R
from ..operators import text as X
from .inputs import Inputs, given_name, name
from .registry import SQL_SPACE, SQL_WS, query, rounded
from .text_queries import _SCENES, SP

# ---------------------------------------------------------------- names


def _key(col: str) -> str:
    """Alias key of a name in the checking dialect."""
    low = f"replace(replace(lower(coalesce({col}, '')), '’', ''), '''', '')"
    return (
        f"trim(regexp_replace(regexp_replace({low}, '[^A-Za-z0-9_{SQL_SPACE}]', ' ', 'g'), '{SQL_WS}+', ' ', 'g'), {SP})"
    )


_INDEX = f"""
    spelled AS (
      SELECT doc_id, ord, name, unnest([name, split_part(name, ' ', 1), split_part(name, ' ', 2), alias]) AS a
      FROM people),
    idx AS (
      SELECT doc_id, {_key("a")} AS alias_key, arg_max(name, ord) AS canonical
      FROM spelled WHERE a IS NOT NULL GROUP BY ALL)"""


@query("alias_index", f"WITH {_INDEX} SELECT * FROM idx", ["people"])
def alias_index(t: Inputs):
    return C.alias_index(t.people)


# Speakers written in many ways: full, with a title, first name only, by alias, unknown.
_SPELLED = f"""
SELECT doc_id, seg_idx,
       CASE (doc_id + seg_idx) % 6
         WHEN 0 THEN ' ' || {name("doc_id", "0")}
         WHEN 1 THEN 'Mrs. ' || split_part({name("doc_id", "1")}, ' ', 2)
         WHEN 2 THEN upper({given_name("doc_id", "2")})
         WHEN 3 THEN 'The Captain!'
         WHEN 4 THEN 'Passer-by ' || CAST(seg_idx AS STRING) END AS speaker
FROM script"""
_TITLES = "|".join(h for h in C.HONORIFICS if "." not in h)


@query(
    "resolve_alias",
    f"""
    WITH {_INDEX}, spoken AS ({_SPELLED}),
    keyed AS (SELECT *, {_key("speaker")} AS k FROM spoken)
    SELECT s.doc_id, s.seg_idx, s.speaker,
           CASE WHEN coalesce(s.speaker, '') = '' THEN 'unknown'
                ELSE coalesce(a.canonical, b.canonical, trim(s.speaker, {SP})) END AS resolved_speaker
    FROM keyed s LEFT JOIN idx a ON a.doc_id = s.doc_id AND a.alias_key = s.k
    LEFT JOIN idx b ON b.doc_id = s.doc_id AND b.alias_key = regexp_replace(s.k, '^(?:{_TITLES}) ', '')""",
    ["script", "people"],
)
def resolve_alias(t: Inputs):
    spoken = t.spark.sql(_SPELLED.replace("FROM script", "FROM {script}"), script=t.script)
    return C.resolve_alias(spoken, C.alias_index(t.people))


# Prose in which titles stand before surnames.
_TITLED = f"""
SELECT doc_id, para_idx, 'Then Dr. ' || split_part({name("doc_id", "para_idx % 4")}, ' ', 2) || '''s friend, captain '
       || upper(split_part({name("doc_id", "para_idx % 3")}, ' ', 2)) || ', saw Miss '
       || split_part({name("doc_id", "0")}, ' ', 2) || 'er and sir  ' || split_part({name("doc_id", "1")}, ' ', 2)
       || '. ' || text AS text
FROM prose"""
_HONORIFICS = ", ".join(f"('{h}')" for h in C.HONORIFICS)


@query(
    "discover_aliases",
    f"""
    WITH titled AS ({_TITLED}), hon(h) AS (VALUES {_HONORIFICS}),
    counted AS (
      SELECT p.doc_id, p.name AS canonical_name,
             upper(substr(h, 1, 1)) || substr(h, 2) || ' ' || split_part(p.name, ' ', 2) AS suggested_alias,
             CAST(sum(len(regexp_extract_all(t.text, '(?i)\\b' || replace(h, '.', '\\.') || '{SQL_WS}+'
               || split_part(p.name, ' ', 2) || '\\b'))) AS BIGINT) AS occurrence_count
      FROM people p CROSS JOIN hon JOIN titled t ON t.doc_id = p.doc_id GROUP BY ALL)
    SELECT * FROM counted WHERE occurrence_count > 0""",
    ["people", "prose"],
)
def discover_aliases(t: Inputs):
    titled = t.spark.sql(_TITLED.replace("FROM prose", "FROM {prose}"), prose=t.view("prose"))
    return C.discover_aliases(titled, t.people)


_SHORT = f"""
SELECT doc_id, CASE seg_idx % 5 WHEN 0 THEN {given_name("doc_id", "1")}
                                WHEN 1 THEN 'Mr ' || split_part({name("doc_id", "2")}, ' ', 2)
                                WHEN 2 THEN 'Unknown' WHEN 3 THEN 'The Stranger'
                                ELSE {given_name("doc_id", "3")} || '-' || {given_name("doc_id", "0")} END AS name
FROM script"""
_IGNORED = ", ".join(f"'{w}'" for w in C.TITLE_WORDS)


@query(
    "merge_cast_names",
    f"""
    WITH asked AS (SELECT DISTINCT * FROM ({_SHORT}) q),
    aw AS (SELECT doc_id, name, unnest(regexp_split_to_array(lower(name), '[{SQL_SPACE}-]+')) AS w FROM asked
           WHERE name NOT IN ('Narrator', 'Unknown')),
    pw AS (SELECT doc_id, ord, name AS cast_name, unnest(regexp_split_to_array(lower(name), '[{SQL_SPACE}-]+')) AS w
           FROM people),
    folded AS (
      SELECT aw.doc_id, aw.name, arg_min(cast_name, ord) AS m FROM aw JOIN pw ON aw.doc_id = pw.doc_id AND aw.w = pw.w
      WHERE aw.w NOT IN ({_IGNORED}) AND aw.w <> '' GROUP BY ALL)
    SELECT asked.doc_id, asked.name, coalesce(m, asked.name) AS merged_name
    FROM asked LEFT JOIN folded ON asked.doc_id = folded.doc_id AND asked.name = folded.name""",
    ["script", "people"],
)
def merge_cast_names(t: Inputs):
    names = t.spark.sql(_SHORT.replace("FROM script", "FROM {script}"), script=t.script)
    return C.merge_cast_names(names, t.people)


@query("merge_cast_profiles")
def merge_cast_profiles(t: Inputs):
    found = t.spark.sql(
        _SHORT.replace("SELECT doc_id,", "SELECT doc_id, seg_idx AS ord,").replace("FROM script", "FROM {script}"),
        script=t.script,
    ).selectExpr(
        "*", "CASE WHEN ord % 2 = 0 THEN 'A young woman, female, low' ELSE 'an old male voice' END AS voice_profile",
        "'' AS base_voice", "CAST(NULL AS STRING) AS gender", "'' AS implied_age",
        "CASE WHEN ord % 3 = 0 THEN 'curious; brave' ELSE '' END AS personality_traits",
    )
    return C.merge_cast_profiles(t.people, found)


_PARAS = "paras AS (SELECT doc_id, para_idx, text FROM prose)"
_PRESENT = f"""
    {_PARAS}, {_SCENES},
    whole AS (SELECT doc_id, scene_id, string_agg(text, chr(10) ORDER BY para_idx) AS body FROM scenes GROUP BY ALL),
    named AS (
      SELECT w.doc_id, w.scene_id, p.char_id FROM whole w JOIN people p ON w.doc_id = p.doc_id
      WHERE p.always_present OR regexp_matches(w.body, '(?i)\\b(?:' || p.name || coalesce('|' || p.alias, '') || ')\\b')),
    sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, scene_id) AS n FROM named),
    present AS (
      SELECT doc_id, scene_id, char_id, TRUE AS is_named FROM sized WHERE n >= 2
      UNION ALL
      SELECT w.doc_id, w.scene_id, p.char_id, FALSE FROM whole w JOIN people p ON w.doc_id = p.doc_id
      WHERE NOT EXISTS (SELECT 1 FROM sized s WHERE s.doc_id = w.doc_id AND s.scene_id = w.scene_id AND s.n >= 2))"""


def _scenes(t: Inputs):
    return X.assign_scenes(t.view("prose").select("doc_id", "para_idx", "text"))


@query("scene_cast", f"WITH {_PRESENT} SELECT * FROM present", ["prose", "people"])
def scene_cast(t: Inputs):
    return C.scene_cast(_scenes(t), t.people)


@query(
    "scene_cast_counts",
    f"""WITH {_PARAS}, {_SCENES}
    SELECT s.doc_id, s.scene_id, p.char_id, count(*) AS paragraphs FROM scenes s JOIN people p ON s.doc_id = p.doc_id
    WHERE regexp_matches(s.text, '(?i)\\b(?:' || p.name || coalesce('|' || p.alias, '') || ')\\b') GROUP BY ALL""",
    ["prose", "people"],
)
def scene_cast_counts(t: Inputs):
    return C.scene_cast_counts(_scenes(t), t.people)


@query(
    "autocast",
    f"""
    WITH s AS (SELECT DISTINCT doc_id, speaker AS name FROM script WHERE speaker NOT IN ('', 'Narrator'))
    SELECT doc_id, name, 'default' AS model, 'auto' AS gender,
           abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 90000 + 10000 AS seed,
           1.0::DOUBLE AS speed, 0 AS pitch
    FROM (SELECT *, list_reduce(list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT)),
                                lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h
          FROM s ANTI JOIN people USING (doc_id, name)) q""",
    ["script", "people"],
)
def autocast(t: Inputs):
    return C.autocast(t.script, t.people)


@query(
    "deterministic_seed",
    """
    SELECT doc_id, seg_idx, h AS name_hash, abs(h) % 90000 + 10000 AS seed FROM (
      SELECT doc_id, seg_idx, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM (
        SELECT doc_id, seg_idx, list_reduce(list_transform(string_split(substr(text, 1, 1) || speaker || seg_id, ''),
                 lambda c: CAST(ord(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h
        FROM script) a) b""",
    ["script"],
)
def deterministic_seed(t: Inputs):
    label = F.concat(F.substring("text", 1, 1), "speaker", "seg_id")
    return t.script.select(
        "doc_id", "seg_idx", H.name_hash(label).alias("name_hash"), H.name_seed(label).alias("seed")
    )


# ---------------------------------------------------------------- rules

_VERB = A.VERBS
_MASK = f"""
    masked AS (
      SELECT s.doc_id, s.span_id, s.start, length(s.text) AS n, c.scene_id,
             array_to_string(list_transform(string_split(regexp_replace(c.text, '(["“][^"“”]*["”])',
               chr(30) || '\\1' || chr(30), 'g'), chr(30)),
               lambda x, i: CASE WHEN i % 2 = 0 THEN repeat(' ', length(x)) ELSE x END), '') AS m
      FROM spans s JOIN scenes c ON s.doc_id = c.doc_id AND s.para_idx = c.para_idx),
    sides AS (
      SELECT doc_id, span_id, scene_id, regexp_extract(substr(m, start + n + 1, 80), '^[^.!?]*') AS aft,
             regexp_extract(substr(m, greatest(start - 80, 0) + 1, least(start, 80)), '[^.!?]*$') AS bef
      FROM masked)"""
_TAG_RE = (
    f"'(?i)\\b(?:' || names || ')\\W+(?:\\w+ly\\s+)?(?:{_VERB})\\b|\\b(?:{_VERB})\\W+(?:' || names || ')\\b'"
)


def _spans(t: Inputs):
    return t.view("spans")


def _placed(t: Inputs):
    return _spans(t).join(_scenes(t).select("doc_id", "para_idx", "scene_id"), ["doc_id", "para_idx"])


_NAMES = "p.name || coalesce('|' || p.alias, '')"


@query(
    "rule_tag",
    f"""
    WITH {_PRESENT}, {_MASK},
    hits AS (
      SELECT s.doc_id, s.span_id, c.char_id FROM sides s
      JOIN present c ON s.doc_id = c.doc_id AND s.scene_id = c.scene_id
      JOIN (SELECT doc_id, char_id, {_NAMES} AS names FROM people p) p
        ON p.doc_id = c.doc_id AND p.char_id = c.char_id
      WHERE regexp_matches(aft, {_TAG_RE}) OR regexp_matches(bef, {_TAG_RE}))
    SELECT doc_id, span_id, min(char_id) AS speaker, 'tag' AS evidence, 0.95::DOUBLE AS confidence
    FROM hits GROUP BY ALL HAVING count(DISTINCT char_id) = 1""",
    ["prose", "people", "spans"],
)
def rule_tag(t: Inputs):
    scenes = _scenes(t)
    return A.rule_tag(_spans(t), scenes, C.scene_cast(scenes, t.people), t.people)


def _count(mark: str) -> str:
    return f"(length(b) - length(replace(b, '{mark}', '')))"


@query(
    "rule_monologue",
    f"""
    SELECT doc_id, para_idx, coalesce(({_count("“")} > {_count("”")} OR {_count('"')} % 2 = 1)
             AND regexp_matches(text, '^{SQL_WS}*["“]'), FALSE) AS continues
    FROM (SELECT doc_id, para_idx, text, lag(text) OVER (PARTITION BY doc_id ORDER BY para_idx) AS b FROM prose) q""",
    ["prose"],
)
def rule_monologue(t: Inputs):
    rows = t.view("prose").select("doc_id", "para_idx", "text")
    return A.rule_monologue(rows).select("doc_id", "para_idx", "continues")


_VOC = f"""
    voc AS (
      SELECT s.doc_id, s.span_id, c.char_id AS listener FROM spans s
      JOIN scenes sc ON s.doc_id = sc.doc_id AND s.para_idx = sc.para_idx
      JOIN present c ON c.doc_id = s.doc_id AND c.scene_id = sc.scene_id
      JOIN (SELECT doc_id, char_id, {_NAMES} AS names FROM people p) p ON p.doc_id = c.doc_id AND p.char_id = c.char_id
      WHERE regexp_matches(s.text,
        '(?i)^{SQL_WS}*(?:' || names || '){SQL_WS}*[,!:]|,{SQL_WS}*(?:' || names || '){SQL_WS}*[.!?]*{SQL_WS}*$'))"""


@query(
    "rule_vocative", f"WITH {_PRESENT}, {_VOC} SELECT * FROM voc", ["prose", "people", "spans"]
)
def rule_vocative(t: Inputs):
    return A.rule_vocative(_placed(t), C.scene_cast(_scenes(t), t.people), t.people)


@query(
    "context_window",
    f"""
    WITH {_PARAS}, {_SCENES},
    pointed AS (
      SELECT s.doc_id, c.scene_id, s.span_id, s.para_idx,
             substr(c.text, 1, s.start) || '[[LINE ' || s.span_id || ']]' || s.text || '[[/LINE]]'
               || substr(c.text, s.start + length(s.text) + 1) AS line
      FROM spans s JOIN scenes c ON s.doc_id = c.doc_id AND s.para_idx = c.para_idx)
    SELECT m.doc_id, m.scene_id, m.span_id,
           string_agg(CASE WHEN c.para_idx = m.para_idx THEN m.line ELSE c.text END, chr(10) || chr(10)
                      ORDER BY c.para_idx) AS context,
           'Which character speaks the line marked [[LINE ' || m.span_id || ']]?' AS question
    FROM pointed m JOIN scenes c ON c.doc_id = m.doc_id AND c.scene_id = m.scene_id
      AND c.para_idx BETWEEN m.para_idx - 3 AND m.para_idx + 1
    GROUP BY ALL""",
    ["prose", "spans"],
)
def context_window(t: Inputs):
    return A.context_window(_spans(t), _scenes(t))


# ---------------------------------------------------------------- scores

_RUNS = """
    clipped AS (SELECT * REPLACE (greatest(score, 0) AS score) FROM scores),
    runs AS (
      SELECT * REPLACE (CASE WHEN sum(score) OVER w = 0 THEN 1.0 / count(*) OVER w
                             ELSE score / sum(score) OVER w END AS score)
      FROM clipped WINDOW w AS (PARTITION BY doc_id, span_id, adapter, ordering))"""
_MEANS = f"""
    {_RUNS},
    mean AS (SELECT doc_id, span_id, adapter, option_id, option_ord, avg(score) AS score FROM runs GROUP BY ALL),
    best AS (SELECT doc_id, span_id, adapter, option_id AS top FROM mean
             QUALIFY row_number() OVER (PARTITION BY doc_id, span_id, adapter ORDER BY score DESC, option_ord) = 1),
    tops AS (SELECT doc_id, span_id, adapter, ordering, option_id AS top FROM runs
             QUALIFY row_number() OVER (PARTITION BY doc_id, span_id, adapter, ordering
                                        ORDER BY score DESC, option_ord) = 1),
    steady AS (SELECT doc_id, span_id, adapter, count(DISTINCT top) = 1 AS stable FROM tops GROUP BY ALL),
    debiased AS (SELECT * FROM mean JOIN best USING (doc_id, span_id, adapter)
                 JOIN steady USING (doc_id, span_id, adapter))"""
_HINT = """
    hint AS (SELECT doc_id, span_id, 'c' || CAST((doc_id + para_idx) % 4 AS STRING) AS hint FROM spans
             WHERE para_idx % 2 = 1)"""
_ENSEMBLE = f"""
    {_MEANS}, {_HINT},
    joined AS (
      SELECT d.doc_id, d.span_id, d.option_id, d.option_ord, avg(score) AS score FROM debiased d GROUP BY ALL),
    nudged AS (
      SELECT j.doc_id, j.span_id, j.option_id, j.option_ord,
             CASE WHEN v.listener IS NULL THEN score ELSE greatest(score - 0.15, 0) END
               + CASE WHEN h.hint IS NULL THEN 0 ELSE 0.10 END AS score
      FROM joined j LEFT JOIN voc v ON v.doc_id = j.doc_id AND v.span_id = j.span_id AND v.listener = j.option_id
      LEFT JOIN hint h ON h.doc_id = j.doc_id AND h.span_id = j.span_id AND h.hint = j.option_id),
    flags AS (
      SELECT doc_id, span_id, count(DISTINCT top) = 1 AS agree, bool_and(stable) AS stable,
             count(DISTINCT adapter) AS adapters FROM debiased GROUP BY ALL),
    ensemble AS (
      SELECT n.doc_id, n.span_id, n.option_id, n.option_ord,
             CASE WHEN sum(score) OVER w = 0 THEN 1.0 / count(*) OVER w ELSE score / sum(score) OVER w END AS score,
             agree, stable, adapters
      FROM nudged n JOIN flags f ON n.doc_id = f.doc_id AND n.span_id = f.span_id
      WINDOW w AS (PARTITION BY n.doc_id, n.span_id))"""


@query(
    "normalize_scores",
    f"""WITH {_RUNS} SELECT doc_id, span_id, adapter, ordering, option_id, option_ord,
        {rounded("score", 6)} AS score FROM runs""",
    ["scores"],
)
def normalize_scores(t: Inputs):
    return A.normalize_scores(t.view("scores")).withColumn("score", F.round("score", 6))


@query(
    "debias_orderings",
    f"""WITH {_MEANS} SELECT doc_id, span_id, adapter, option_id, option_ord,
        {rounded("score", 6)} AS score, top, stable FROM debiased""",
    ["scores"],
)
def debias_orderings(t: Inputs):
    return A.debias_orderings(A.normalize_scores(t.view("scores"))).withColumn("score", F.round("score", 6))


def _ensemble(t: Inputs):
    scenes = _scenes(t)
    vocative = A.rule_vocative(_placed(t), C.scene_cast(scenes, t.people), t.people)
    hint = _spans(t).where("para_idx % 2 = 1").selectExpr(
        "doc_id", "span_id", "concat('c', cast((doc_id + para_idx) % 4 AS string)) AS hint"
    )
    debiased = A.debias_orderings(A.normalize_scores(t.view("scores")))
    return A.ensemble_scores(debiased, vocative, hint)


@query(
    "ensemble_scores",
    f"""WITH {_PRESENT}, {_VOC}, {_ENSEMBLE}
    SELECT doc_id, span_id, option_id, option_ord, {rounded("score", 6)} AS score, agree, stable, adapters
    FROM ensemble""",
    ["scores", "prose", "people", "spans"],
)
def ensemble_scores(t: Inputs):
    return _ensemble(t).withColumn("score", F.round("score", 6))


_DECIDED = f"""
    {_PRESENT}, {_VOC}, {_ENSEMBLE},
    ranked AS (
      SELECT *, row_number() OVER w AS r, score - coalesce(lead(score) OVER w, 0) AS gap FROM ensemble
      WINDOW w AS (PARTITION BY doc_id, span_id ORDER BY score DESC, option_ord)),
    three AS (SELECT doc_id, span_id, string_agg(option_id, ',' ORDER BY r) AS candidates FROM ranked WHERE r <= 3
              GROUP BY ALL),
    top AS (
      SELECT *, agree AND stable AND option_id <> 'unknown' AND score >= 0.60 AND gap >= 0.25 AS clean,
             CASE WHEN (',' || candidates || ',unknown,') LIKE '%,' || choice || ',%' THEN choice END AS ok_choice
      FROM ranked JOIN three USING (doc_id, span_id)
      LEFT JOIN (SELECT doc_id, span_id, CASE WHEN para_idx % 3 = 0 THEN 'c1' ELSE 'nobody' END AS choice FROM spans
                 WHERE para_idx % 2 = 0) f USING (doc_id, span_id)
      WHERE r = 1),
    decided AS (
      SELECT doc_id, span_id,
             CASE WHEN clean THEN option_id WHEN ok_choice IS NOT NULL THEN ok_choice
                  WHEN option_id <> 'unknown' AND score >= 0.35 THEN option_id ELSE 'unknown' END AS speaker,
             CASE WHEN clean THEN 'classifier_agree' WHEN ok_choice IS NOT NULL THEN 'llm'
                  ELSE 'classifier_uncertain' END AS evidence,
             {rounded("score", 3)} AS confidence, {rounded("gap", 6)} AS gap, NOT clean AS needs_review, candidates
      FROM top)"""
_ALL = ["scores", "prose", "people", "spans"]


def _decided(t: Inputs):
    fallback = _spans(t).where("para_idx % 2 = 0").selectExpr(
        "doc_id", "span_id", "CASE WHEN para_idx % 3 = 0 THEN 'c1' ELSE 'nobody' END AS choice"
    )
    made = A.decide_speaker(_ensemble(t), fallback).drop("candidate_scores")
    return made.withColumn("candidates", F.array_join("candidates", ","))


@query("decide_speaker", f"WITH {_DECIDED} SELECT * FROM decided", _ALL)
def decide_speaker(t: Inputs):
    return _decided(t)


@query("attribution_review_queue", f"WITH {_DECIDED} SELECT * FROM decided WHERE needs_review", _ALL)
def attribution_review_queue(t: Inputs):
    return A.attribution_review_queue(_decided(t))


def _reference(t: Inputs):
    return t.script.selectExpr(
        "doc_id", "seg_idx", "concat('sp_', cast(seg_idx AS string)) AS seg_id", "text",
        "concat('c', cast((doc_id + seg_idx * 3) % 3 AS string)) AS speaker", "is_user_locked",
    )


@query("attribute_dialogue")
def attribute_dialogue(t: Inputs):
    prose = t.view("prose").select("doc_id", "para_idx", "text")
    return A.attribute_dialogue(_spans(t), prose, t.people, t.view("scores"), _reference(t))


@query("rule_attribution_lite")
def rule_attribution_lite(t: Inputs):
    pieces = X.segment_quoted(t.view("prose")).where("type = 'dialogue'")
    quotes = ordered.rerank(pieces, ["doc_id"], ["para_idx", "piece_idx"], "seg_idx")
    scores = quotes.where("seg_idx % 7 = 0").selectExpr(
        "doc_id", "seg_idx", "'c2' AS choice", "0.8D AS choice_conf"
    )
    return A.rule_attribution_lite(quotes, t.people, scores)


_TAGGED = f"""
SELECT doc_id, para_idx AS ord, CASE WHEN k = 5 THEN 'narrator' ELSE 'dialogue' END AS type,
       CASE WHEN k = 1 THEN 'said ' || {name("doc_id", "2")}
            WHEN k = 3 THEN {name("doc_id", "1")} || ' asked ' || {name("doc_id", "3")}
            WHEN k = 6 THEN 'she said' ELSE '' END AS tag
FROM prose"""


@query(
    "alternation_baseline",
    f"""
    WITH tagged AS ({_TAGGED}),
    d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS n FROM tagged WHERE type = 'dialogue'),
    r AS (SELECT d.doc_id, d.ord, min(p.ord) AS reset FROM d JOIN people p ON d.doc_id = p.doc_id
          WHERE contains(lower(d.tag), lower(p.name)) GROUP BY ALL),
    s AS (
      SELECT d.doc_id, d.ord, d.n, max(CASE WHEN reset IS NOT NULL THEN n END)
               OVER (PARTITION BY d.doc_id ORDER BY d.ord) AS n0
      FROM d LEFT JOIN r ON d.doc_id = r.doc_id AND d.ord = r.ord)
    SELECT s.doc_id, s.ord, p.name AS speaker FROM s
    LEFT JOIN (SELECT d.doc_id, d.n, r.reset FROM d JOIN r ON d.doc_id = r.doc_id AND d.ord = r.ord) b
      ON b.doc_id = s.doc_id AND b.n = s.n0
    JOIN people p ON p.doc_id = s.doc_id AND p.ord = (coalesce(b.reset, 0) + s.n - coalesce(s.n0, 0)) % 4""",
    ["prose", "people"],
)
def alternation_baseline(t: Inputs):
    tagged = t.spark.sql(_TAGGED.replace("FROM prose", "FROM {prose}"), prose=t.view("prose"))
    return A.alternation_baseline(tagged, t.people)


_ANSWERS = """
SELECT doc_id, span_id, 'c' || CAST((doc_id + para_idx * {k}) % 4 AS STRING) AS choice,
       CAST((doc_id * 7 + para_idx * {k} * 13) % 100 AS DOUBLE) / 100 AS confidence FROM spans"""


@query(
    "cascade_routing",
    f"""
    WITH a AS ({_ANSWERS.format(k=1)}), b AS ({_ANSWERS.format(k=3)})
    SELECT doc_id, span_id, CASE WHEN up THEN b.choice ELSE a.choice END AS choice,
           CASE WHEN up THEN b.confidence ELSE a.confidence END AS confidence,
           CASE WHEN up THEN 'second' ELSE 'first' END AS source, a.confidence < 0.85 AS escalated,
           CASE WHEN up THEN b.confidence ELSE a.confidence END < 0.55 AS is_ambiguous
    FROM (SELECT a.doc_id, a.span_id, a, b, a.confidence < 0.85 AND b.confidence > a.confidence AS up
          FROM a JOIN b ON a.doc_id = b.doc_id AND a.span_id = b.span_id) q""",
    ["spans"],
)
def cascade_routing(t: Inputs):
    a, b = (
        t.spark.sql(_ANSWERS.format(k=k).replace("FROM spans", "FROM {spans}"), spans=_spans(t)) for k in (1, 3)
    )
    return A.cascade_routing(a, b)


# ---------------------------------------------------------------- previous results

# The same lines attributed anew: every third id is lost, so text has to match.
_NEW = f"""
SELECT doc_id, seg_idx, CASE WHEN seg_idx % 3 = 2 THEN 'new_' || seg_id ELSE seg_id END AS span_id,
       ' ' || text AS text, {name("doc_id", "(seg_idx + 1) % 3")} AS speaker,
       CAST((doc_id + seg_idx * 7) % 100 AS DOUBLE) / 100 AS confidence, 'rules' AS engine
FROM script"""


def _new(t: Inputs):
    return t.spark.sql(_NEW.replace("FROM script", "FROM {script}"), script=t.script)


_DIFFED = f"""
    fresh AS ({_NEW}),
    m AS (
      SELECT n.doc_id, n.span_id, p.speaker AS old, p.is_user_locked AS lk, p.seg_idx AS pi
      FROM fresh n JOIN script p ON n.doc_id = p.doc_id
        AND (n.span_id = p.seg_id OR trim(n.text, {SP}) = trim(p.text, {SP}))
      QUALIFY row_number() OVER (PARTITION BY n.doc_id, n.span_id ORDER BY p.seg_idx) = 1),
    j AS (
      SELECT n.*, old, coalesce(lk, FALSE) AND coalesce(old, '') <> '' AS locked,
             NOT (coalesce(lk, FALSE) AND coalesce(old, '') <> '')
               AND coalesce(old <> '' AND old NOT IN ('unknown', 'Unknown', 'Character') AND old <> n.speaker, FALSE)
               AS differs
      FROM fresh n LEFT JOIN m ON n.doc_id = m.doc_id AND n.span_id = m.span_id)"""


@query(
    "speaker_diff",
    f"""WITH {_DIFFED}
    SELECT doc_id, span_id, seg_idx, CASE WHEN locked OR differs THEN old ELSE speaker END AS speaker,
           CASE WHEN locked THEN 1.0 ELSE confidence END::DOUBLE AS confidence, locked AS is_user_locked,
           NOT locked AND (differs OR confidence < 0.55) AS is_ambiguous,
           CASE WHEN differs THEN old || ' -> ' || speaker || ' by ' || engine END AS proposed
    FROM j""",
    ["script"],
)
def speaker_diff(t: Inputs):
    d = F.col("proposed_diff")
    text = F.concat(d["previous_speaker"], F.lit(" -> "), d["proposed_speaker"], F.lit(" by "), d["engine"])
    return A.speaker_diff(_new(t), t.script).withColumn("proposed", text).drop("proposed_diff")


@query(
    "apply_diffs",
    f"""WITH {_DIFFED},
    c AS (SELECT j.doc_id, j.seg_idx, j.speaker AS new_speaker, j.differs, s.type, s.audio_path,
                 CASE WHEN j.locked OR j.differs THEN j.old ELSE j.speaker END AS speaker,
                 CASE (j.doc_id + j.seg_idx) % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'dismiss' END AS action
          FROM j JOIN script s ON j.doc_id = s.doc_id AND j.seg_idx = s.seg_idx),
    a AS (SELECT *, differs AND coalesce(action = 'accept', FALSE) AS ok FROM c)
    SELECT doc_id, seg_idx, CASE WHEN ok THEN new_speaker ELSE speaker END AS speaker,
           CASE WHEN ok THEN CASE WHEN new_speaker = 'Narrator' THEN 'narrator' ELSE 'dialogue' END ELSE type END AS type,
           CASE WHEN NOT ok THEN audio_path END AS audio_path, ok AS needs_resync,
           differs AND NOT ok AND coalesce(action <> 'dismiss', TRUE) AS is_pending
    FROM a""",
    ["script"],
)
def apply_diffs(t: Inputs):
    diffed = A.speaker_diff(_new(t), t.script).select("doc_id", "seg_idx", "speaker", "proposed_diff")
    rows = diffed.join(t.script.select("doc_id", "seg_idx", "type", "audio_path"), ["doc_id", "seg_idx"])
    asked = rows.selectExpr(
        "doc_id", "seg_idx",
        "CASE (doc_id + seg_idx) % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'dismiss' END AS action",
    )
    done = A.apply_diffs(rows, asked)
    return done.withColumn("is_pending", F.col("proposed_diff").isNotNull()).drop("proposed_diff")


_MOVES = f"""SELECT DISTINCT doc_id, {name("doc_id", "0")} AS from_speaker, {name("doc_id", "2")} AS to_speaker
             FROM script WHERE doc_id % 2 = 0"""


@query(
    "batch_reassign",
    f"""WITH moves AS ({_MOVES})
    SELECT s.doc_id, s.seg_idx, coalesce(m.to_speaker, s.speaker) AS speaker,
           s.is_user_locked OR m.to_speaker IS NOT NULL AS is_user_locked, m.to_speaker IS NOT NULL AS was_reassigned
    FROM script s LEFT JOIN moves m ON s.doc_id = m.doc_id AND s.speaker = m.from_speaker""",
    ["script"],
)
def batch_reassign(t: Inputs):
    moves = t.spark.sql(_MOVES.replace("FROM script", "FROM {script}"), script=t.script)
    rows = t.script.select("doc_id", "seg_idx", "speaker", "is_user_locked")
    return A.batch_reassign(rows, moves)


@query(
    "reassign_counts",
    f"""WITH moves AS ({_MOVES})
    SELECT s.doc_id, m.to_speaker AS speaker, count(*) AS reassigned_lines
    FROM script s JOIN moves m ON s.doc_id = m.doc_id AND s.speaker = m.from_speaker GROUP BY ALL""",
    ["script"],
)
def reassign_counts(t: Inputs):
    moves = t.spark.sql(_MOVES.replace("FROM script", "FROM {script}"), script=t.script)
    return A.reassign_counts(A.batch_reassign(t.script, moves))


# ---------------------------------------------------------------- relationships


def _pid(a: str, b: str) -> str:
    x, y = (f"regexp_replace(lower({c}), '[{SQL_SPACE}-]+', '_', 'g')" for c in (a, b))
    return f"CASE WHEN {x} <= {y} THEN {x} || '_' || {y} ELSE {y} || '_' || {x} END"


@query("pair_id", f"SELECT doc_id, seg_idx, {_pid('a', 'b')} AS pair_id FROM pairs", ["pairs"])
def pair_id(t: Inputs):
    return R.with_pair_id(t.view("pairs")).select("doc_id", "seg_idx", "pair_id")


def _asof_sql(query_pos: str, state_pos: str, default: bool) -> str:
    power = """CASE WHEN lower(s.a) = lower(q.a) THEN s.power_dynamic
                    WHEN s.power_dynamic = 'a_over_b' THEN 'b_over_a'
                    WHEN s.power_dynamic = 'b_over_a' THEN 'a_over_b' ELSE s.power_dynamic END"""

    def value(expr: str, empty: str) -> str:
        return f"coalesce({expr}, '{empty}')" if default else expr

    return f"""
    WITH cand AS (
      SELECT q.doc_id, q.a, q.b, q.seg_idx, s.a IS NOT NULL AS has_history, s AS st, {power} AS pw,
             row_number() OVER (PARTITION BY q.doc_id, q.a, q.b, q.seg_idx
               ORDER BY CASE WHEN {state_pos} <= {query_pos} THEN 0 ELSE 1 END,
                        CASE WHEN {state_pos} <= {query_pos} THEN -({state_pos}) ELSE {state_pos} END) AS r
      FROM pairs q LEFT JOIN states s ON q.doc_id = s.doc_id
        AND least(lower(q.a), lower(q.b)) = least(lower(s.a), lower(s.b))
        AND greatest(lower(q.a), lower(q.b)) = greatest(lower(s.a), lower(s.b)))
    SELECT doc_id, a, b, seg_idx, has_history, {value("st.relation_type", "stranger")} AS relation_type,
           {value("st.relation_tone", "neutral")} AS relation_tone, {value("st.status", "current")} AS status,
           {value("pw", "equal")} AS power_dynamic, st.trigger AS trigger
    FROM cand WHERE r = 1"""


@query("relationship_asof", _asof_sql("q.seg_idx", "s.from_segment", True), ["pairs", "states"])
def relationship_asof(t: Inputs):
    pairs = t.view("pairs").select("doc_id", "a", "b", "seg_idx")
    return R.relationship_asof(pairs, t.view("states")).drop("pair_id")


@query(
    "relationship_asof_position",
    _asof_sql(
        "q.chapter * 2147483648 + q.segment",
        "s.from_chapter * 2147483648 + CASE WHEN s.from_segment = 0 THEN 1 ELSE s.from_segment END",
        False,
    ),
    ["pairs", "states"],
)
def relationship_asof_position(t: Inputs):
    found = R.relationship_asof_position(t.view("pairs"), t.view("states"))
    return found.drop("chapter", "segment")


@query(
    "merge_relationship_deltas",
    f"""
    WITH rows AS (
      SELECT doc_id, {_pid("a", "b")} AS pair_id, a, b, from_segment, relation_type, relation_tone, status,
             power_dynamic, trigger, -1 AS o FROM states
      UNION ALL
      SELECT doc_id, {_pid("a", "b")}, a, b, from_segment, relation_type, relation_tone, status, power_dynamic,
             trigger, arrival_ord FROM deltas WHERE a <> '' AND b <> '')
    SELECT doc_id, pair_id, first_value(a) OVER w AS a, first_value(b) OVER w AS b, from_segment, relation_type,
           relation_tone, status, power_dynamic, trigger
    FROM rows
    WINDOW w AS (PARTITION BY doc_id, pair_id ORDER BY o, from_segment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    QUALIFY row_number() OVER (PARTITION BY doc_id, pair_id, from_segment ORDER BY o DESC) = 1""",
    ["states", "deltas"],
)
def merge_relationship_deltas(t: Inputs):
    return R.merge_relationship_deltas(t.view("states"), t.view("deltas"))


_ACTIVE = f"""
SELECT doc_id, {name("doc_id", "ord")} AS name
FROM (SELECT DISTINCT user_id AS doc_id FROM events) u CROSS JOIN (SELECT 0 AS ord UNION ALL SELECT 1 UNION ALL SELECT 2) o
WHERE doc_id % 5 <> 4 OR ord = 0"""


@query(
    "relationship_pairs_summary",
    f"""
    WITH active AS ({_ACTIVE}), pos AS (SELECT user_id AS doc_id, max(event_id) AS m FROM events GROUP BY ALL),
    cur AS (
      SELECT s.* FROM states s JOIN pos ON s.doc_id = pos.doc_id
      QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY
        CASE WHEN s.from_segment <= pos.m - pos.m % 7 * 100 THEN 0 ELSE 1 END,
        CASE WHEN s.from_segment <= pos.m - pos.m % 7 * 100 THEN -s.from_segment ELSE s.from_segment END) = 1),
    n AS (SELECT doc_id, count(*) AS active_characters FROM active GROUP BY ALL),
    pair AS (
      SELECT c.doc_id, least(x.name, y.name) AS a, greatest(x.name, y.name) AS b, relation_type, relation_tone, status, trigger
      FROM cur c JOIN active x ON x.doc_id = c.doc_id AND x.name = c.a JOIN active y ON y.doc_id = c.doc_id AND y.name = c.b)
    SELECT n.doc_id, active_characters,
           CAST(active_characters * (active_characters - 1) / 2 AS BIGINT) - CASE WHEN p.a IS NULL THEN 0 ELSE 1 END
             AS unrecorded_pairs, p.a, p.b,
           CASE WHEN p.a IS NOT NULL THEN '• ' || p.a || ' & ' || p.b || ': ' || relation_type || ' (' || relation_tone
                     || ', ' || status || ')' || coalesce(' [Since: ' || trigger || ']', '')
                WHEN active_characters < 2 THEN 'No multi-character pairs in this scene.'
                ELSE 'No established relationship history.' END AS line
    FROM n LEFT JOIN pair p ON n.doc_id = p.doc_id""",
    ["states"],
)
def relationship_pairs_summary(t: Inputs):
    events = t.table("events")
    active = t.spark.sql(_ACTIVE.replace("FROM events", "FROM {events}"), events=events)
    at = events.groupBy(F.col("user_id").alias("doc_id")).agg(F.max("event_id").alias("m"))
    at = at.selectExpr("doc_id", "m - m % 7 * 100 AS seg_idx")
    return R.relationship_pairs_summary(active, t.view("states"), at)


@query(
    "taxonomy_validate",
    f"""SELECT doc_id, seg_idx,
        CASE WHEN lower(trim(speaker)) IN ('family', 'unknown') THEN lower(trim(speaker)) ELSE 'unknown' END AS relation_type,
        CASE WHEN lower(trim(emotion)) IN ({", ".join(f"'{x}'" for x in R.RELATION_TONES)}) THEN lower(trim(emotion)) END
          AS relation_tone
        FROM (SELECT doc_id, seg_idx, CASE WHEN seg_idx % 2 = 0 THEN ' Family ' ELSE speaker END AS speaker,
                     CASE WHEN seg_idx % 3 = 0 THEN 'Warm' WHEN seg_idx % 3 = 1 THEN ' tense' ELSE emotion END AS emotion
              FROM script) q""",
    ["script"],
)
def taxonomy_validate(t: Inputs):
    rows = t.script.selectExpr(
        "doc_id", "seg_idx", "CASE WHEN seg_idx % 2 = 0 THEN ' Family ' ELSE speaker END AS relation_type",
        "CASE WHEN seg_idx % 3 = 0 THEN 'Warm' WHEN seg_idx % 3 = 1 THEN ' tense' ELSE emotion END AS relation_tone",
    )
    return R.taxonomy_validate(rows)


