"""Queries over staging, emotion, special content, lexicon and screenplays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import emotion as E
from ..operators import lexicon as L
from ..operators import ordered
from ..operators import screenplay as S
from ..operators import special as SPC
from ..operators import staging as G
from .inputs import Inputs, given_name, name
from .registry import SQL_WS, query, rounded
from .text_queries import SP, words

HASH = """list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(ord(c) AS BIGINT)),
            lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT))"""


def name_hash(expr: str) -> str:
    h = HASH.format(expr)
    return f"(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END)"


def band_sql(level: str) -> str:
    cases = " ".join(f"WHEN {level} <= {edge} THEN {i}" for i, edge in enumerate(E.BAND_EDGES, 1))
    return f"(CASE {cases} ELSE 5 END)"


_SYN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.SYNONYMS.items())


def palette_sql(emotion: str) -> str:
    key = f"lower(trim(coalesce(nullif({emotion}, ''), 'neutral')))"
    mapped = f"(CASE {key} {_SYN} ELSE {key} END)"
    known = ", ".join(f"'{e}'" for e in E.BANDS)
    return f"(CASE WHEN {mapped} IN ({known}) THEN {mapped} ELSE 'neutral' END)"


def band_text_sql(emotion: str, band: str, part: int) -> str:
    cases = " ".join(
        f"WHEN '{e}{i}' THEN '{row[part]}'" for e, rows in E.BANDS.items() for i, row in enumerate(rows, 1)
    )
    return f"(CASE {palette_sql(emotion)} || {band} {cases} END)"


_BAND_ROWS = ", ".join(
    f"('{e}{i}', '{row[0]}', '{row[1]}')" for e, rows in E.BANDS.items() for i, row in enumerate(rows, 1)
)


# ---------------------------------------------------------------- cues and staging


def _rx(pattern: str, group: int) -> str:
    body = pattern.replace("(?i)", "").replace("'", "''")
    return f"nullif(regexp_extract(t, '{body}', {group}, 'i'), '')"


def _flag(flag: str) -> str:
    verbs, adverbs, stems = G.FLAGS[flag]
    tests = []
    if verbs:
        tests.append(f"coalesce(verb IN ({', '.join(repr(v) for v in verbs)}), FALSE)")
    if adverbs:
        tests.append(f"coalesce(adv IN ({', '.join(repr(v) for v in adverbs)}), FALSE)")
    tests += [f"contains(search, '{s}')" for s in stems]
    return "(" + " OR ".join(tests) + f") AS {flag}"


@query(
    "acoustic_cues",
    f"""
    WITH a AS (SELECT doc_id, seg_idx, trim(text, {SP}) AS t FROM narration),
    b AS (
      SELECT *, trim({_rx(G.VOICE_CLAUSE, 1)}, {SP}) AS clause, trim({_rx(G.VOICE_PARTICIPLE, 0)}, {SP}) AS part,
             trim({_rx(G.TONE_PHRASE, 1)}, {SP}) || ' tone' AS tone, lower({_rx(G.CUE_VERB, 1)}) AS verb,
             lower({_rx(G.CUE_VERB, 2)}) AS adv FROM a),
    c AS (SELECT *, coalesce(clause, part, tone) AS raw, lower(concat_ws(' ', t, coalesce(clause, part, tone))) AS search
          FROM b)
    SELECT doc_id, seg_idx, coalesce(part, clause) AS vocal_clause, verb AS speech_verb, adv AS speech_adverb,
           tone AS in_tone_phrase, raw AS raw_acoustic_phrase, {", ".join(_flag(f) for f in G.FLAGS)} FROM c""",
    ["narration"],
)
def acoustic_cues(t: Inputs):
    return G.acoustic_cues(t.view("narration")).select("doc_id", "seg_idx", "cues.*")


@query("stage_segments")
def stage_segments(t: Inputs):
    relations = t.people.where("ord = 0").selectExpr(
        "doc_id", "ord", "name AS a", "'nobody' AS b", "'family' AS relation_type", "'tense' AS relation_tone"
    )
    return G.stage_segments(t.view("staged"), t.people, relations).select("*", "style.*").drop("style")


# ---------------------------------------------------------------- emotion

_FEEL = """
SELECT doc_id, seg_idx, CASE seg_idx % 4 WHEN 0 THEN 'Furious whisper' WHEN 1 THEN emotion WHEN 2 THEN 'joyful, trembling'
       ELSE NULL END AS emotion, direction FROM script"""


def _stems(stems: list[str]) -> str:
    return " OR ".join(f"contains(s, '{x}')" for x in stems)


@query(
    "emotion_palette",
    f"""WITH f AS (SELECT *, lower(coalesce(emotion, '') || ' ' || coalesce(direction, '')) AS s FROM ({_FEEL}) q)
    SELECT doc_id, seg_idx, emotion, direction,
      CASE {" ".join(f"WHEN {_stems(s)} THEN '{n}'" for n, _, s in E.PALETTE)} ELSE 'calm' END AS palette_emotion,
      CASE {" ".join(f"WHEN {_stems(s)} THEN {v}" for _, v, s in E.PALETTE)} ELSE 0.7 END::DOUBLE AS palette_intensity,
      {_stems(E.WHISPER_STEMS)} AS is_whisper,
      CASE WHEN {_stems(E.WHISPER_STEMS)} THEN 'whisper' ELSE 'emotion' END AS route FROM f""",
    ["script"],
)
def emotion_palette(t: Inputs):
    return G.emotion_palette(t.spark.sql(_FEEL.replace("FROM script", "FROM {script}"), script=t.script))


@query(
    "emotion_band",
    f"""SELECT doc_id, seg_idx, emotion, intensity, {band_sql("intensity")} AS band,
        {band_text_sql("emotion", band_sql("intensity"), 0)} AS band_label,
        {band_text_sql("emotion", band_sql("intensity"), 1)} AS band_description FROM script""",
    ["script"],
)
def emotion_band(t: Inputs):
    return G.emotion_band(t.script.select("doc_id", "seg_idx", "emotion", "intensity"))


def _arc_events(t: Inputs):
    return t.table("events").selectExpr(
        "user_id % 10 AS doc_id", "concat('u', user_id) AS char_id", "event_id AS line_idx",
        "(value % 1.7 - 0.6) * CASE WHEN event_type = 'purchase' THEN 1.0D ELSE 0.5D END AS trigger_strength",
        "CASE event_type WHEN 'error' THEN 0.55D WHEN 'signup' THEN 0.15D ELSE 0.2D END AS baseline",
        "CAST(event_id % 4 AS INT) AS lines_since",
    )


def _step(previous: str) -> str:
    """One step of the recurrence from ``previous``, in SQL."""
    raw = f"baseline + ({previous} - baseline) * pow(0.85::DOUBLE, n) + trigger"
    limit = "0.30::DOUBLE * n"
    raw = f"CASE WHEN abs(trigger) < 0.40 THEN least(greatest({raw}, {previous} - {limit}), {previous} + {limit}) ELSE {raw} END"
    return f"floor(least(greatest({raw}, 0.0), 1.0) * 1000 + 0.5) / 1000"


ARC_SQL = f"""
    WITH RECURSIVE ev AS (
      SELECT user_id % 10 AS doc_id, 'u' || user_id AS char_id, event_id AS line_idx,
             (value % 1.7::DOUBLE - 0.6::DOUBLE) * CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS trigger,
             CASE event_type WHEN 'error' THEN 0.55 WHEN 'signup' THEN 0.15 ELSE 0.2 END::DOUBLE AS baseline,
             greatest(1, event_id % 4) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k
      FROM events),
    arc AS (
      SELECT doc_id, char_id, line_idx, k, {_step("0.2::DOUBLE")} AS intensity FROM ev WHERE k = 1
      UNION ALL
      SELECT e.doc_id, e.char_id, e.line_idx, e.k, {_step("a.intensity")} FROM arc a JOIN ev e ON e.char_id = a.char_id AND e.k = a.k + 1)"""


@query("emotion_arc", f"{ARC_SQL} SELECT doc_id, char_id, line_idx, intensity, {band_sql('intensity')} AS band FROM arc")
def emotion_arc(t: Inputs):
    return G.emotion_arc(_arc_events(t))


@query(
    "relationship_baseline",
    """SELECT doc_id, from_segment, status, relation_tone,
       CASE WHEN status = 'hostile' OR relation_tone = 'hostile' THEN 0.55
            WHEN status = 'tense' OR relation_tone IN ('tense', 'guarded') THEN 0.40 WHEN status = 'estranged' THEN 0.35
            WHEN status IN ('warm', 'allied') OR relation_tone = 'warm' THEN 0.15 ELSE 0.20 END::DOUBLE AS baseline
       FROM states""",
    ["states"],
)
def relationship_baseline(t: Inputs):
    return G.relationship_baseline(t.view("states").select("doc_id", "from_segment", "status", "relation_tone"))


_MODE = "CASE seg_idx % 3 WHEN 0 THEN 'suppressed' WHEN 1 THEN 'released' ELSE 'balanced' END"


@query(
    "emotion_instruction",
    f"""SELECT doc_id, seg_idx, 'Say the following with the same voice, ' ||
          CASE seg_idx % 3 WHEN 0 THEN '{G.MANNER["suppressed"]}' WHEN 1 THEN '{G.MANNER["released"]}' ELSE 'naturally' END
          || ', with ' || {band_text_sql("emotion", band_sql("intensity"), 0)} || ' delivery (intensity '
          || {band_sql("intensity")} || '/5, ' || {band_text_sql("emotion", band_sql("intensity"), 1)} || '): ''' || text
          || '''' AS instruction FROM script""",
    ["script"],
)
def emotion_instruction(t: Inputs):
    rows = t.script.withColumn("expression", F.expr(_MODE))
    return G.emotion_instruction(rows).select("doc_id", "seg_idx", "instruction")


_STATES = """
SELECT doc_id, seg_idx, CASE WHEN (doc_id + seg_idx) % 4 = 0 THEN 'state_update' ELSE type END AS type, speaker,
       CASE WHEN (doc_id + seg_idx) % 4 = 0 AND seg_idx % 3 <> 2 THEN emotion END AS new_emotion FROM script"""


@query(
    "running_emotion_state",
    f"""WITH s AS ({_STATES}), r AS (
      SELECT doc_id, seg_idx, type, speaker, new_emotion,
             last_value(CASE WHEN type = 'state_update' AND new_emotion <> '' THEN new_emotion END IGNORE NULLS)
               OVER (PARTITION BY doc_id, speaker ORDER BY seg_idx) AS a FROM s)
    SELECT doc_id, seg_idx, type, speaker, new_emotion, coalesce(a, 'neutral and observant.') AS active_emotion_state
    FROM r WHERE type <> 'state_update'""",
    ["script"],
)
def running_emotion_state(t: Inputs):
    return G.running_emotion_state(t.spark.sql(_STATES.replace("FROM script", "FROM {script}"), script=t.script))


_REQ = f"""
SELECT doc_id, seg_idx, 'c' || CAST(seg_idx % 3 AS STRING) AS char_id, emotion,
       CASE WHEN seg_idx % 2 = 0 THEN CAST(seg_idx % 6 AS INT) END AS requested_band, intensity AS requested_intensity FROM script"""
_CAPS = """
SELECT DISTINCT doc_id, 'c' || CAST(seg_idx % 2 AS STRING) AS char_id, 'anger' AS emotion, CAST(doc_id % 3 + 1 AS INT) AS max_band
FROM script WHERE seg_idx < 2"""


@query(
    "remap_intensity",
    f"""WITH r AS ({_REQ}), c AS ({_CAPS}),
    j AS (SELECT r.*, lower(trim(coalesce(nullif(r.emotion, ''), 'neutral'))) AS ee,
                 coalesce(nullif(requested_band, 0), {band_sql("requested_intensity")}) AS asked FROM r),
    k AS (SELECT j.*, least(asked, coalesce(max_band, 5)) AS eb, asked > coalesce(max_band, 5) AS capped
          FROM j LEFT JOIN c ON j.doc_id = c.doc_id AND j.char_id = c.char_id AND j.ee = c.emotion)
    SELECT doc_id, seg_idx, ee AS effective_emotion, asked AS original_requested_band, capped AS was_capped,
           eb AS effective_band, {rounded("(eb - 0.5) / 5.0", 2)} AS effective_intensity,
           CASE WHEN capped THEN 0.88 END::DOUBLE AS pacing_speed_ratio, CASE WHEN capped THEN 1.35 END::DOUBLE AS pause_multiplier,
           CASE WHEN capped THEN 'suppressed' END AS expression_override,
           CASE WHEN capped THEN 'Vocal intensity capped at Band ' || eb || ' (' || {band_text_sql("ee", "eb", 0)}
             || '); compensating with tight, clipped articulation and deliberate pauses.' END AS compensation_note FROM k""",
    ["script"],
)
def remap_intensity(t: Inputs):
    requests, caps = (
        t.spark.sql(q.replace("FROM script", "FROM {script}"), script=t.script) for q in (_REQ, _CAPS)
    )
    return G.remap_intensity(requests, caps).drop("char_id", "emotion", "requested_band", "requested_intensity")


# ---------------------------------------------------------------- performance

_PERF = f"""
SELECT doc_id, seg_idx, seg_id, speaker, text, CASE WHEN seg_idx % 3 = 0 THEN {given_name("doc_id", "2")} ELSE '' END AS addressee,
       CASE seg_idx % 4 WHEN 0 THEN 'intimate' WHEN 1 THEN 'projected' ELSE '' END AS distance, emotion, intensity,
       CASE WHEN seg_idx % 5 = 0 THEN 'anger' END AS felt_emotion,
       CASE WHEN seg_idx % 5 < 2 THEN CAST((doc_id + seg_idx) % 5 + 1 AS INT) END AS felt_band,
       {_MODE} AS expression, CASE WHEN seg_idx % 6 = 1 THEN ' keep it low ' END AS director_note,
       (doc_id + seg_idx) % 2 AS tired
FROM script"""


def _perf(t: Inputs):
    rows = t.spark.sql(_PERF.replace("FROM script", "FROM {script}"), script=t.script)
    return rows.selectExpr(
        "*", "CASE WHEN tired = 1 THEN array('tired', 'cold') ELSE CAST(array() AS array<string>) END AS physical_state",
        "CASE WHEN tired = 0 THEN array('now', 'here') ELSE CAST(array() AS array<string>) END AS emphasis",
    ).drop("tired")


_RECORD = f"""
    perf AS ({_PERF}),
    rec AS (
      SELECT *, lower(trim(coalesce(nullif(emotion, ''), 'neutral'))) AS de, {band_sql("intensity")} AS db,
             lower(trim(coalesce(nullif(felt_emotion, ''), nullif(emotion, ''), 'neutral'))) AS fe,
             coalesce(felt_band, {band_sql("intensity")}) AS fb, trim(nullif(director_note, '')) AS note,
             nullif(addressee, '') AS ad, coalesce(nullif(distance, ''), 'conversational') AS far FROM perf)"""


@query(
    "performance_record",
    f"""WITH {_RECORD}
    SELECT doc_id, seg_idx, trim(speaker) AS speaker, ad AS addressee, far AS distance, de AS displayed_emotion, db AS displayed_band,
           fe AS felt_emotion, fb AS felt_band, expression, CASE WHEN tired = 1 THEN 'tired,cold' ELSE '' END AS physical_state,
           CASE WHEN tired = 0 THEN 'now,here' ELSE '' END AS emphasis, FALSE AS is_interrupted, nullif(director_note, '') AS director_note
    FROM rec""",
    ["script"],
)
def performance_record(t: Inputs):
    p = F.col("performance")
    return G.performance_record(_perf(t)).select(
        "doc_id", "seg_idx", p["speaker"], p["addressee"], p["distance"],
        p["displayed"]["emotion"].alias("displayed_emotion"), p["displayed"]["band"].alias("displayed_band"),
        p["felt"]["emotion"].alias("felt_emotion"), p["felt"]["band"].alias("felt_band"), p["expression"],
        F.array_join(p["physical_state"], ",").alias("physical_state"),
        F.array_join(p["emphasis"], ",").alias("emphasis"), p["is_interrupted"], p["director_note"],
    ).toDF("doc_id", "seg_idx", "speaker", "addressee", "distance", "displayed_emotion", "displayed_band",
           "felt_emotion", "felt_band", "expression", "physical_state", "emphasis", "is_interrupted",
           "director_note")


@query(
    "performance_instruction",
    # Step by step: the keys of both bands first, then their texts from a table.
    f"""WITH {_RECORD.replace("rec AS (", "rec AS MATERIALIZED (")},
    keyed AS MATERIALIZED (SELECT *, {palette_sql("de")} || db AS dk, {palette_sql("fe")} || fb AS fk FROM rec),
    bands(k, name, manner) AS (VALUES {_BAND_ROWS}),
    told AS MATERIALIZED (
      SELECT r.*, d.name AS dn, d.manner AS dm, f.name AS fn, f.manner AS fm
      FROM keyed r LEFT JOIN bands d ON d.k = r.dk LEFT JOIN bands f ON f.k = r.fk)
    SELECT doc_id, seg_idx, 'Say the following with the same voice, ' || concat_ws(', ',
      CASE WHEN ad IS NOT NULL AND far = 'intimate' THEN 'Speaking directly to ' || ad || ' in close, intimate proximity'
           WHEN ad IS NOT NULL AND far = 'projected' THEN 'Projecting voice across distance to ' || ad
           WHEN ad IS NOT NULL THEN 'Speaking to ' || ad WHEN far = 'intimate' THEN 'Close, intimate vocal delivery'
           WHEN far = 'projected' THEN 'Projected voice, addressing the entire room' END,
      CASE WHEN note IS NOT NULL THEN NULL
           WHEN de <> fe OR db <> fb THEN 'Surface delivery is ' || dn || ' (' || dm || '), with underlying suppressed ' || fn || ' subtext (' || fm || ')'
           ELSE 'Delivery is ' || dn || ' (' || dm || ')' END,
      CASE WHEN note IS NULL THEN CASE expression WHEN 'suppressed' THEN 'tightly held-back, suppressed cadence'
                                                  WHEN 'released' THEN 'open, uninhibited vocal release' END END,
      CASE WHEN tired = 1 THEN 'Physical state: tired, cold' END,
      CASE WHEN tired = 0 THEN 'emphasizing the word(s) ''now'' and ''here''' END, '[Director: ' || note || ']')
      || ': ''' || trim(text, {SP}) || '''' AS instruction FROM told""",
    ["script"],
)
def performance_instruction(t: Inputs):
    return G.performance_instruction(_perf(t), resolve_override=True).select("doc_id", "seg_idx", "instruction")


def jitter_sql(seed: str) -> str:
    return rounded(f"1.0::DOUBLE + ((abs({name_hash(seed)}) % 1000) / 1000.0::DOUBLE * 2.0 - 1.0) * 0.12", 3)


_SEED = "speaker || seg_id || substr(text, 1, 5)"


@query("timing_jitter", f"SELECT doc_id, seg_idx, {jitter_sql(_SEED)} AS jitter FROM script", ["script"])
def timing_jitter(t: Inputs):
    rows = t.script.withColumn("seed", F.expr(_SEED))
    return G.timing_jitter(rows, "seed").select("doc_id", "seg_idx", "jitter")


_DASHED = """
SELECT doc_id, seg_idx, seg_id, speaker, text || CASE (doc_id + seg_idx) % 4 WHEN 0 THEN ' —' WHEN 1 THEN '... '
       WHEN 2 THEN '--' ELSE '' END AS text, CAST(doc_id % 5 + 1 AS INT) AS felt_band, CAST(seg_idx % 5 + 1 AS INT) AS displayed_band
FROM script"""


@query(
    "dramatic_pause",
    f"""WITH d AS ({_DASHED}),
    p AS (SELECT *, trim(text, {SP}) AS t, lag(trim(text, {SP})) OVER w AS pt, lag(lower(trim(speaker))) OVER w AS ps
          FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx)),
    c AS (SELECT *, coalesce(regexp_matches(pt, '(?:--|—|–)$'), FALSE) AS cut, coalesce(ps <> lower(trim(speaker)), FALSE) AS sw,
                 {jitter_sql("seg_id")} AS j FROM p)
    SELECT doc_id, seg_idx,
      {rounded("CASE WHEN cut AND sw THEN 0.0 WHEN cut THEN 0.75 WHEN abs(felt_band - displayed_band) >= 2 THEN 0.95 ELSE 0.45 END::DOUBLE * 1.25::DOUBLE * j", 3)} AS seconds_before,
      {rounded("CASE WHEN regexp_matches(t, '(?:[.][.][.]|…)$') THEN 0.85 ELSE 0.45 END::DOUBLE * 1.25::DOUBLE * j", 3)} AS seconds_after,
      regexp_matches(t, '(?:--|—|–)$') AS is_interrupted, cut AND sw AS is_cross_speaker_interruption,
      CASE WHEN cut AND sw THEN -0.15 ELSE 0.0 END::DOUBLE AS overlap_seconds FROM c""",
    ["script"],
)
def dramatic_pause(t: Inputs):
    rows = t.spark.sql(_DASHED.replace("FROM script", "FROM {script}"), script=t.script)
    return G.dramatic_pause(rows, tempo="slow").select(
        "doc_id", "seg_idx", "seconds_before", "seconds_after", "is_interrupted", "is_cross_speaker_interruption",
        "overlap_seconds",
    )


@query("prompt_ablation_grid")
def prompt_ablation_grid(t: Inputs):
    return G.prompt_ablation_grid(_perf(t))


_SECONDS = rounded(f"{words('text')} / 2.3 + len(regexp_extract_all(text, '[,.?!;:]')) * 0.3::DOUBLE + 0.5", 1)


@query(
    "speech_duration_estimate",
    f"""SELECT doc_id, seg_idx, CASE WHEN seg_idx % 4 = 1 THEN greatest(1.0, least(28.0, {rounded("intensity * 40 + 0.13", 1)}))
          ELSE greatest(1.5, least(28.0, {_SECONDS})) END::DOUBLE AS estimated_seconds FROM script""",
    ["script"],
)
def speech_duration_estimate(t: Inputs):
    rows = t.script.selectExpr(
        "doc_id", "seg_idx", "text", "CASE WHEN seg_idx % 4 = 1 THEN intensity * 40 + 0.13 END AS gen_seconds"
    )
    return G.speech_duration_estimate(rows).select("doc_id", "seg_idx", "estimated_seconds")


# ---------------------------------------------------------------- special content

_THOUGHTS = """
SELECT doc_id, seg_idx, type, CASE (doc_id + seg_idx) % 6 WHEN 0 THEN '*' || seg_id || ' again*' WHEN 1 THEN '<i>' || speaker || '</i>'
         WHEN 2 THEN text || ' she wondered' WHEN 3 THEN '_so_' ELSE text END AS text,
       CASE (doc_id + seg_idx) % 6 WHEN 4 THEN 'As if he Said to himself' ELSE direction END AS direction FROM script"""
_TV = "(?i)\\b(?:thought|wondered|mused|reflected|realized|said to (?:himself|herself|themselves))\\b"


@query(
    "inner_thought",
    f"""WITH s AS (SELECT *, trim(text, {SP}) AS r FROM ({_THOUGHTS}) q),
    f AS (SELECT *, regexp_matches(r, '^(\\*|_)[^*_]+(\\*|_)$') OR regexp_matches(r, '^\\*[^*]+\\*$') AS st,
                 regexp_matches(r, '(?i)^<i>[^<]+</i>$') AS tg, regexp_matches(direction, '{_TV}') AS dr,
                 regexp_matches(r, '{_TV}') AND type <> 'dialogue' AS td FROM s)
    SELECT doc_id, seg_idx, st OR tg OR dr OR td AS is_inner_thought,
           CASE WHEN st THEN trim(regexp_replace(r, '^(\\*|_)+|(\\*|_)+$', '', 'g'), {SP})
                WHEN tg THEN trim(regexp_replace(r, '(?i)^<i>|</i>$', '', 'g'), {SP}) ELSE r END AS thought_text,
           CASE WHEN st OR dr THEN 0.95 WHEN tg OR td THEN 0.75 ELSE 0.0 END::DOUBLE AS thought_confidence,
           CASE WHEN st OR tg OR dr OR td THEN 'intimate' ELSE 'conversational' END AS distance FROM f""",
    ["script"],
)
def inner_thought(t: Inputs):
    rows = t.spark.sql(_THOUGHTS.replace("FROM script", "FROM {script}"), script=t.script)
    return SPC.inner_thought(rows).select(
        "doc_id", "seg_idx", "is_inner_thought", "thought_text", "thought_confidence", "distance"
    )


_CTX = "CASE (doc_id + seg_idx) % 5 WHEN 0 THEN 'Phone Call' WHEN 1 THEN 'radio-intercom' WHEN 2 THEN ' through_wall ' WHEN 3 THEN 'cave' ELSE '' END"


@query(
    "acoustic_context",
    f"""SELECT doc_id, seg_idx, CASE (doc_id + seg_idx) % 5 WHEN 0 THEN '{SPC.FILTERS["phone_call"]}'
        WHEN 1 THEN '{SPC.FILTERS["radio_intercom"]}' WHEN 2 THEN '{SPC.FILTERS["through_wall"]}' ELSE 'anull' END AS filter_chain
        FROM script""",
    ["script"],
)
def acoustic_context(t: Inputs):
    rows = t.script.withColumn("acoustic_context", F.expr(_CTX))
    return SPC.acoustic_context(rows).select("doc_id", "seg_idx", "filter_chain")


_LETTERS = f"SELECT doc_id, seg_idx, CASE WHEN seg_idx % 4 = 3 THEN '' ELSE {name('doc_id', '0')} END AS sender, {name('doc_id', '1')} AS recipient FROM script"
_POLICY = "CASE doc_id % 4 WHEN 0 THEN 'sender_voice' WHEN 1 THEN 'recipient_voice' WHEN 2 THEN 'narrator_formal' ELSE 'other' END"


@query(
    "epistolary_reader",
    f"""WITH l AS ({_LETTERS}), b AS (SELECT *, {_POLICY} AS policy, 'Teller' AS nv FROM books WHERE doc_id % 7 <> 6)
    SELECT l.*, CASE policy WHEN 'recipient_voice' THEN recipient WHEN 'narrator_formal' THEN nv
                  ELSE coalesce(nullif(sender, ''), nv, 'Narrator') END AS resolved_speaker,
           CASE policy WHEN 'recipient_voice' THEN '{SPC.LETTER_STYLES["recipient_voice"]}'
             WHEN 'narrator_formal' THEN '{SPC.LETTER_STYLES["narrator_formal"]}'
             ELSE '{SPC.LETTER_STYLES["sender_voice"].replace("'", "''")}' END AS delivery_style
    FROM l LEFT JOIN b ON l.doc_id = b.doc_id""",
    ["script", "books"],
)
def epistolary_reader(t: Inputs):
    letters = t.spark.sql(_LETTERS.replace("FROM script", "FROM {script}"), script=t.script)
    policies = t.view("books").where("doc_id % 7 <> 6").selectExpr("*", f"{_POLICY} AS policy", "'Teller' AS narrator_voice")
    return SPC.epistolary_reader(letters, policies)


_HINT = "CASE seg_idx % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'neutral' END"
_POOLS = " ".join(f"WHEN {i} THEN '{row[0]}'" for i, row in enumerate(SPC.WALK_ONS))


@query(
    "minor_voice_pool",
    f"""WITH g AS (SELECT doc_id, seg_idx, speaker || ' ' || seg_id AS name, {_HINT} AS gender_hint FROM script),
    h AS (SELECT *, abs({name_hash("lower(trim(name))")}) AS h FROM g)
    SELECT doc_id, seg_idx, name, gender_hint, CASE CASE gender_hint WHEN 'male' THEN h % 3 WHEN 'female' THEN 3 + h % 3
           ELSE h % 6 END {_POOLS} END AS pool_id FROM h""",
    ["script"],
)
def minor_voice_pool(t: Inputs):
    rows = t.script.selectExpr("doc_id", "seg_idx", "concat(speaker, ' ', seg_id) AS name", f"{_HINT} AS gender_hint")
    return SPC.minor_voice_pool(rows).select("doc_id", "seg_idx", "name", "gender_hint", "pool_id")


# ---------------------------------------------------------------- lexicon

_LEX = """
SELECT doc_id, target_word, replacement, type, case_sensitive, CAST('' AS STRING) AS notes, ord FROM books CROSS JOIN (
  SELECT 'the' AS target_word, 'thuh' AS replacement, 'respelling' AS type, FALSE AS case_sensitive, 0 AS ord
  UNION ALL SELECT 'by the', 'bye $1 thee', 'expansion', FALSE, 1 UNION ALL SELECT 'In', 'Inn', 'phoneme', TRUE, 2
  UNION ALL SELECT 'que.', 'kuh!', 'other', FALSE, 3 UNION ALL SELECT ' ', 'x', 'respelling', FALSE, 4) w WHERE doc_id % 3 <> 2"""


@query(
    "apply_lexicon",
    """
    WITH s1 AS (SELECT doc_id, seg_idx, CASE WHEN doc_id % 5 = 0 AND seg_idx % 2 = 0
                  THEN regexp_replace(text, '(?i)\\band\\b', 'ampersand', 'g') ELSE text END AS t, text,
                  CASE WHEN doc_id % 5 = 0 AND seg_idx % 2 = 0 THEN len(regexp_extract_all(text, '(?i)\\band\\b')) ELSE 0 END AS n0
                FROM script),
    s2 AS (SELECT *, doc_id % 3 <> 2 AS on_, len(regexp_extract_all(t, '(?i)\\bby the\\b')) AS n1,
                  regexp_replace(t, '(?i)\\bby the\\b', 'bye $1 thee', 'g') AS t1 FROM s1),
    s3 AS (SELECT *, len(regexp_extract_all(t1, '(?i)\\bque\\.')) AS n2, regexp_replace(t1, '(?i)\\bque\\.', 'kuh!', 'g') AS t2 FROM s2),
    s4 AS (SELECT *, len(regexp_extract_all(t2, '(?i)\\bthe\\b')) AS n3, regexp_replace(t2, '(?i)\\bthe\\b', 'thuh', 'g') AS t3 FROM s3),
    s5 AS (SELECT *, len(regexp_extract_all(t3, '\\bIn\\b')) AS n4, regexp_replace(t3, '\\bIn\\b', 'Inn', 'g') AS t4 FROM s4)
    SELECT doc_id, seg_idx, CASE WHEN on_ THEN t4 ELSE t END AS text,
           concat_ws(',', CASE WHEN n0 > 0 THEN 'and:' || n0 END, CASE WHEN on_ AND n1 > 0 THEN 'by the:' || n1 END,
             CASE WHEN on_ AND n2 > 0 THEN 'que.:' || n2 END, CASE WHEN on_ AND n3 > 0 THEN 'the:' || n3 END,
             CASE WHEN on_ AND n4 > 0 THEN 'In:' || n4 END) AS applied FROM s5""",
    ["script"],
)
def apply_lexicon(t: Inputs):
    lexicon = t.spark.sql(_LEX.replace("FROM books", "FROM {books}"), books=t.view("books"))
    rows = t.script.select("doc_id", "seg_idx", "text")
    own = rows.where("doc_id % 5 = 0 AND seg_idx % 2 = 0").selectExpr(
        "doc_id", "seg_idx", "'and' AS target_word", "'ampersand' AS replacement", "'respelling' AS type",
        "false AS case_sensitive", "'' AS notes",
    )
    done = L.apply_lexicon(rows, lexicon, own)
    label = F.transform("applied", lambda a: F.concat_ws(":", a["target_word"], a["occurrences"].cast("string")))
    return done.withColumn("applied", F.array_join(label, ","))


_UPD = """
SELECT doc_id, CASE seg_idx % 3 WHEN 0 THEN 'THE' WHEN 1 THEN 'new' ELSE 'New' END AS target_word,
       'r' || CAST(seg_idx AS STRING) AS replacement, CAST(NULL AS STRING) AS type, CAST(NULL AS BOOLEAN) AS case_sensitive,
       CAST('' AS STRING) AS notes, seg_idx AS arrival_ord FROM script"""


@query(
    "lexicon_upsert",
    f"""WITH l AS ({_LEX}), u AS ({_UPD}),
    n AS (SELECT doc_id, lower(target_word) AS k, arg_max(target_word, arrival_ord) AS target_word,
                 arg_max(replacement, arrival_ord) AS replacement FROM u GROUP BY ALL)
    SELECT doc_id, target_word, replacement, type, case_sensitive, notes FROM l
    WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = l.doc_id AND n.k = lower(l.target_word))
    UNION ALL SELECT doc_id, target_word, replacement, 'respelling', FALSE, '' FROM n""",
    ["books", "script"],
)
def lexicon_upsert(t: Inputs):
    lexicon = t.spark.sql(_LEX.replace("FROM books", "FROM {books}"), books=t.view("books"))
    updates = t.spark.sql(_UPD.replace("FROM script", "FROM {script}"), script=t.script)
    return L.lexicon_upsert(lexicon, updates)


_STOP = ", ".join(f"'{w}'" for w in L.STOPWORDS)


@query(
    "rare_tokens",
    f"""
    WITH g AS (
      SELECT doc_id, text, string_split(regexp_replace(text, '\\b([A-Z][a-zA-Z0-9''-]{{1,30}})\\b',
        chr(30) || '\\1' || chr(30), 'g'), chr(30)) AS s FROM documents),
    p AS (
      SELECT doc_id, text, i, s[i] AS piece, sum(length(s[i])) OVER (PARTITION BY doc_id ORDER BY i) - length(s[i]) AS ofs
      FROM (SELECT doc_id, text, s, unnest(range(1, len(s) + 1)) AS i FROM g) q),
    k AS (SELECT doc_id, text, piece AS token, CAST(ofs AS INT) AS pos FROM p
          WHERE i % 2 = 0 AND lower(piece) NOT IN ({_STOP})),
    f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, token) AS frequency FROM k
          QUALIFY row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) = 1)
    SELECT doc_id, token, frequency, '...' || trim(regexp_replace(
             substr(text, greatest(pos - 30, 0) + 1, least(pos, 30) + length(token) + 30), '{SQL_WS}+', ' ', 'g'), {SP}) || '...'
             AS sample_context, regexp_matches(token, '^[A-Z]{{2,8}}$') AS is_acronym FROM f""",
)
def rare_tokens(t: Inputs):
    return L.rare_tokens(t.documents)


# ---------------------------------------------------------------- screenplay


def _sha(parts: list[str], sep: str) -> str:
    return f"substr(sha256({f' || {sep!r} || '.join(parts)}), 1, 16)"


def _norm(col: str, default: str) -> str:
    return f"coalesce(nullif({col}, ''), '{default}')"


def seg_hash(p: str = "") -> str:
    return _sha(
        [f"lower(trim({_norm(p + 'speaker', 'Narrator')}))", f"lower(trim({_norm(p + 'direction', '')}))",
         f"trim({_norm(p + 'text', '')})", f"trim({_norm(p + 'voice_id', 'default')})", "'standard'"],
        "||",
    )


@query("segment_hash", f"SELECT doc_id, seg_idx, {seg_hash()} AS hash FROM script", ["script"])
def segment_hash(t: Inputs):
    return S.segment_hash(t.script).select("doc_id", "seg_idx", "hash")


# A revision: some lines change, some are new, some are gone.
_OLD = "SELECT doc_id, seg_id, speaker, direction, text, voice_id, audio_path FROM script WHERE (doc_id + seg_idx) % 7 <> 3"
_NOW = """
SELECT doc_id, seg_id, speaker, direction, CASE WHEN (doc_id + seg_idx) % 4 = 0 THEN text || ' Revised.' ELSE text END AS text,
       voice_id, CASE WHEN seg_idx % 2 = 0 THEN audio_path END AS audio_path FROM script WHERE (doc_id + seg_idx) % 8 <> 5"""
_DIFF = f"""
    o AS (SELECT doc_id, seg_id, {seg_hash()} AS h FROM ({_OLD}) a),
    n AS (SELECT doc_id, seg_id, audio_path, {seg_hash()} AS h FROM ({_NOW}) a),
    cache AS (SELECT {seg_hash()} AS h, min('cache/' || seg_id) AS p FROM script WHERE seg_idx % 3 = 0 GROUP BY 1),
    d AS (
      SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.seg_id, o.seg_id) AS seg_id, n.h AS new_hash,
             coalesce(c.p, nullif(n.audio_path, '')) AS ap,
             CASE WHEN n.h IS NULL THEN 'removed' WHEN o.h IS NULL THEN 'new'
                  WHEN o.h = n.h AND coalesce(c.p, nullif(n.audio_path, '')) IS NOT NULL THEN 'reusable' ELSE 'dirty' END AS status
      FROM n FULL JOIN o ON n.doc_id = o.doc_id AND n.seg_id = o.seg_id LEFT JOIN cache c ON c.h = n.h)"""


def _revision(t: Inputs):
    old, now = (t.spark.sql(q.replace("FROM script", "FROM {script}"), script=t.script) for q in (_OLD, _NOW))
    cache = S.segment_hash(t.script.where("seg_idx % 3 = 0")).selectExpr("hash", "concat('cache/', seg_id) AS audio_path")
    return S.revision_diff(old, now, cache)


@query(
    "revision_diff",
    f"WITH {_DIFF} SELECT doc_id, seg_id, new_hash, status, CASE WHEN status = 'reusable' THEN ap END AS audio_path FROM d",
    ["script"],
)
def revision_diff(t: Inputs):
    return _revision(t)


@query(
    "revision_summary",
    f"""WITH {_DIFF}
    SELECT doc_id, count_if(status <> 'removed')::BIGINT AS total_segments, count_if(status = 'reusable')::BIGINT AS reusable,
           count_if(status IN ('dirty', 'new'))::BIGINT AS rerender, count_if(status = 'new')::BIGINT AS new_added,
           count_if(status = 'removed')::BIGINT AS removed,
           CASE WHEN count_if(status <> 'removed') > 0 THEN
             floor(count_if(status = 'reusable')::DOUBLE / count_if(status <> 'removed') * 1000 + 0.5) / 10 ELSE 0 END::DOUBLE AS savings_pct
    FROM d GROUP BY doc_id""",
    ["script"],
)
def revision_summary(t: Inputs):
    return S.revision_summary(_revision(t))


_TAKE = """
SELECT doc_id * 100 + seg_idx AS request_id, CASE WHEN seg_idx % 2 = 0 THEN ' Same Line ' ELSE text END AS text, speaker,
       voice_id AS voice, CASE WHEN seg_idx % 3 = 0 THEN NULL ELSE doc_id % 5 END AS seed, emotion, direction AS instruction,
       CASE WHEN seg_idx % 4 = 0 THEN 250 END AS pre_pause_ms, '' AS pitch, (doc_id + seg_idx) % 2 AS f FROM script"""
_TAKE_HASH = _sha(
    [
        "lower(trim(text))", "lower(trim(speaker))", "lower(trim(voice))", "coalesce(CAST(seed AS VARCHAR), 'default')",
        "'inherit'", f"lower(trim({_norm('emotion', 'neutral')}))", "lower(trim(instruction))", "'1.0'", "'medium'", "'medium'",
        "''", "''", "''", "coalesce(CAST(pre_pause_ms AS VARCHAR), '')", "''", "''", "''",
        "CASE WHEN f = 1 THEN 'zed:q;a:x' ELSE '' END",
    ],
    "|",
)


def _requests(t: Inputs):
    rows = t.spark.sql(_TAKE.replace("FROM script", "FROM {script}"), script=t.script)
    return rows.selectExpr("*", "CASE WHEN f = 1 THEN map('Zed', 'Q', 'a', 'X') END AS phonetic_overrides").drop("f")


@query(
    "take_content_hash", f"SELECT request_id, {_TAKE_HASH} AS content_hash FROM ({_TAKE}) q", ["script"]
)
def take_content_hash(t: Inputs):
    return S.take_content_hash(_requests(t)).select("request_id", "content_hash")


@query(
    "cache_plan",
    f"""WITH r AS (SELECT request_id, {_TAKE_HASH} AS h FROM ({_TAKE}) q),
    c AS (SELECT h, arg_max('take_' || request_id, request_id) AS f FROM r WHERE request_id % 5 = 0 GROUP BY h),
    m AS (SELECT h, min(request_id) AS a FROM r GROUP BY h)
    SELECT request_id, r.h AS content_hash, CASE WHEN f IS NOT NULL THEN 'hit' WHEN a = request_id THEN 'render' ELSE 'shared' END AS plan,
           f AS cached_file, CASE WHEN f IS NULL THEN a END AS render_as
    FROM r LEFT JOIN c ON r.h = c.h JOIN m ON r.h = m.h""",
    ["script"],
)
def cache_plan(t: Inputs):
    requests = _requests(t)
    cache = S.take_content_hash(requests.where("request_id % 5 = 0")).selectExpr(
        "content_hash", "concat('take_', request_id) AS file_path", "request_id AS stored_at"
    )
    return S.cache_plan(requests, cache)


def _export(t: Inputs):
    titles = t.view("books").selectExpr(
        "doc_id", "concat('Book ', doc_id) AS title", "'' AS author", "'given tables' AS source",
        "DATE'2024-01-01' AS draft_date",
    )
    flat = t.script.withColumn("text", F.translate("text", "\r\n", "  ")).withColumn(
        "scene_synopsis", F.concat(F.lit("Turn of "), "speaker")
    ).withColumn("chapter_title", F.col("chapter_id")).withColumn("is_chapter_start", F.col("seg_idx") % 3 == 0)
    return S.screenplay_export(flat, titles)


def _slug(h: str) -> str:
    return f"upper({h})"


@query(
    "screenplay_export",
    f"""
    WITH f AS (
      SELECT *, nullif(scene_heading, '') AS h, 'Turn of ' || speaker AS syn, translate(text, chr(13) || chr(10), '  ') AS tx,
             row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) AS n FROM script),
    o AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg_idx
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM f),
    m AS (SELECT *, h IS NOT NULL AND coalesce(h <> was, TRUE) AS opens, type = 'dialogue' AS sp,
                 substr(sha256(lower(trim(speaker)) || '||' || lower(trim(direction)) || '||' || trim(trim(tx, {SP})) || '||'
                   || trim(voice_id) || '||standard'), 1, 16) AS hash FROM o)
    SELECT doc_id, CAST(0 AS BIGINT) AS part_no, 'Title: Book ' || doc_id || chr(10) || 'Author: Unknown Author' || chr(10)
             || 'Source: given tables' || chr(10) || 'Draft date: 2024-01-01' || chr(10) || chr(10) || '=== ' || chr(10) AS text FROM books
    UNION ALL
    SELECT doc_id, n, concat_ws(chr(10), CASE WHEN seg_idx % 3 = 0 THEN '' END, CASE WHEN seg_idx % 3 = 0 THEN '# ' || chapter_id END,
             CASE WHEN seg_idx % 3 = 0 THEN '' END, CASE WHEN opens THEN '' END, CASE WHEN opens THEN {_slug("h")} END,
             CASE WHEN opens THEN '= ' || syn END, CASE WHEN opens THEN '' END, '', CASE WHEN sp THEN '@' || speaker END,
             CASE WHEN sp AND direction <> '' THEN '(' || direction || ')' END, trim(tx, {SP}),
             '/* [[meta: {{"id":"' || seg_id || '","hash":"' || hash || '"' || coalesce(',"conf":' || CAST(confidence AS VARCHAR), '')
               || coalesce(',"audio":"' || audio_path || '"', '') || '}}]] */', '')
    FROM m""",
    ["script", "books"],
)
def screenplay_export(t: Inputs):
    return _export(t)


@query(
    "screenplay_import",
    # Reading back what was exported must give the script again.
    f"""
    WITH f AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) - 1 AS n, nullif(scene_heading, '') AS h,
             'Turn of ' || speaker AS syn FROM script),
    o AS (SELECT *, last_value(h IGNORE NULLS) OVER w AS open_h,
                 last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg_idx
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM f
          WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx)),
    s AS (SELECT *, last_value(CASE WHEN h IS NOT NULL AND coalesce(h <> was, TRUE) THEN syn END IGNORE NULLS)
                      OVER (PARTITION BY doc_id ORDER BY seg_idx) AS open_syn,
                 last_value(CASE WHEN seg_idx % 3 = 0 THEN chapter_id END IGNORE NULLS)
                      OVER (PARTITION BY doc_id ORDER BY seg_idx) AS ch FROM o)
    SELECT doc_id, CAST(n AS INT) AS seg_idx, seg_id, type, speaker, trim(translate(text, chr(13) || chr(10), '  '), {SP}) AS text,
           CASE WHEN type = 'narrator' THEN 'calm, steady narration' ELSE coalesce(nullif(direction, ''), 'expressive dialogue') END AS direction,
           ch AS chapter_title, open_h AS scene_heading, open_syn AS scene_synopsis,
           CASE WHEN type = 'dialogue' THEN confidence END AS confidence, audio_path
    FROM s""",
    ["script"],
)
def screenplay_import(t: Inputs):
    parts = _export(t)
    # The parts of a file, cut into numbered lines without putting the file together.
    lines = parts.select(
        "doc_id", "part_no", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")
    )
    lines = ordered.rerank(lines, ["doc_id"], ["part_no", "i"], "line_no").select("doc_id", "line_no", "line")
    _, segments = S.screenplay_import(lines)
    return segments.drop("hash", "relationship_snapshot")


@query(
    "script_summary",
    f"""
    WITH s AS (SELECT *, {words("text")} AS w, type = 'dialogue' AS sp FROM script),
    a AS (
      SELECT doc_id, count(*) AS total_segments, CAST(sum(w) AS BIGINT) AS total_words, count_if(sp)::BIGINT AS dialogue_lines,
             count_if(NOT sp)::BIGINT AS narrator_lines, count(DISTINCT CASE WHEN sp THEN speaker END) AS unique_characters,
             count(DISTINCT nullif(scene_heading, '')) AS total_scenes,
             count(DISTINCT CASE WHEN scene_heading LIKE 'INT%' THEN scene_heading END) AS interior_scenes,
             count(DISTINCT CASE WHEN scene_heading LIKE 'EXT%' THEN scene_heading END) AS exterior_scenes,
             sum(CASE WHEN sp THEN w ELSE 0 END)::DOUBLE AS dw, sum(w)::DOUBLE AS aw FROM s GROUP BY doc_id),
    r AS (SELECT *, CAST(floor(dw / 150 * 60 + (aw - dw) / 150 * 60 + dialogue_lines * 0.45::DOUBLE + total_scenes * 1.8::DOUBLE + 0.5)
                    AS BIGINT) AS runtime_seconds FROM a)
    SELECT * EXCLUDE (dw, aw), CAST(runtime_seconds // 60 AS VARCHAR) || 'm ' || lpad(CAST(runtime_seconds % 60 AS VARCHAR), 2, '0') || 's'
           AS runtime FROM r""",
    ["script"],
)
def script_summary(t: Inputs):
    return S.script_summary(t.script)


_BREAKDOWN = f"""
    st AS (
      SELECT doc_id, speaker, count(*) AS line_count, CAST(sum({words("text")}) AS BIGINT) AS word_count, avg(confidence) AS c
      FROM script WHERE type = 'dialogue' GROUP BY ALL),
    pc AS (SELECT *, floor(line_count / (sum(line_count) OVER (PARTITION BY doc_id))::DOUBLE * 1000 + 0.5) / 10 AS pct FROM st),
    bd AS (
      SELECT pc.doc_id, pc.speaker, line_count, word_count, pct AS dialogue_line_pct,
             coalesce(floor(c * 100 + 0.5) / 100, 1.0) AS average_confidence, p.voice_id IS NOT NULL AS has_assigned_voice,
             p.voice_id AS assigned_voice_id,
             CASE WHEN pct >= 20 THEN 'Lead / Primary Cast (Dedicated Cloned Voice)'
                  WHEN pct >= 5 THEN 'Supporting Cast (High-Quality Character Voice)'
                  WHEN line_count <= 2 THEN 'One-Off / Cameo (Candidate for Attribution Sanity Audit)'
                  ELSE 'Incidental / Minor' END AS casting_tier
      FROM pc LEFT JOIN people p ON pc.doc_id = p.doc_id AND pc.speaker = p.name)"""


@query("character_breakdown", f"WITH {_BREAKDOWN} SELECT * FROM bd", ["script", "people"])
def character_breakdown(t: Inputs):
    return S.character_breakdown(t.script, t.people)


@query(
    "sanity_flags",
    f"""WITH {_BREAKDOWN}
    SELECT doc_id, speaker, 'SUSPICIOUS_LOW_LINE_COUNT' AS flag, 'low' AS severity, 'Character "' || speaker || '" has only '
      || line_count || ' dialogue line(s). Check if this is an attribution alias mistake.' AS message FROM bd WHERE line_count <= 2
    UNION ALL
    SELECT doc_id, speaker, 'LOW_CONFIDENCE_ATTRIBUTION', 'medium', 'Attribution confidence for "' || speaker || '" averages '
      || CAST(average_confidence AS VARCHAR) || '. Verification recommended.' FROM bd WHERE average_confidence < 0.70""",
    ["script", "people"],
)
def sanity_flags(t: Inputs):
    return S.sanity_flags(S.character_breakdown(t.script, t.people))


@query(
    "scene_cards",
    f"""
    WITH s AS (SELECT *, coalesce(nullif(scene_heading, ''), 'SCENE 1 (DEFAULT)') AS h FROM script),
    o AS (SELECT *, CASE WHEN h <> lag(h) OVER w OR lag(h) OVER w IS NULL THEN 1 ELSE 0 END AS op FROM s
          WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx)),
    g AS (SELECT *, CAST(sum(op) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS BIGINT) AS scene_number FROM o),
    c AS (
      SELECT doc_id, scene_number, min(h) AS scene_heading, 'Chapter' AS chapter_title, 'No synopsis recorded.' AS synopsis,
             coalesce(string_agg(DISTINCT CASE WHEN type = 'dialogue' THEN speaker END, ',' ORDER BY CASE WHEN type = 'dialogue' THEN speaker END), '')
               AS characters_present,
             count_if(type = 'dialogue')::BIGINT AS dialogue_lines, count_if(type <> 'dialogue')::BIGINT AS narrator_lines,
             CAST(sum({words("text")}) AS BIGINT) AS word_count, arg_min(seg_id, seg_idx) AS start_segment_id,
             arg_max(seg_id, seg_idx) AS end_segment_id
      FROM g GROUP BY doc_id, scene_number),
    r AS (SELECT *, CAST(floor(word_count / 150::DOUBLE * 60 + dialogue_lines * 0.45::DOUBLE + 0.5) AS BIGINT) AS runtime_seconds FROM c)
    SELECT *, CAST(runtime_seconds // 60 AS VARCHAR) || 'm ' || lpad(CAST(runtime_seconds % 60 AS VARCHAR), 2, '0') || 's' AS runtime FROM r""",
    ["script"],
)
def scene_cards(t: Inputs):
    cards = S.scene_cards(t.script)
    return cards.withColumn("characters_present", F.array_join("characters_present", ","))
