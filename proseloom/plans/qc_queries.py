"""Queries over quality control, triage, the decision log and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import emotion as E
from ..operators import calibration as K
from ..operators import qc as Q
from ..operators import text as X
from .inputs import Inputs
from .registry import query, rounded
from .text_queries import SP, words

# ---------------------------------------------------------------- transcripts

# Transcripts with lost, changed and added words, by position in the text.
_HEARD = """
SELECT doc_id, seg_id, CASE seg_idx % 4 WHEN 0 THEN text
         WHEN 1 THEN replace(text, ' the ', ' ') WHEN 2 THEN replace(upper(text), ' IN ', ' inn inn ')
         ELSE replace(replace(text, '.', ' uh'), ',', '') END AS transcribed_text
FROM script"""


def _wer(t: Inputs):
    heard = t.spark.sql(_HEARD.replace("FROM script", "FROM {script}"), script=t.script)
    return Q.transcript_wer(t.script, heard)


@query("transcript_wer")
def transcript_wer(t: Inputs):
    return _wer(t)


@query("corpus_wer")
def corpus_wer(t: Inputs):
    return Q.corpus_wer(_wer(t), "doc_id", "speaker")


# ---------------------------------------------------------------- takes

_CPS = rounded(f"length(trim(text, {SP})) / duration_s", 2)
_WPS = rounded(f"{words(f'trim(text, {SP})')} / duration_s", 2)
_PACED = f"""
    paced AS (
      SELECT *, CASE WHEN ok THEN {_CPS} ELSE 0 END::DOUBLE AS chars_per_second,
             CASE WHEN ok THEN {_WPS} ELSE 0 END::DOUBLE AS words_per_second
      FROM (SELECT *, trim(text, {SP}) <> '' AND duration_s > 0 AS ok FROM takes) q),
    status AS (
      SELECT *, CASE WHEN NOT ok THEN 'unknown' WHEN chars_per_second < 8 THEN 'severe_sluggish'
                     WHEN chars_per_second < 11 THEN 'slow' WHEN chars_per_second > 25 THEN 'severe_rushed'
                     WHEN chars_per_second > 19 THEN 'fast' ELSE 'optimal' END AS pacing_status FROM paced),
    scored AS (
      SELECT *, CASE pacing_status WHEN 'unknown' THEN 1.0 WHEN 'severe_sluggish' THEN 0.85
                     WHEN 'severe_rushed' THEN 0.90 WHEN 'optimal' THEN 0.0 ELSE 0.35 END::DOUBLE AS anomaly_score
      FROM status)"""
_TAKES = """
SELECT doc_id, text, CASE WHEN doc_id % 17 = 0 THEN 0.0 ELSE CAST(n_chars AS DOUBLE) / (6 + doc_id % 24) END
       AS duration_s FROM documents"""


def _paced(t: Inputs):
    takes = t.spark.sql(_TAKES.replace("FROM documents", "FROM {documents}"), documents=t.documents)
    return Q.pacing_qc(takes)


@query(
    "pacing_qc",
    f"""WITH takes AS ({_TAKES}), {_PACED}
    SELECT doc_id, chars_per_second, words_per_second, pacing_status, anomaly_score,
      CASE pacing_status WHEN 'unknown' THEN 'Zero text length or invalid audio duration'
        WHEN 'severe_sluggish' THEN 'Sluggish pacing: ' || chars_per_second || ' chars/sec (expected >= 8)'
        WHEN 'slow' THEN 'Slow cadence: ' || chars_per_second || ' chars/sec'
        WHEN 'fast' THEN 'Fast cadence: ' || chars_per_second || ' chars/sec'
        WHEN 'severe_rushed' THEN 'Fast-forward glitch or rushed pacing: ' || chars_per_second
          || ' chars/sec (expected <= 25)' END AS anomaly_reason FROM scored""",
)
def pacing_qc(t: Inputs):
    return _paced(t).drop("text", "duration_s")


def _cos(a: str, b: str) -> str:
    x, y = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    norm = f"(sqrt(list_inner_product({x}, {x})) * sqrt(list_inner_product({y}, {y})))"
    return rounded(f"list_inner_product({x}, {y}) / {norm}", 4)


_LIMIT = "CASE band WHEN 5 THEN 0.60 WHEN 4 THEN 0.65 WHEN 3 THEN 0.70 WHEN 2 THEN 0.73 ELSE 0.75 END::DOUBLE"
_DRIFT = f"""
    near AS (
      SELECT v.*, a.embedding IS NOT NULL AS has,
             CASE WHEN a.embedding IS NULL THEN 1.0 ELSE {_cos("v.embedding", "a.embedding")} END AS sim
      FROM voices v LEFT JOIN anchors a ON v.doc_id = a.doc_id AND v.char_id = a.char_id),
    drift AS (
      SELECT doc_id, take_id, char_id, band, sim AS similarity_score,
             CASE WHEN has THEN {rounded("1.0 - sim", 4)} ELSE 0.0 END AS drift_distance,
             CASE WHEN has THEN {_LIMIT} ELSE 0.75 END AS effective_threshold,
             has AND sim < {_LIMIT} AS is_drift_outlier, has FROM near)"""


@query(
    "timbre_drift", f"WITH {_DRIFT} SELECT * EXCLUDE (has) FROM drift", ["voices", "anchors"]
)
def timbre_drift(t: Inputs):
    takes = t.view("voices").select("doc_id", "take_id", "char_id", "band", "embedding")
    return Q.timbre_drift(takes, t.view("anchors")).drop("embedding")


_MARGIN = f"""
    {_DRIFT},
    rivals AS (
      SELECT v.doc_id, v.take_id, a.char_id AS who, {_cos("v.embedding", "a.embedding")} AS sim, a.ord
      FROM voices v JOIN anchors a ON v.doc_id = a.doc_id AND v.char_id <> a.char_id),
    best AS (SELECT * FROM rivals QUALIFY row_number() OVER (PARTITION BY doc_id, take_id ORDER BY sim DESC, ord) = 1),
    margin AS (
      SELECT d.doc_id, d.take_id, d.char_id, d.similarity_score AS intended_similarity,
             CASE WHEN has THEN b.sim ELSE 0.0 END AS highest_competing_similarity,
             CASE WHEN has THEN b.who END AS closest_competitor,
             CASE WHEN has THEN {rounded("d.similarity_score - b.sim", 4)} ELSE 1.0 END AS margin_delta,
             NOT has OR {rounded("d.similarity_score - b.sim", 4)} >= 0.05 AS passed
      FROM drift d JOIN best b ON d.doc_id = b.doc_id AND d.take_id = b.take_id)"""


@query("identity_margin", f"WITH {_MARGIN} SELECT * FROM margin", ["voices", "anchors"])
def identity_margin(t: Inputs):
    return Q.identity_margin(t.view("voices"), t.view("anchors"))


_SIGNALS = """
SELECT doc_id, n_chars, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(doc_id * 7 % 101 AS DOUBLE) END AS stt_match_pct,
       CAST(n_chars % 20 AS DOUBLE) / 20 AS anomaly_score, CAST(doc_id % 13 AS DOUBLE) / 10 AS drift_distance
FROM documents"""
_HEALTH = rounded(
    "coalesce(stt_match_pct, 100) / 100.0 * 0.50 + (1.0 - anomaly_score) * 0.30 + (1.0 - least(drift_distance, 1.0)) * 0.20", 3
)


@query(
    "acoustic_health",
    f"""WITH s AS ({_SIGNALS}), h AS (SELECT doc_id, {_HEALTH} AS acoustic_score FROM s)
    SELECT doc_id, acoustic_score, CASE WHEN acoustic_score < 0.60 THEN 'critical' WHEN acoustic_score < 0.78 THEN 'high'
           WHEN acoustic_score < 0.88 THEN 'medium' ELSE 'low' END AS risk_level FROM h""",
)
def acoustic_health(t: Inputs):
    signals = t.spark.sql(_SIGNALS.replace("FROM documents", "FROM {documents}"), documents=t.documents)
    return Q.acoustic_health(signals).select("doc_id", "acoustic_score", "risk_level")


# ---------------------------------------------------------------- triage

# A line per event: one user's events are one book, so some books are long.
_LINES = """
SELECT user_id AS doc_id, event_id AS seg_idx,
       CASE WHEN event_id % 23 = 0 THEN 'Unknown' ELSE event_type END AS speaker,
       CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST((event_id * 37) % 101 AS DOUBLE) / 100 END AS confidence,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 60.0 + CAST((event_id * 17) % 41 AS DOUBLE) END AS match_pct,
       CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.35 WHEN 2 THEN 0.85 ELSE 0.9 END AS anomaly_score,
       CASE event_id % 4 WHEN 0 THEN 'optimal' WHEN 1 THEN 'slow' WHEN 2 THEN '' ELSE 'severe_rushed' END AS pacing_status,
       CAST(event_id % 30 AS DOUBLE) + 0.5 AS chars_per_second,
       CAST(event_id % 61 AS DOUBLE) / 100 AS drift_distance,
       1.0 - CAST(event_id % 61 AS DOUBLE) / 100 AS similarity_score,
       event_id % 19 = 0 AS is_flagged
FROM events"""
_RAW = """greatest(0, least(1, 1.0 - coalesce(confidence, 1.0))) * 0.35
        + greatest(0, least(1, 1.0 - coalesce(match_pct, 100.0) / 100.0)) * 0.30
        + anomaly_score * 0.20 + drift_distance * 0.15"""
_RISK = f"""
    lines AS ({_LINES.replace(" 0.0 WHEN", " 0.0::DOUBLE WHEN")}),
    r AS (SELECT *, {rounded(f"greatest(0, least(1, {_RAW}))", 3)} AS risk_score FROM lines),
    risk AS (
      SELECT *, CASE WHEN risk_score >= 0.50 OR lower(speaker) = 'unknown' THEN 'critical'
                     WHEN risk_score >= 0.32 THEN 'high' WHEN risk_score >= 0.15 THEN 'medium' ELSE 'low' END AS risk_tier,
             concat_ws('; ',
               CASE WHEN confidence < 0.60 THEN 'Low attribution confidence (' || CAST(round(CAST(confidence * 100 AS DECIMAL(18,6))) AS INT) || '%)' END,
               CASE WHEN lower(speaker) = 'unknown' THEN 'Unresolved speaker identity (marked unknown)' END,
               CASE WHEN match_pct < 90 THEN 'STT mismatch (' || CAST(round(match_pct) AS INT) || '% match against expected text)' END,
               CASE WHEN anomaly_score > 0.40 THEN 'Pacing anomaly: ' || coalesce(nullif(pacing_status, ''), 'irregular')
                    || ' (' || chars_per_second || ' chars/sec)' END,
               CASE WHEN drift_distance > 0.25 THEN 'Voice timbre drift ('
                    || CAST(round(CAST(similarity_score * 100 AS DECIMAL(18,6))) AS INT) || '% match to character anchor)' END)
               AS reasons
      FROM r)"""


def _lines(t: Inputs):
    return t.spark.sql(_LINES.replace("FROM events", "FROM {events}"), events=t.table("events"))


@query("segment_risk", f"WITH {_RISK} SELECT doc_id, seg_idx, risk_score, risk_tier, reasons FROM risk")
def segment_risk(t: Inputs):
    return Q.segment_risk(_lines(t)).select(
        "doc_id", "seg_idx", "risk_score", "risk_tier", F.array_join("triage_reasons", "; ").alias("reasons")
    )


@query(
    "risk_queue",
    f"""WITH {_RISK},
    n AS (SELECT doc_id, greatest(1, ceil(count(*) * 20.0 / 100)) AS top FROM risk GROUP BY ALL),
    q AS (SELECT doc_id, seg_idx, risk_score, risk_tier,
                 row_number() OVER (PARTITION BY doc_id ORDER BY risk_score DESC, seg_idx) AS queue_pos
          FROM risk WHERE risk_tier IN ('medium', 'high', 'critical'))
    SELECT q.* FROM q JOIN n ON q.doc_id = n.doc_id WHERE queue_pos <= top""",
)
def risk_queue(t: Inputs):
    queue = Q.risk_queue(Q.segment_risk(_lines(t)), top_pct=20.0, min_tier="medium")
    return queue.select("doc_id", "seg_idx", "risk_score", "risk_tier", "queue_pos")


@query(
    "doubtful_lines",
    f"""WITH lines AS ({_LINES}),
    d AS (SELECT *, is_flagged OR coalesce(confidence < 0.70, FALSE) OR lower(speaker) IN ('', 'unknown', 'character')
                    AS is_doubtful FROM lines),
    w AS (
      SELECT *, min(CASE WHEN is_doubtful THEN seg_idx END) OVER (PARTITION BY doc_id ORDER BY seg_idx
                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later,
             min(CASE WHEN is_doubtful THEN seg_idx END) OVER (PARTITION BY doc_id) AS first,
             count_if(is_doubtful) OVER (PARTITION BY doc_id) AS doubt_count FROM d)
    SELECT doc_id, seg_idx, is_doubtful, CASE WHEN is_doubtful THEN 'red' WHEN confidence < 0.85 THEN 'yellow'
           ELSE 'green' END AS bucket, coalesce(later, first) AS next_doubtful, CAST(doubt_count AS BIGINT) AS doubt_count
    FROM w""",
)
def doubtful_lines(t: Inputs):
    return Q.doubtful_lines(_lines(t)).select(
        "doc_id", "seg_idx", "is_doubtful", "bucket", "next_doubtful", "doubt_count"
    )


# ---------------------------------------------------------------- decision log

_GATE = f"""
    g0 AS (
      SELECT d.*, p.fitted_temperature IS NOT NULL AS fitted,
             CASE WHEN p.boundary_pegged AND p.is_provisional THEN greatest(0.5, least(2.0, p.fitted_temperature))
                  ELSE p.fitted_temperature END AS tt,
             greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, raw_probability)) AS pp,
             coalesce(nullif(p.auto_approve_threshold, 0), 0.90) AS hi, coalesce(nullif(p.review_threshold, 0), 0.50) AS lo,
             p.is_provisional AS prov, p.boundary_pegged AS peg
      FROM decisions d LEFT JOIN params p ON d.question_type = p.question_type),
    g1 AS (SELECT *, 1 / (1 + exp(-ln(pp / (1 - pp)) / tt)) AS q FROM g0),
    gate AS (
      SELECT id, question_type, claim, answer, raw_probability,
             CASE WHEN fitted THEN {rounded("q", 4)} ELSE raw_probability END AS calibrated_probability,
             fitted AS is_calibrated, CASE WHEN fitted THEN prov ELSE TRUE END AS is_provisional,
             CASE WHEN fitted THEN peg ELSE FALSE END AS boundary_pegged,
             CASE WHEN NOT fitted THEN 'needs_review' WHEN q >= hi THEN 'auto_approved'
                  WHEN q < lo THEN 'flagged_disagreement' ELSE 'needs_review' END AS calibrated_gate
      FROM g1)"""


def _log(t: Inputs):
    return t.view("decisions").select("id", "question_type", "claim", "answer", "raw_probability")


@query("temperature_gate", f"WITH {_GATE} SELECT * FROM gate", ["decisions", "params"])
def temperature_gate(t: Inputs):
    return Q.temperature_gate(_log(t), t.view("params"))


_DECIDED = """
    SELECT *, CASE question_type WHEN 'relationship_evidence' THEN CASE WHEN raw_probability >= 0.5 THEN 'citation_supported'
                ELSE 'citation_unsupported' END
              WHEN 'speaker_attribution' THEN NULL
              ELSE CASE WHEN raw_probability >= 0.5 THEN 'verified' ELSE 'unverified' END END AS decision,
           CASE question_type WHEN 'character_existence' THEN CASE WHEN raw_probability >= 0.5 THEN 'present' ELSE 'absent' END
              WHEN 'relationship_evidence' THEN CASE WHEN raw_probability >= 0.5 THEN 'supported' ELSE 'unsupported' END
              WHEN 'emotion' THEN CASE WHEN raw_probability >= 0.5 THEN lower(claim) ELSE 'other_tone' END
              ELSE answer END AS choice,
           CASE WHEN question_type = 'relationship_evidence' THEN
             CASE WHEN raw_probability >= 0.5 THEN 'ok' ELSE 'unsupported_citation' END END AS alert_status,
           CASE WHEN question_type = 'speaker_attribution' THEN lower(claim) = lower(answer) END AS is_agreement,
           {gate} AS gate_status FROM gate"""


@query(
    "qc_gate_decisions",
    f"WITH {_GATE} {_DECIDED.format(gate='calibrated_gate')}",
    ["decisions", "params"],
)
def qc_gate_decisions(t: Inputs):
    return Q.qc_gate_decisions(_log(t), t.view("params"), mode="enforce")


# Human labels as verdicts on a decision per document; some documents have none.
_VERDICTS = """
SELECT 'd' || CAST(doc_id AS STRING) AS id, quality = 1 AS verdict, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS notes,
       doc_id AS ts FROM labels
UNION ALL
SELECT 'd' || CAST(doc_id * 3 AS STRING), toxic = 0, 'second look', doc_id + 1000000000 FROM labels WHERE doc_id % 4 = 0"""
_OPEN = """
SELECT 'd' || CAST(doc_id AS STRING) AS id, source AS question_type, CASE WHEN doc_id % 10 = 0 THEN TRUE END AS human_verdict,
       CASE WHEN doc_id % 5 = 0 THEN 'first note' END AS notes, n_chars % 3 = 0 AS is_agreement FROM documents"""
_MARKED = f"""
    v AS ({_VERDICTS}), d AS ({_OPEN}),
    latest AS (SELECT id, arg_max(verdict, ts) AS verdict, arg_max(notes, ts) FILTER (notes <> '') AS notes
               FROM v GROUP BY id),
    marked AS (
      SELECT d.id, question_type, is_agreement, CASE WHEN l.id IS NOT NULL THEN l.verdict ELSE human_verdict END AS human_verdict,
             coalesce(l.notes, d.notes) AS notes, l.id IS NOT NULL AS was_updated
      FROM d LEFT JOIN latest l ON d.id = l.id)"""


def _marked(t: Inputs):
    verdicts = t.spark.sql(_VERDICTS.replace("FROM labels", "FROM {labels}"), labels=t.table("labels"))
    log = t.spark.sql(_OPEN.replace("FROM documents", "FROM {documents}"), documents=t.documents)
    return Q.record_verdicts(log, verdicts)


@query("record_verdicts", f"WITH {_MARKED} SELECT * FROM marked")
def record_verdicts(t: Inputs):
    return _marked(t)


@query(
    "qc_stats",
    f"""WITH {_MARKED}
    SELECT coalesce(question_type, '(all)') AS task, count(*) AS total, count(human_verdict) AS with_verdict,
           CAST(count_if(is_agreement) AS BIGINT) AS agreements FROM marked GROUP BY ROLLUP (question_type)""",
)
def qc_stats(t: Inputs):
    return Q.qc_stats(_marked(t))


# ---------------------------------------------------------------- calibration

_LABELLED = """
    rows AS (
      SELECT question_type, idx, raw_probability AS p, CAST(human_verdict AS INT) AS y, is_agreement FROM decisions
      WHERE human_verdict IS NOT NULL)"""


def _labelled(t: Inputs):
    return K.labelled(t.view("decisions"))


@query(
    "calibration_ece_brier",
    f"""WITH {_LABELLED},
    b AS (
      SELECT question_type, least(9, floor(p * 10)) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy,
             sum((p - y) * (p - y)) AS sq,
             sum(CASE WHEN y = 1 THEN -ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p)))
                      ELSE -ln(1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p))) END) AS loss
      FROM rows GROUP BY ALL)
    SELECT question_type, CAST(sum(n) AS BIGINT) AS sample_count, {rounded("sum(n * abs(sy / n - sp / n)) / sum(n)", 4)} AS ece,
           {rounded("sum(sq) / sum(n)", 4)} AS brier, {rounded("sum(loss) / sum(n)", 4)} AS nll FROM b GROUP BY ALL""",
    ["decisions"],
)
def calibration_ece_brier(t: Inputs):
    return K.calibration_ece_brier(_labelled(t))


# The root of the loss slope by halving the range of the inverse temperature, on the same counts.
_SLOPE = "sum(n * z * (1 / (1 + exp(-z * (lo + hi) / 2)) - y))"
_FIT = f"""
    WITH RECURSIVE {_LABELLED},
    counted AS MATERIALIZED (
      SELECT question_type, y, ln(q / (1 - q)) AS z, count(*) AS n
      FROM (SELECT question_type, y, greatest({K.CLIP}::DOUBLE, least(1 - {K.CLIP}::DOUBLE, p)) AS q FROM rows) c GROUP BY ALL),
    halved AS (
      SELECT question_type, 0 AS k, 1 / {K.T_MAX}::DOUBLE AS lo, 1 / {K.T_MIN}::DOUBLE AS hi FROM counted GROUP BY question_type
      UNION ALL
      SELECT h.question_type, any_value(k) + 1, CASE WHEN {_SLOPE} < 0 THEN any_value((lo + hi) / 2) ELSE any_value(lo) END,
             CASE WHEN {_SLOPE} < 0 THEN any_value(hi) ELSE any_value((lo + hi) / 2) END
      FROM halved h JOIN counted c ON h.question_type = c.question_type WHERE k < 60 GROUP BY h.question_type),
    fits AS (
      SELECT question_type, {rounded("2 / (lo + hi)", 4)} AS t FROM halved WHERE k = 60),
    sizes AS (SELECT question_type, sum(n)::BIGINT AS sample_count FROM counted GROUP BY ALL)
    SELECT question_type, sample_count, t AS fitted_temperature, low OR high AS boundary_pegged,
           CASE WHEN low THEN 'lower' WHEN high THEN 'upper' END AS pegged_boundary,
           low OR high OR sample_count < {K.MIN_SAMPLES} AS is_provisional
    FROM (SELECT *, abs(t - {K.T_MIN}) <= {K.PEG_MARGIN} AS low, abs(t - {K.T_MAX}) <= {K.PEG_MARGIN} AS high FROM fits JOIN sizes USING (question_type)) f"""


@query("fit_temperature", _FIT, ["decisions"])
def fit_temperature(t: Inputs):
    return K.fit_temperature(_labelled(t))


@query(
    "derive_thresholds",
    f"""WITH {_LABELLED},
    run AS (
      SELECT question_type, p, row_number() OVER w AS n, CAST(sum(y) OVER w AS DOUBLE) / row_number() OVER w AS acc FROM rows
      WINDOW w AS (PARTITION BY question_type ORDER BY p DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    s AS (SELECT question_type, min(CASE WHEN acc < 0.95 AND n >= 5 THEN n END) AS stop FROM run GROUP BY ALL),
    b AS (
      SELECT r.question_type, coalesce(min(CASE WHEN acc >= 0.95 AND n < coalesce(stop, 1e18) THEN p END), 0.90) AS best
      FROM run r JOIN s ON r.question_type = s.question_type GROUP BY ALL)
    SELECT question_type, {rounded("greatest(0.70, least(0.98, best))", 2)} AS auto_approve_threshold,
           {rounded("greatest(0.40, least(0.60, best - 0.35))", 2)} AS review_threshold FROM b""",
    ["decisions"],
)
def derive_thresholds(t: Inputs):
    return K.derive_thresholds(_labelled(t))


@query(
    "attribution_agreement",
    f"""WITH {_LABELLED}
    SELECT question_type, count(*) AS sample_count, {rounded("avg(CAST(is_agreement AS INT))", 3)} AS agreement_rate,
           {rounded("avg(y)", 3)} AS human_approval_rate, count(*) < 30 AS is_provisional FROM rows GROUP BY ALL""",
    ["decisions"],
)
def attribution_agreement(t: Inputs):
    return K.attribution_agreement(_labelled(t))


@query("calibration_report")
def calibration_report(t: Inputs):
    return K.calibration_report(t.view("decisions"))


# ---------------------------------------------------------------- span evaluation


def _evaluated(t: Inputs):
    prose = t.view("prose").where("text <> '***'")
    passages = prose.selectExpr("concat_ws('_', doc_id, para_idx) AS passage_id", "text")
    quoted = X.segment_quoted(prose.select("doc_id", "para_idx", "text")).selectExpr(
        "concat_ws('_', doc_id, para_idx) AS passage_id", "piece_idx AS ord", "type", "text",
        "CASE WHEN type = 'dialogue' THEN 'c0' ELSE 'Narrator' END AS speaker",
    )
    unmarked = X.segment_unmarked(prose.select("doc_id", "para_idx", "text")).selectExpr(
        "concat_ws('_', doc_id, para_idx) AS passage_id", "piece_idx AS ord", "type", "text",
        "CASE WHEN type = 'dialogue' THEN concat('C', piece_idx % 2) ELSE 'Narrator' END AS speaker",
    )
    everything = passages.selectExpr("passage_id", "0 AS ord", "'dialogue' AS type", "trim(text) AS text", "'c0' AS speaker")
    predicted = unmarked.withColumn("method", F.lit("unmarked")).unionByName(
        everything.withColumn("method", F.lit("everything"))
    )
    return K.span_eval(quoted, predicted, passages)


@query("span_eval")
def span_eval(t: Inputs):
    return _evaluated(t)


@query("method_leaderboard")
def method_leaderboard(t: Inputs):
    return K.method_leaderboard(_evaluated(t))


# ---------------------------------------------------------------- auditions

_EMO = "split_part('angry|sad|calm', '|', CAST(take_id % 3 AS INT) + 1)"
_LABELS = " ".join(
    f"WHEN '{e}{i}' THEN '{row[0]}'" for e in ("angry", "sad", "calm") for i, row in enumerate(E.BANDS[e], 1)
)
_CELLS = f"""
    {_MARGIN},
    c0 AS (
      SELECT v.doc_id, v.take_id, v.char_id, {_EMO.replace("take_id", "v.take_id")} AS emotion, v.band, stt_accuracy_pct AS stt, chars_per_second AS cps,
             CASE WHEN has THEN sim ELSE 0.0 END AS s, {_LIMIT.replace("band", "v.band")} AS lim,
             CASE WHEN has THEN m.margin_delta ELSE 1.0 END AS md, m.closest_competitor AS cc, m.passed AS apart
      FROM near v JOIN margin m ON v.doc_id = m.doc_id AND v.take_id = m.take_id),
    cells AS (
      SELECT doc_id, take_id, char_id, emotion, band, CASE emotion || band {_LABELS} END AS band_label,
             s AS identity_similarity, lim AS band_threshold,
             s >= lim AND stt >= 85 AND cps BETWEEN 7.5 AND 26 AND apart AS passed,
             concat_ws('; ', CASE WHEN s < lim THEN 'Timbre' END, CASE WHEN stt < 85 THEN 'STT' END,
               CASE WHEN NOT cps BETWEEN 7.5 AND 26 THEN 'Pacing' END, CASE WHEN NOT apart THEN 'Closest' END) AS failures
      FROM c0)"""


def _cells(t: Inputs):
    return K.calibration_cell(t.view("voices").withColumn("emotion", F.expr(_EMO)), t.view("anchors"))


@query("calibration_cell", f"WITH {_CELLS} SELECT * FROM cells", ["voices", "anchors"])
def calibration_cell(t: Inputs):
    words_ = F.transform("failure_reasons", lambda r: F.split(r, " ")[0])
    return _cells(t).withColumn("failures", F.array_join(words_, "; ")).drop("failure_reasons")


@query(
    "capability_caps",
    f"""WITH {_CELLS} SELECT doc_id, char_id, emotion, coalesce(max(CASE WHEN passed THEN band END), 1) AS max_band
    FROM cells GROUP BY ALL""",
    ["voices", "anchors"],
)
def capability_caps(t: Inputs):
    return K.capability_caps(_cells(t))


@query(
    "learned_thresholds",
    f"""WITH {_CELLS}, m AS (SELECT doc_id, char_id, band, {rounded("avg(identity_similarity) * 0.90", 2)} AS l
                             FROM cells GROUP BY ALL),
    g AS (SELECT DISTINCT doc_id, char_id, b.band FROM cells CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS band) b)
    SELECT g.doc_id, g.char_id, g.band, coalesce(l, {_LIMIT.replace("band", "g.band")}) AS threshold, l IS NOT NULL AS is_learned
    FROM g LEFT JOIN m ON g.doc_id = m.doc_id AND g.char_id = m.char_id AND g.band = m.band""",
    ["voices", "anchors"],
)
def learned_thresholds(t: Inputs):
    return K.learned_thresholds(_cells(t))


_TARGETS = """
SELECT doc_id, name || ' ' || CAST(ord AS STRING) AS target_id,
       CASE WHEN ord = 1 THEN split_part(name, ' ', 1) ELSE name END AS character,
       CASE WHEN ord = 0 THEN 'joy' WHEN ord = 1 THEN '' ELSE 'fear' END AS emotion,
       CASE WHEN ord = 1 THEN 3 END AS band
FROM people WHERE ord < 2"""


@query(
    "calibration_candidates",
    f"""WITH tg AS ({_TARGETS}),
    ln AS (
      SELECT doc_id, seg_idx, seg_id, speaker, lower(trim(speaker)) AS who, trim(text, {SP}) AS txt,
             CASE WHEN emotion <> '' THEN lower(emotion) ELSE lower(regexp_extract(direction,
               '(?i)\\b(angry|anger|fear|fearful|sad|sadness|happy|joy|whisper|excited|calm)\\b', 1)) END AS e,
             CASE WHEN intensity <= 0.20 THEN 1 WHEN intensity <= 0.40 THEN 2 WHEN intensity <= 0.65 THEN 3
                  WHEN intensity <= 0.85 THEN 4 ELSE 5 END AS b
      FROM script WHERE type = 'dialogue' AND length(trim(text, {SP})) BETWEEN 15 AND 350)
    SELECT ln.doc_id, target_id, CAST(row_number() OVER (PARTITION BY ln.doc_id, target_id ORDER BY seg_idx) AS INT) AS rank,
           seg_idx, seg_id, speaker, txt AS text,
           coalesce(nullif(ln.e, ''), nullif(lower(tg.emotion), ''), 'neutral') AS emotion, ln.b AS band,
           CAST(length(txt) AS INT) AS character_length
    FROM ln JOIN tg ON ln.doc_id = tg.doc_id
      AND (contains(ln.who, lower(tg.character)) OR contains(lower(tg.character), ln.who))
      AND (tg.emotion = '' OR ln.e = '' OR contains(ln.e, tg.emotion) OR contains(tg.emotion, ln.e))
      AND (tg.band IS NULL OR tg.band = ln.b)
    QUALIFY row_number() OVER (PARTITION BY ln.doc_id, target_id ORDER BY seg_idx) <= 5""",
    ["people", "script"],
)
def calibration_candidates(t: Inputs):
    targets = t.spark.sql(_TARGETS.replace("FROM people", "FROM {people}"), people=t.view("people"))
    return K.calibration_candidates(t.script, targets)


@query(
    "phonetic_tuning_eval",
    f"""WITH {_DRIFT}, s AS (SELECT d.doc_id, d.take_id, d.char_id, CASE WHEN d.has THEN d.similarity_score ELSE 0.0 END AS s,
                               stt_accuracy_pct AS a FROM drift d JOIN voices v ON d.take_id = v.take_id)
    SELECT doc_id, take_id, char_id, s AS similarity_score, s >= 0.75 AS is_identity_verified,
           a >= 90 AS is_articulation_clean, s >= 0.75 AND a >= 90 AS passed,
           CASE WHEN s >= 0.75 AND a >= 90 THEN 'tuned_and_verified' ELSE 'tuning_needs_review' END AS status FROM s""",
    ["voices", "anchors"],
)
def phonetic_tuning_eval(t: Inputs):
    return K.phonetic_tuning_eval(t.view("voices"), t.view("anchors"))
