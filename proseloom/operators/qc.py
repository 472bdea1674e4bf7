"""Quality control of takes and attributions, risk triage and the decision gate."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as t

from ..functions import emotion as E
from ..functions import text as T
from ..functions import vectors as V
from . import ordered
from . import relations as R

# ---------------------------------------------------------------- transcripts


def _normalise(text: str | None) -> str:
    lowered = unicodedata.normalize("NFKD", text or "").lower().replace("’", "'").replace("‘", "'")
    kept = (ch if ch.isalnum() or ch.isspace() or ch == "'" else " " for ch in lowered)
    return " ".join("".join(kept).split())


_COMPARED = t.StructType(
    [
        t.StructField("expected_words", t.IntegerType()),
        t.StructField("heard_words", t.IntegerType()),
        t.StructField("expected_left", t.StringType()),
        t.StructField("heard_left", t.StringType()),
        t.StructField("match_pct", t.DoubleType()),
        t.StructField("missing", t.ArrayType(t.StringType())),
        t.StructField("extra", t.ArrayType(t.StringType())),
    ]
)


def _coded(a: list[str], b: list[str]) -> tuple[str, str]:
    """Both word lists without their common ends, each distinct word as one character."""
    lo, short = 0, min(len(a), len(b))
    while lo < short and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < short - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    # Code points above the basic plane.
    seen: dict[str, str] = {}
    left = [seen.setdefault(w, chr(0x10000 + len(seen))) for w in a[lo : len(a) - hi]]
    right = [seen.setdefault(w, chr(0x10000 + len(seen))) for w in b[lo : len(b) - hi]]
    return "".join(left), "".join(right)


@F.pandas_udf(_COMPARED)
def _compare(expected: pd.Series, heard: pd.Series) -> pd.DataFrame:
    out = []
    for left, right in zip(expected, heard, strict=True):
        a, b = _normalise(left), _normalise(right)
        aw, bw = a.split(), b.split()
        if a == b:
            out.append((len(aw), len(bw), "", "", 100.0, [], []))
            continue
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        missing, extra = [], []
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, aw, bw).get_opcodes():
            if tag != "equal":
                missing += aw[i1:i2]
                extra += bw[j1:j2]
        out.append((len(aw), len(bw), *_coded(aw, bw), round(ratio * 100.0, 1), missing, extra))
    return pd.DataFrame(out, columns=_COMPARED.names)


def transcript_wer(segments: DataFrame, transcripts: DataFrame, strict_pct: float = 90.0) -> DataFrame:
    """Word error rate, match share and differing words of each transcript."""
    rows = segments.select("doc_id", "seg_id", "speaker", "text").join(
        transcripts.select("doc_id", "seg_id", "transcribed_text"), ["doc_id", "seg_id"]
    )
    # Comparing two texts costs far more than moving them: spread the lines evenly.
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "doc_id", "seg_id")
    rows = rows.withColumn("c", _compare("text", "transcribed_text"))

    # Edit distance in words: common ends add nothing to it.
    rows = rows.withColumn("__errors", F.levenshtein("c.expected_left", "c.heard_left"))
    n, distance = F.col("c.expected_words"), F.col("__errors")
    wer = F.when(n == 0, F.when(F.col("c.heard_words") == 0, 0.0).otherwise(1.0)).otherwise(
        F.least(F.lit(1.0), distance / n)
    )
    pct = F.col("c.match_pct")
    return rows.select(
        "doc_id",
        "seg_id",
        "speaker",
        n.alias("expected_words"),
        F.when(n > 0, distance).otherwise(0).alias("word_errors"),
        wer.alias("wer"),
        pct.alias("match_pct"),
        F.when(pct >= strict_pct, "passed")
        .when(pct >= strict_pct - 10.0, "warning")
        .otherwise("failed")
        .alias("status"),
        F.col("c.missing").alias("missing_words"),
        F.col("c.extra").alias("extra_words"),
    )


def corpus_wer(scored: DataFrame, *by: str) -> DataFrame:
    """Error rate over all words of a book or speaker."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("expected_words").alias("words"),
        F.sum("word_errors").alias("errors"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.when(F.sum("expected_words") > 0, F.sum("word_errors") / F.sum("expected_words")).alias("corpus_wer"),
    )


# ---------------------------------------------------------------- pace and timbre

# fixed values: characters per second
PACE_MIN, PACE_LOW, PACE_HIGH, PACE_MAX = 8.0, 11.0, 19.0, 25.0


def pacing_qc(takes: DataFrame) -> DataFrame:
    """Speech rate of each take with a status and anomaly score."""
    clean = T.strip(F.coalesce("text", F.lit("")))
    seconds = F.col("duration_s")
    usable = (clean != "") & F.coalesce(seconds > 0, F.lit(False))
    cps, wps = F.round(F.length(clean) / seconds, 2), F.round(T.words(clean) / seconds, 2)
    status = (
        F.when(~usable, "unknown")
        .when(cps < PACE_MIN, "severe_sluggish")
        .when(cps < PACE_LOW, "slow")
        .when(cps > PACE_MAX, "severe_rushed")
        .when(cps > PACE_HIGH, "fast")
        .otherwise("optimal")
    )
    score = {"unknown": 1.0, "severe_sluggish": 0.85, "slow": 0.35, "severe_rushed": 0.90, "fast": 0.35}
    rows = takes.withColumn("chars_per_second", F.when(usable, cps).otherwise(0.0)).withColumn(
        "words_per_second", F.when(usable, wps).otherwise(0.0)
    )
    rows = rows.withColumn("pacing_status", status).withColumn(
        "anomaly_score", E.lookup(F.col("pacing_status"), score, F.lit(0.0))
    )
    rate = F.col("chars_per_second").cast("string")

    def said(before: str, after: str) -> Column:
        return F.concat(F.lit(before), rate, F.lit(after))

    reason = (
        F.when(F.col("pacing_status") == "unknown", "Zero text length or invalid audio duration")
        .when(F.col("pacing_status") == "severe_sluggish", said("Sluggish pacing: ", " chars/sec (expected >= 8)"))
        .when(F.col("pacing_status") == "slow", said("Slow cadence: ", " chars/sec"))
        .when(
            F.col("pacing_status") == "severe_rushed",
            said("Fast-forward glitch or rushed pacing: ", " chars/sec (expected <= 25)"),
        )
        .when(F.col("pacing_status") == "fast", said("Fast cadence: ", " chars/sec"))
    )
    return rows.withColumn("anomaly_reason", reason)


def timbre_drift(takes: DataFrame, anchors: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Similarity of a take to the anchor voice of its character."""
    voice = anchors.select("doc_id", "char_id", F.col("embedding").alias("__anchor"))
    rows = takes.join(voice, ["doc_id", "char_id"], "left")
    known = F.col("embedding").isNotNull() & F.col("__anchor").isNotNull()
    limit = F.when(F.coalesce("band", F.lit(0)) > 0, E.drift_threshold(F.col("band"))).otherwise(
        F.lit(threshold)
    )
    rows = rows.withColumn(
        "similarity_score",
        F.when(known, V.cosine(F.col("embedding"), F.col("__anchor"))).otherwise(F.lit(1.0)),
    )
    return (
        rows.withColumn("drift_distance", F.when(known, F.round(1.0 - F.col("similarity_score"), 4)).otherwise(0.0))
        .withColumn("effective_threshold", F.when(known, limit).otherwise(F.lit(threshold)))
        .withColumn("is_drift_outlier", known & (F.col("similarity_score") < F.col("effective_threshold")))
        .drop("__anchor")
    )


def best_competitor(takes: DataFrame, anchors: DataFrame, chunk: int = 512) -> DataFrame:
    """Most similar anchor of another character, per ``take_id``.

    Anchors travel in packs of at most ``chunk``; each take meets each pack of
    its book in one row and keeps one candidate, so no take-anchor pairs are
    written out whatever the size of the cast.
    """
    packs = ordered.renumber(anchors, ["doc_id"], "ord", "__seat")
    packs = packs.groupBy("doc_id", F.floor(F.col("__seat") / chunk).alias("__pack")).agg(
        F.collect_list(
            F.struct("char_id", "ord", "embedding", F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))).alias("norm"))
        ).alias("pack")
    )
    rows = takes.select(
        "doc_id", "take_id", "char_id", "embedding",
        F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))).alias("__norm"),
    ).join(packs, "doc_id")

    def score(a: Column) -> Column:
        denominator = F.col("__norm") * a["norm"]
        usable = (F.size(a["embedding"]) == F.size("embedding")) & (denominator != 0)
        sim = F.when(usable, F.round(V.dot(F.col("embedding"), a["embedding"]) / denominator, 4))
        return F.struct(
            F.coalesce(sim, F.lit(0.0)).alias("sim"), (-a["ord"]).alias("neg"), a["char_id"].alias("who")
        )

    others = F.filter("pack", lambda a: a["char_id"] != F.col("char_id"))
    top = F.array_max(F.transform(others, score))
    return (
        rows.select("doc_id", "take_id", top.alias("c"))
        .groupBy("doc_id", "take_id")
        .agg(F.max("c").alias("c"))
        .select(
            "doc_id",
            "take_id",
            F.col("c.sim").alias("highest_competing_similarity"),
            F.col("c.who").alias("closest_competitor"),
        )
    )


def identity_margin(takes: DataFrame, anchors: DataFrame, margin: float = 0.05) -> DataFrame:
    """Whether a take is closer to its own character than to any other."""
    own = timbre_drift(takes, anchors).select(
        "doc_id", "take_id", "char_id", F.col("similarity_score").alias("intended_similarity")
    )
    voiced = anchors.select("doc_id", "char_id", F.lit(True).alias("__has"))
    rows = own.join(best_competitor(takes, anchors), ["doc_id", "take_id"], "left").join(
        voiced, ["doc_id", "char_id"], "left"
    )
    has, rival = F.col("__has").isNotNull(), F.col("highest_competing_similarity")
    alone = rival.isNull() | (rival < -0.99)
    delta = F.when(alone, F.col("intended_similarity")).otherwise(
        F.round(F.col("intended_similarity") - rival, 4)
    )
    delta = F.when(has, delta).otherwise(F.lit(1.0))
    rows = rows.withColumn("margin_delta", delta)
    met = has & ~alone
    return rows.select(
        "doc_id",
        "take_id",
        "char_id",
        "intended_similarity",
        F.when(met, rival).otherwise(0.0).alias("highest_competing_similarity"),
        F.when(met, F.col("closest_competitor")).alias("closest_competitor"),
        "margin_delta",
        (~met | (F.col("margin_delta") >= margin)).alias("passed"),
    )


def _unit(value: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(default))))


def acoustic_health(signals: DataFrame) -> DataFrame:
    """Composite of transcript match, pace and timbre with a risk level."""
    match = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("stt_match_pct", F.lit(100.0)) / 100.0))
    pace, drift = _unit(F.col("anomaly_score"), 0.0), _unit(F.col("drift_distance"), 0.0)
    score = F.round(match * 0.50 + (1.0 - pace) * 0.30 + (1.0 - drift) * 0.20, 3)
    return signals.withColumn("acoustic_score", score).withColumn(
        "risk_level",
        F.when(F.col("acoustic_score") < 0.60, "critical")
        .when(F.col("acoustic_score") < 0.78, "high")
        .when(F.col("acoustic_score") < 0.88, "medium")
        .otherwise("low"),
    )


# ---------------------------------------------------------------- triage

TIERS = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def segment_risk(segments: DataFrame) -> DataFrame:
    """Weighted risk of each line, its tier and the reasons.

    Reads confidence, speaker, match_pct, anomaly_score, pacing_status,
    chars_per_second, drift_distance and similarity_score.
    """
    confidence = F.coalesce("confidence", F.lit(1.0))
    match = F.coalesce("match_pct", F.lit(100.0))
    pace, drift = F.coalesce("anomaly_score", F.lit(0.0)), F.coalesce("drift_distance", F.lit(0.0))
    # fixed values: weights of the four signals
    raw = (
        _unit(1.0 - confidence, 0.0) * 0.35
        + _unit(1.0 - match / 100.0, 0.0) * 0.30
        + pace * 0.20
        + drift * 0.15
    )
    unknown = F.lower(F.coalesce("speaker", F.lit(""))) == "unknown"

    def pct(value: Column) -> Column:
        return F.format_string("%.0f", F.round(value, 0))

    reasons = F.array_compact(
        F.array(
            F.when(confidence < 0.60, F.concat(F.lit("Low attribution confidence ("), pct(confidence * 100), F.lit("%)"))),
            F.when(unknown, F.lit("Unresolved speaker identity (marked unknown)")),
            F.when(match < 90.0, F.concat(F.lit("STT mismatch ("), pct(match), F.lit("% match against expected text)"))),
            F.when(
                pace > 0.40,
                F.concat(
                    F.lit("Pacing anomaly: "), F.coalesce(T.blank_to_null(F.col("pacing_status")), F.lit("irregular")),
                    F.coalesce(F.concat(F.lit(" ("), F.nullif("chars_per_second", F.lit(0.0)).cast("string"), F.lit(" chars/sec)")), F.lit("")),
                ),
            ),
            F.when(
                drift > 0.25,
                F.concat(F.lit("Voice timbre drift ("), pct(F.col("similarity_score") * 100), F.lit("% match to character anchor)")),
            ),
        )
    )
    scored = segments.withColumn("risk_score", F.round(_unit(raw, 0.0), 3))
    tier = (
        F.when((F.col("risk_score") >= 0.50) | unknown, "critical")
        .when(F.col("risk_score") >= 0.32, "high")
        .when(F.col("risk_score") >= 0.15, "medium")
        .otherwise("low")
    )
    return scored.withColumn("risk_tier", tier).withColumn("triage_reasons", reasons)


def risk_queue(scored: DataFrame, top_pct: float | None = None, min_tier: str | None = None) -> DataFrame:
    """Riskiest lines of each book first; the share is of all lines, before the tier.

    Risk has at most 1001 values. Lines are counted per value, so a book is never
    sorted as a whole: only lines of equal risk are numbered, in blocks.
    """
    kept = scored
    if min_tier:
        low = [t for t, rank in TIERS.items() if rank >= TIERS.get(min_tier, 1)]
        kept = kept.where(F.col("risk_tier").isin(low))
    levels = kept.groupBy("doc_id", "risk_score").agg(F.count(F.lit(1)).alias("__n"))
    higher = W.partitionBy("doc_id").orderBy(F.desc("risk_score")).rowsBetween(W.unboundedPreceding, -1)
    levels = levels.withColumn("__above", F.coalesce(F.sum("__n").over(higher), F.lit(0)))
    limited = top_pct is not None and 0 < top_pct < 100
    if limited:
        totals = scored.groupBy("doc_id").agg(
            F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * top_pct / 100)).alias("__top")
        )
        levels = levels.join(totals, "doc_id").where("__above < __top")
    rows = kept.join(levels.drop("__n"), ["doc_id", "risk_score"])
    rows = ordered.renumber(
        rows,
        ["doc_id", "risk_score"],
        "seg_idx",
        "__tie",
    )
    rows = rows.withColumn("queue_pos", F.col("__above") + F.col("__tie") + 1)
    if limited:
        rows = rows.where("queue_pos <= __top").drop("__top")
    return rows.drop("__above", "__tie")


def doubtful_lines(segments: DataFrame) -> DataFrame:
    """Doubt flag, colour bucket and next doubtful line (wrapping) of each line."""
    name = F.lower(F.coalesce("speaker", F.lit("")))
    doubt = (
        F.coalesce("is_flagged", F.lit(False))
        | F.coalesce(F.col("confidence") < 0.70, F.lit(False))
        | name.isin("", "unknown", "character")
    )
    rows = segments.withColumn("is_doubtful", doubt)
    mark = F.when(F.col("is_doubtful"), F.col("seg_idx"))
    rows = ordered.running(
        rows, ["doc_id"], "seg_idx", {"__here": ("last", mark)}, reverse=True
    )
    rows = ordered.neighbours(
        rows, ["doc_id"], "seg_idx", next={"__later": F.col("__here")}, cut=True
    )
    book = rows.groupBy("doc_id").agg(
        F.min(mark).alias("__first"), F.count_if("is_doubtful").alias("doubt_count")
    )
    return rows.join(book, "doc_id").select(
        *segments.columns,
        "is_doubtful",
        F.when(F.col("is_doubtful"), "red")
        .when(F.coalesce(F.col("confidence") < 0.85, F.lit(False)), "yellow")
        .otherwise("green")
        .alias("bucket"),
        F.coalesce("__later", "__first").alias("next_doubtful"),
        "doubt_count",
    )


# ---------------------------------------------------------------- decision log


def temperature_gate(df: DataFrame, params: DataFrame, p: str = "raw_probability") -> DataFrame:
    """Calibrated probability and gate of each decision under its task's fit."""
    fit = params.select(
        "question_type",
        F.col("fitted_temperature").alias("__t"),
        F.coalesce("is_provisional", F.lit(False)).alias("__prov"),
        F.coalesce("boundary_pegged", F.lit(False)).alias("__peg"),
        F.coalesce(F.nullif("auto_approve_threshold", F.lit(0.0)), F.lit(0.90)).alias("__approve"),
        F.coalesce(F.nullif("review_threshold", F.lit(0.0)), F.lit(0.50)).alias("__review"),
    )
    rows = df.join(fit, "question_type", "left")
    fitted = F.coalesce(F.col("__t") != 0, F.lit(False))
    damped = F.when(
        F.col("__peg") & F.col("__prov"), F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("__t")))
    ).otherwise(F.col("__t"))
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    rows = rows.withColumn("__q", 1 / (1 + F.exp(-F.ln(bounded / (1 - bounded)) / damped)))
    gate = (
        F.when(~fitted, "needs_review")
        .when(F.col("__q") >= F.col("__approve"), "auto_approved")
        .when(F.col("__q") < F.col("__review"), "flagged_disagreement")
        .otherwise("needs_review")
    )
    out = {
        "calibrated_probability": F.when(fitted, F.round("__q", 4)).otherwise(F.col(p)),
        "is_calibrated": fitted,
        "is_provisional": F.when(fitted, F.col("__prov")).otherwise(True),
        "boundary_pegged": F.when(fitted, F.col("__peg")).otherwise(False),
        "calibrated_gate": gate,
    }
    return rows.select(*df.columns, *[v.alias(n) for n, v in out.items()])


def qc_gate_decisions(decisions: DataFrame, params: DataFrame, mode: str = "log_only") -> DataFrame:
    """Decision, agreement and gate of each logged model answer.

    Reads question_type, claim, answer (the chosen name for speaker questions)
    and raw_probability. In ``log_only`` mode everything still needs review.
    """
    p = F.coalesce("raw_probability", F.lit(0.5))
    rows = decisions.withColumn("raw_probability", p)
    rows = temperature_gate(rows, params)
    kind, yes = F.col("question_type"), F.col("raw_probability") >= 0.5
    claim = F.lower(T.strip(F.coalesce(T.blank_to_null(F.col("claim")), F.lit("calm"))))
    decision = (
        F.when(kind == "relationship_evidence", F.when(yes, "citation_supported").otherwise("citation_unsupported"))
        .when(kind.isin("character_existence", "emotion"), F.when(yes, "verified").otherwise("unverified"))
    )
    choice = (
        F.when(kind == "character_existence", F.when(yes, "present").otherwise("absent"))
        .when(kind == "relationship_evidence", F.when(yes, "supported").otherwise("unsupported"))
        .when(kind == "emotion", F.when(yes, claim).otherwise("other_tone"))
        .otherwise(F.col("answer"))
    )
    same = F.lower(T.strip(F.col("claim"))) == F.lower(T.strip(F.col("answer")))
    agrees = F.when(kind == "speaker_attribution", F.coalesce(same, F.lit(False)))
    gate = F.lit("needs_review") if mode == "log_only" else F.col("calibrated_gate")
    return (
        rows.withColumn("decision", decision)
        .withColumn("choice", choice)
        .withColumn("alert_status", F.when(kind == "relationship_evidence", F.when(yes, "ok").otherwise("unsupported_citation")))
        .withColumn("is_agreement", agrees)
        .withColumn("gate_status", gate)
    )


def relation_questions(citations: DataFrame) -> DataFrame:
    """Question text of a relationship citation after the vocabulary check."""
    rows = R.taxonomy_validate(citations)
    tone = F.coalesce(F.concat(F.lit(" with a "), F.col("relation_tone"), F.lit(" tone")), F.lit(""))
    return rows.withColumn(
        "question",
        F.concat(
            F.lit("Does this cited passage provide direct evidence of a "), F.col("relation_type"),
            F.lit(" relationship"), tone, F.lit(" between "), F.col("a"), F.lit(" and "), F.col("b"), F.lit("?"),
        ),
    )


def record_verdicts(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Attach the latest human verdict by id; notes stay unless new ones come."""
    latest = verdicts.groupBy("id").agg(
        F.max_by(F.struct("verdict", F.col("notes").alias("n")), "ts").alias("v"),
        F.max_by("notes", F.when(F.col("notes") != "", F.col("ts"))).alias("__notes"),
    )
    found = F.col("v").isNotNull()
    return decisions.join(latest, "id", "left").select(
        *[c for c in decisions.columns if c not in ("human_verdict", "notes")],
        F.when(found, F.col("v.verdict")).otherwise(F.col("human_verdict")).alias("human_verdict"),
        F.coalesce("__notes", "notes").alias("notes"),
        found.alias("was_updated"),
    )


def qc_stats(decisions: DataFrame) -> DataFrame:
    """Totals, verdicts and agreements per task, with one row over all tasks."""
    task = F.coalesce(T.blank_to_null(F.col("question_type")), F.lit("unknown"))
    return (
        decisions.withColumn("task", task)
        .rollup("task")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count("human_verdict").alias("with_verdict"),
            F.count_if(F.coalesce("is_agreement", F.lit(False))).alias("agreements"),
        )
        .withColumn("task", F.coalesce("task", F.lit("(all)")))
    )
