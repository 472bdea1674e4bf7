"""Probability calibration, span evaluation and voice audition checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import emotion as E
from ..functions import text as T
from ..functions import vectors as V
from . import qc as Q
from . import ordered, ranges
from .ordered import cut_lineage


# fixed values: search range, tolerance margin and sample size of the fit
T_MIN, T_MAX, PEG_MARGIN, MIN_SAMPLES = 0.05, 10.0, 0.015, 30


# Probabilities are kept this far from 0 and 1.
CLIP = 1e-6


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    return F.ln(q / (1 - q))


def _nll(z: Column, y: Column, temperature: Column) -> Column:
    q = 1 / (1 + F.exp(-z / temperature))
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), q))
    return F.when(y == 1, -F.ln(q)).otherwise(-F.ln(1 - q))


def labelled(decisions: DataFrame) -> DataFrame:
    """Rows with a verdict: question_type, idx, p, y (and agreement)."""
    return decisions.where("human_verdict IS NOT NULL AND raw_probability IS NOT NULL").select(
        F.coalesce(T.blank_to_null(F.col("question_type")), F.lit("unknown")).alias("question_type"),
        "idx",
        F.col("raw_probability").alias("p"),
        F.col("human_verdict").cast("int").alias("y"),
        F.coalesce("is_agreement", F.lit(False)).alias("is_agreement"),
    )


def calibration_ece_brier(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error, Brier score and log loss per task."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    slot = F.least(F.lit(bins - 1), F.floor(p * bins))
    per_bin = rows.groupBy("question_type", slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(p).alias("sp"),
        F.sum("y").alias("sy"),
        F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"),
        F.sum(_nll(logit(F.col("p")), F.col("y"), F.lit(1.0))).alias("loss"),
    )
    gap = F.abs(F.col("sy") / F.col("n") - F.col("sp") / F.col("n"))
    n = F.sum("n")
    return per_bin.groupBy("question_type").agg(
        n.alias("sample_count"),
        F.round(F.sum(F.col("n") * gap) / n, 4).alias("ece"),
        F.round(F.sum("sq") / n, 4).alias("brier"),
        F.round(F.sum("loss") / n, 4).alias("nll"),
    )


# Rounds are far more than the search needs; each one at least halves a bracket.
FIT_ROUNDS = 100


def fit_temperature(rows: DataFrame) -> DataFrame:
    """Temperature with the lowest log loss per task.

    The loss is convex in the inverse temperature, so its minimum is the root of its
    slope. A round takes two sums per task, slope and curvature, over the counts of each
    distinct probability and verdict; a Newton step follows, kept between the bounds known
    so far. Where no logit differs from zero, the highest temperature counts.
    """
    counts = rows.groupBy("question_type", "p", "y").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts.withColumn("z", logit(F.col("p"))))
    least, most = 1 / T_MAX, 1 / T_MIN
    state = counts.groupBy("question_type").agg(F.sum("n").alias("sample_count")).select(
        "*", F.lit(1.0).alias("s"), F.lit(least).alias("lo"), F.lit(most).alias("hi"), F.lit(False).alias("done")
    )
    state = cut_lineage(state)
    for _ in range(FIT_ROUNDS):
        if not state.where("NOT done").take(1):
            break
        q = 1 / (1 + F.exp(-F.col("z") * F.col("s")))
        sums = counts.join(state.where("NOT done").select("question_type", "s"), "question_type").groupBy("question_type").agg(
            F.sum(F.col("n") * F.col("z") * (q - F.col("y"))).alias("slope"),
            F.sum(F.col("n") * F.col("z") * F.col("z") * q * (1 - q)).alias("bend"),
        )
        s, slope = F.col("s"), F.col("slope")
        flat = (F.col("bend") == 0) & (slope == 0)
        # At an end of the range the slope may still lead outwards: the end it is.
        pegged = ((s >= most) & (slope <= 0)) | ((s <= least) & (slope >= 0))
        lo, hi = F.when(slope < 0, s).otherwise(F.col("lo")), F.when(slope >= 0, s).otherwise(F.col("hi"))
        step = F.when(F.col("bend") > 0, s - slope / F.col("bend")).otherwise(F.when(slope < 0, F.lit(most)).otherwise(F.lit(least)))
        # Ends of the range that were not looked at yet are tried themselves.
        inner = (F.col("low") + F.col("high")) / 2
        bounded = (
            F.when((F.col("step") >= F.col("high")) & (F.col("high") < most) | (F.col("step") <= F.col("low")) & (F.col("low") > least), inner)
            .otherwise(F.least(F.greatest(F.col("step"), F.col("low")), F.col("high")))
        )
        now = state.join(sums, "question_type", "left").withColumns({"low": lo, "high": hi, "step": step, "flat": flat, "pegged": pegged})
        now = now.withColumn("next", F.when(F.col("flat"), F.lit(least)).when(F.col("pegged"), s).otherwise(bounded))
        settled = F.col("flat") | F.col("pegged") | (F.abs(F.col("next") - s) <= 1e-9 * s)
        state = cut_lineage(now.select(
            "question_type",
            "sample_count",
            *[F.when(F.col("done"), F.col(old)).otherwise(F.col(new)).alias(old) for old, new in (("s", "next"), ("lo", "low"), ("hi", "high"))],
            (F.col("done") | settled).alias("done"),
        ))
    fitted = F.round(F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), 1 / F.col("s"))), 4)
    out = state.withColumn("fitted_temperature", fitted)
    low = F.abs(F.col("fitted_temperature") - T_MIN) <= PEG_MARGIN
    high = F.abs(F.col("fitted_temperature") - T_MAX) <= PEG_MARGIN
    return out.select(
        "question_type",
        "sample_count",
        "fitted_temperature",
        (low | high).alias("boundary_pegged"),
        F.when(low, "lower").when(high, "upper").alias("pegged_boundary"),
        (low | high | (F.col("sample_count") < MIN_SAMPLES)).alias("is_provisional"),
    )


def calibrated(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Replace ``p`` by the probability at the fitted temperature."""
    fit = fits.select("question_type", "fitted_temperature")
    z = logit(F.col("p")) / F.col("fitted_temperature")
    return rows.join(fit, "question_type").withColumn("p", 1 / (1 + F.exp(-z))).drop("fitted_temperature")


def derive_thresholds(
    rows: DataFrame, target: float = 0.95, patience: int = 5, piece_rows: int = 100_000
) -> DataFrame:
    """Lowest probability down to which running accuracy stays at ``target``.

    Rows are taken by falling probability, equal ones by ``idx``; the scan stops
    at the first row below target from the fifth on. It runs in blocks: slices of
    the probability axis, the probabilities of a slice, and pieces of ``piece_rows``
    index values of a probability. Sums of the blocks before are taken level by level.
    """
    task, block = ["question_type"], ["question_type", "__slice", "p", "__piece"]
    rows = rows.withColumn("__slice", F.floor(F.col("p") * 65536)).withColumn("__piece", F.floor(F.col("idx") / piece_rows))

    def earlier(window) -> list[Column]:
        before = window.rowsBetween(W.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "k")]

    cells = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    slices = cells.groupBy(*task, "__slice").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    slices = slices.select(*task, "__slice", *earlier(W.partitionBy(*task).orderBy(F.desc("__slice"))))
    slices = slices.withColumnsRenamed({"n0": "n1", "k0": "k1"})
    cells = cells.select(*block, *earlier(W.partitionBy(*task, "__slice").orderBy(F.desc("p"), "__piece")))
    sums = cells.join(slices, [*task, "__slice"]).select(*block, (F.col("n0") + F.col("n1")).alias("n0"), (F.col("k0") + F.col("k1")).alias("k0"))
    inside = W.partitionBy(*block).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    run = rows.withColumn("n", F.count(F.lit(1)).over(inside)).withColumn("k", F.sum("y").over(inside))
    run = run.join(sums, block).select(
        *task,
        "p",
        (F.col("n") + F.col("n0")).alias("n"),
        ((F.col("k") + F.col("k0")) / (F.col("n") + F.col("n0"))).alias("acc"),
    )
    failed = (F.col("acc") < target) & (F.col("n") >= patience)
    stop = run.groupBy(*task).agg(F.min(F.when(failed, F.col("n"))).alias("stop"))
    good = (F.col("acc") >= target) & (F.col("n") < F.coalesce("stop", F.lit(1 << 62)))
    best = F.coalesce(F.min(F.when(good, F.col("p"))), F.lit(0.90))
    # fixed values: bounds of the two thresholds
    return (
        run.join(stop, task)
        .groupBy(*task)
        .agg(best.alias("best"))
        .select(
            *task,
            F.round(F.greatest(F.lit(0.70), F.least(F.lit(0.98), F.col("best"))), 2).alias("auto_approve_threshold"),
            F.round(F.greatest(F.lit(0.40), F.least(F.lit(0.60), F.col("best") - 0.35)), 2).alias("review_threshold"),
        )
    )


def attribution_agreement(rows: DataFrame) -> DataFrame:
    """Share of agreements and of human approvals per task."""
    n = F.count(F.lit(1))
    return rows.groupBy("question_type").agg(
        n.alias("sample_count"),
        F.round(F.avg(F.col("is_agreement").cast("int")), 3).alias("agreement_rate"),
        F.round(F.avg("y"), 3).alias("human_approval_rate"),
        (n < MIN_SAMPLES).alias("is_provisional"),
    )


def calibration_report(decisions: DataFrame) -> DataFrame:
    """Parameters per task, ready for the gate: fit, errors and thresholds.

    Speaker questions are judged by agreement and keep their fixed thresholds.
    """
    rows = labelled(decisions)
    speakers = F.col("question_type") == "speaker_attribution"
    scored = rows.where(~speakers)
    fits = fit_temperature(scored)
    after = calibrated(scored, fits)
    key = "question_type"
    first = calibration_ece_brier(scored).select(key, F.col("ece").alias("uncalibrated_ece"), F.col("brier").alias("uncalibrated_brier"))
    second = calibration_ece_brier(after).select(key, F.col("ece").alias("calibrated_ece"), F.col("brier").alias("calibrated_brier"))
    fitted = fits.join(first, key).join(second, key).join(derive_thresholds(after), key)
    agreed = attribution_agreement(rows.where(speakers)).select(
        key,
        "sample_count",
        F.lit(1.0).alias("fitted_temperature"),
        F.lit(False).alias("boundary_pegged"),
        "is_provisional",
        F.lit(0.85).alias("auto_approve_threshold"),
        F.lit(0.50).alias("review_threshold"),
        "agreement_rate",
        "human_approval_rate",
    )
    return fitted.unionByName(agreed, allowMissingColumns=True)


# ---------------------------------------------------------------- span evaluation

# fixed value: a speech tag that slipped into a dialogue span
TAG_BLEED = rf"(?i)(?<!{T.W})(?:he|she|they|the boy|the man){T.WS}+(?:said|asked|replied|whispered|muttered)(?!{T.W})"


def span_eval(truth: DataFrame, predicted: DataFrame, passages: DataFrame, **blocking) -> DataFrame:
    """Character-level overlap of predicted and true dialogue per method.

    ``truth``: passage_id, ord, type, speaker, text; ``predicted`` also has
    method. The spans of a passage are looked up in it list by list, the truth and every
    method. Overlap lengths come from an interval join, not from single characters.
    """
    both = ["passage_id", "method"]
    lists = [*both, "is_true"]
    spans = predicted.withColumn("is_true", F.lit(False)).unionByName(
        truth.withColumns({"method": F.lit(""), "is_true": F.lit(True)}), allowMissingColumns=True
    )
    spans = spans.select(*lists, F.col("ord").cast("int").alias("seg_idx"), "text", "type", "speaker")
    placed = ranges.locate_in_passages(spans, passages, tuple(lists), ("passage_id",), **blocking)
    found = placed.where("type = 'dialogue' AND start >= 0")
    found = ordered.cut_lineage(found.select(*lists, "speaker", "start", "end"))
    methods = predicted.select(*both).distinct()
    true = found.where("is_true").drop("method", "is_true")
    guess = found.where("NOT is_true").drop("is_true")
    pairs = ranges.overlap_pairs(
        true.join(methods, "passage_id").select(*both, "speaker", "start", "end"), guess, both
    )
    same = F.lower("a_speaker") == F.lower("b_speaker")
    hits = pairs.groupBy(*both).agg(
        F.sum("overlap").alias("tp"), F.sum(F.when(same, F.col("overlap")).otherwise(0)).alias("right")
    )
    length = F.sum(F.col("end") - F.col("start"))
    sizes = guess.groupBy(*both).agg(length.alias("p_len"))
    true_sizes = true.groupBy("passage_id").agg(length.alias("t_len"))
    counts = predicted.groupBy(*both).agg(
        F.count(F.lit(1)).alias("predicted_spans"),
        F.count_if(F.col("type") == "dialogue").alias("dialogue_spans"),
        F.count_if((F.col("type") == "dialogue") & F.col("text").rlike(TAG_BLEED)).alias("tag_bleeds"),
    )
    rows = (
        counts.join(hits, both, "left").join(sizes, both, "left").join(true_sizes, "passage_id", "left").na.fill(0)
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    tp = F.col("tp")
    precision, recall = ratio(tp, F.col("p_len")), ratio(tp, F.col("t_len"))

    def pct(value: Column) -> Column:
        return F.round(value * 100, 1)

    return rows.select(
        *both,
        pct(precision).alias("precision"),
        pct(recall).alias("recall"),
        pct(ratio(2 * precision * recall, precision + recall)).alias("f1"),
        pct(ratio(tp, F.col("p_len") + F.col("t_len") - tp)).alias("iou"),
        pct(ratio(F.col("right"), tp)).alias("speaker_accuracy"),
        "tag_bleeds",
        "predicted_spans",
        "dialogue_spans",
    )


def method_leaderboard(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("method").agg(
        *[F.round(F.avg(c), 1).alias(f"mean_{c}") for c in ("f1", "iou", "speaker_accuracy")],
        F.sum("tag_bleeds").alias("tag_bleeds"),
        F.count(F.lit(1)).alias("passages"),
    )


# ---------------------------------------------------------------- auditions


def calibration_cell(takes: DataFrame, anchors: DataFrame, margin: float = 0.05) -> DataFrame:
    """Pass or fail of audition takes, with reasons.

    Reads take_id, char_id, emotion, band, embedding, stt_accuracy_pct and
    chars_per_second.
    """
    key = ["doc_id", "take_id"]
    rival = Q.identity_margin(takes, anchors, margin).select(
        *key, "margin_delta", "closest_competitor", F.col("passed").alias("__margin")
    )
    voice = anchors.select("doc_id", "char_id", F.col("embedding").alias("__a"))
    rows = takes.join(voice, ["doc_id", "char_id"], "left").join(rival, key, "left")
    none = F.array().cast("array<float>")
    similarity = V.cosine(F.coalesce("embedding", none), F.coalesce("__a", none))
    rows = rows.withColumn("identity_similarity", similarity).withColumn(
        "band_threshold", E.drift_threshold(F.col("band"))
    )
    stt, cps = F.coalesce("stt_accuracy_pct", F.lit(95.0)), F.coalesce("chars_per_second", F.lit(14.5))
    identity = F.col("identity_similarity") >= F.col("band_threshold")
    clear, paced = stt >= 85.0, (cps >= 7.5) & (cps <= 26.0)
    apart = F.coalesce("__margin", F.lit(True))

    def said(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    reasons = F.array_compact(
        F.array(
            F.when(~identity, said("Timbre similarity ", F.col("identity_similarity"), " fell below band threshold ", F.col("band_threshold"))),
            F.when(~clear, said("STT accuracy ", stt, "% fell below 85% requirement")),
            F.when(~paced, said("Pacing anomaly (", cps, " chars/sec)")),
            F.when(~apart, said("Closest competitor ", F.col("closest_competitor"), " within margin ", F.col("margin_delta"))),
        )
    )
    return rows.select(
        *key,
        "char_id",
        "emotion",
        "band",
        E.band_text(F.col("emotion"), E.band(E.band_middle(F.col("band"))), 0).alias("band_label"),
        "identity_similarity",
        "band_threshold",
        (identity & clear & paced & apart).alias("passed"),
        reasons.alias("failure_reasons"),
    )


def capability_caps(cells: DataFrame) -> DataFrame:
    """Highest passing band of each character and emotion."""
    return cells.groupBy("doc_id", "char_id", "emotion").agg(
        F.coalesce(F.max(F.when(F.col("passed"), F.col("band"))), F.lit(1)).alias("max_band")
    )


def learned_thresholds(cells: DataFrame) -> DataFrame:
    """Similarity threshold per character and band: 0.9 of the mean, or the default."""
    means = cells.groupBy("doc_id", "char_id", "band").agg(
        F.round(F.avg("identity_similarity") * 0.90, 2).alias("learned")
    )
    bands = F.array(*[F.lit(b) for b in E.DRIFT_THRESHOLDS])
    grid = cells.select("doc_id", "char_id").distinct().select("doc_id", "char_id", F.explode(bands).alias("band"))
    return grid.join(means, ["doc_id", "char_id", "band"], "left").select(
        "doc_id",
        "char_id",
        "band",
        F.coalesce("learned", E.drift_threshold(F.col("band"))).alias("threshold"),
        F.col("learned").isNotNull().alias("is_learned"),
    )


# Characters of the pieces by which names are looked up.
PIECE = 3


def _contained(inner: DataFrame, short: str, outer: DataFrame, long: str) -> DataFrame:
    """``doc_id`` and both names, where the ``short`` one (not blank) is a part of the ``long`` one.

    The first piece of the short name is looked up among all pieces of the long names of
    its book; only names that share it are compared.
    """

    def pieces(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(long) - size + 1)
        cut = F.transform(starts, lambda i: F.substr(F.col(long), i, F.lit(size)))
        return F.when(F.length(long) >= size, cut).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(*[pieces(size) for size in range(1, PIECE + 1)]))
    listed = outer.select("doc_id", long, F.explode(every).alias("piece"))
    sought = inner.where(F.col(short) != "").select("doc_id", short, F.substring(short, 1, PIECE).alias("piece"))
    return sought.join(listed, ["doc_id", "piece"]).where(F.contains(long, F.col(short))).select("doc_id", short, long)


def calibration_candidates(
    segments: DataFrame,
    targets: DataFrame,
    k: int = 5,
    min_chars: int = 15,
    max_chars: int = 350,
    dialogue_only: bool = True,
) -> DataFrame:
    """First ``k`` lines of the script that suit each audition target.

    ``targets``: doc_id, target_id, character, emotion, band. Names are matched
    among the distinct speakers of a book, not line by line.
    """

    def low(name: str) -> Column:
        return F.lower(T.strip(F.coalesce(F.col(name), F.lit(""))))

    have = set(segments.columns)
    text = T.strip(F.coalesce("text", F.lit("")))
    # fixed values: emotion words looked for in a direction
    word = F.regexp_extract(
        F.coalesce("direction", F.lit("")),
        r"(?i)\b(angry|anger|fear|fearful|sad|sadness|happy|joy|whisper|excited|calm)\b",
        1,
    )
    emotion = F.lower(F.coalesce(T.blank_to_null(F.col("emotion")), word))
    band = F.col("intensity_band") if "intensity_band" in have else F.lit(None).cast("int")
    if "intensity" in have:
        band = F.coalesce(band, F.when(F.col("intensity").isNotNull(), E.band(F.col("intensity"))))
    lines = segments.where(F.length(text).between(min_chars, max_chars))
    if dialogue_only:
        lines = lines.where("type IS NULL OR type = '' OR type = 'dialogue'")
    lines = lines.select(
        "doc_id", "seg_idx", "seg_id", low("speaker").alias("who"), "speaker", text.alias("text"),
        emotion.alias("line_emotion"), band.alias("line_band"),
    )
    wanted = targets.select(
        "doc_id", "target_id", low("character").alias("c"),
        T.blank_to_null(low("emotion")).alias("e"), F.col("band").alias("b"),
    )
    names, asked = lines.select("doc_id", "who").distinct(), wanted.select("doc_id", "c").distinct()
    # A blank name suits every other one of its book, so it needs no search.
    blank = asked.where("c = ''").join(names, "doc_id").unionByName(asked.where("c <> ''").join(names.where("who = ''"), "doc_id"))
    pairs = _contained(asked, "c", names, "who").unionByName(_contained(names, "who", asked, "c")).unionByName(blank).distinct()
    rows = lines.join(wanted.join(pairs, ["doc_id", "c"]), ["doc_id", "who"])
    heard = F.col("line_emotion")
    rows = rows.where(
        F.col("e").isNull() | (heard == "") | F.contains(heard, F.col("e")) | F.contains("e", heard)
    ).where(F.col("b").isNull() | F.col("line_band").isNull() | (F.col("b") == F.col("line_band")))
    first = W.partitionBy("doc_id", "target_id").orderBy("seg_idx")
    return (
        rows.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= k)
        .select(
            "doc_id", "target_id", "rank", "seg_idx", "seg_id", "speaker", "text",
            F.coalesce(T.blank_to_null(heard), "e", F.lit("neutral")).alias("emotion"),
            F.coalesce(F.nullif("line_band", F.lit(0)), "b", F.lit(1)).alias("band"),
            F.length("text").alias("character_length"),
        )
    )


def phonetic_tuning_eval(takes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Whether an imported voice is both itself and clearly spoken."""
    voice = anchors.select("doc_id", "char_id", F.col("embedding").alias("__a"))
    none = F.array().cast("array<float>")
    rows = takes.join(voice, ["doc_id", "char_id"], "left").withColumn(
        "similarity_score", V.cosine(F.coalesce("embedding", none), F.coalesce("__a", none))
    )
    itself = F.col("similarity_score") >= 0.75
    clear = F.coalesce("stt_accuracy_pct", F.lit(98.0)) >= 90.0
    return rows.select(
        "doc_id",
        "take_id",
        "char_id",
        "similarity_score",
        itself.alias("is_identity_verified"),
        clear.alias("is_articulation_clean"),
        (itself & clear).alias("passed"),
        F.when(itself & clear, "tuned_and_verified").otherwise("tuning_needs_review").alias("status"),
    )
