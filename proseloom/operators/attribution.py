"""Who speaks each line: rules, candidate scores and the pass that joins them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from . import cast as C
from . import ordered
from . import text as text_ops

UNKNOWN = "unknown"
# fixed values: thresholds of the decision
ACCEPT_SCORE, ACCEPT_GAP, FLOOR_SCORE = 0.60, 0.25, 0.35
VOCATIVE_PENALTY, ALTERNATION_BONUS = 0.15, 0.10
TAG_WINDOW, HISTORY = 80, 6
# fixed values: speech verbs of a dialogue tag
SPEECH_VERBS = [
    "said", "says", "asked", "asks", "replied", "replies", "whispered", "shouted", "muttered",
    "snapped", "answered", "called", "cried", "murmured", "growled", "sighed", "laughed", "added",
    "demanded", "yelled", "told", "continued", "insisted", "stammered", "hissed", "breathed",
    "snarled",
]
VERBS = "|".join(SPEECH_VERBS)

# ---------------------------------------------------------------- rules


def span_start(span: str = "text", para: str = "para_text", start: str = "start") -> Column:
    """0-based offset of a span in its paragraph, or null when it is not there."""
    found = F.expr(f"locate({span}, {para})")
    given = F.col(start)
    return F.when(given.isNotNull(), given).when(found > 0, found - 1)


def with_paragraph(spans: DataFrame, paragraphs: DataFrame) -> DataFrame:
    lines = paragraphs.select("doc_id", "para_idx", F.col("text").alias("para_text"), "scene_id")
    return spans.join(lines, ["doc_id", "para_idx"])


def tag_prose(spans: DataFrame, window: int = TAG_WINDOW) -> DataFrame:
    """Unquoted prose beside each span, up to the nearest sentence end."""
    # Quotes become blanks of the same length, so offsets stay valid.
    parts = F.split("para_text", '["“][^"“”]*["”]', -1)
    quotes = F.regexp_extract_all("para_text", F.lit('["“][^"“”]*["”]'), F.lit(0))
    masked = F.array_join(
        F.transform(
            parts,
            lambda p, i: F.concat(
                p, F.regexp_replace(F.coalesce(F.get(quotes, i), F.lit("")), r"[^\n]", " ")
            ),
        ),
        "",
    )
    at = span_start()
    stop = at + F.length("text")
    after = F.regexp_extract(T.from_offset(masked, stop, F.lit(window)), r"^[^.!?]*", 0)
    before = F.regexp_extract(
        T.from_offset(masked, at - window, F.least(at, F.lit(window))), r"[^.!?]*\z", 0
    )
    return spans.withColumn("prose_after", after).withColumn("prose_before", before)


def rule_tag(spans: DataFrame, paragraphs: DataFrame, scene_cast: DataFrame, cast: DataFrame) -> DataFrame:
    """Speaker of a line tagged by exactly one character of the scene."""
    sides = tag_prose(with_paragraph(spans, paragraphs)).select(
        "doc_id",
        "scene_id",
        "span_id",
        F.explode(F.array("prose_after", "prose_before")).alias("text"),
    )
    verbal = sides.where(F.col("text").rlike(rf"(?i)(?:{VERBS})"))
    named = verbal.withColumn("head", F.explode(C.word_bag(F.col("text")))).join(
        C.cast_variants(cast), ["doc_id", "head"]
    )
    name = T.quote_pattern(F.col("variant"))
    tag = F.concat(
        F.lit(f"(?i)(?<!{T.W})"), name, F.lit(rf"[^A-Za-z0-9_]+(?:{T.W}+ly{T.WS}+)?(?:{VERBS})(?!{T.W})"),
        F.lit(rf"|(?<!{T.W})(?:{VERBS})[^A-Za-z0-9_]+"), name, F.lit(f"(?!{T.W})"),
    )
    hits = (
        named.where(F.rlike("text", tag))
        .join(scene_cast.select("doc_id", "scene_id", "char_id"), ["doc_id", "scene_id", "char_id"])
        .groupBy("doc_id", "span_id")
        .agg(F.count_distinct("char_id").alias("n"), F.min("char_id").alias("speaker"))
    )
    return hits.where("n = 1").select(
        "doc_id", "span_id", "speaker", F.lit("tag").alias("evidence"), F.lit(0.95).alias("confidence")
    )


def rule_monologue(paragraphs: DataFrame) -> DataFrame:
    """Flag paragraphs that go on with a quote the paragraph before left open."""
    near = ordered.neighbours(
        paragraphs, ["doc_id"], "para_idx", prev={"__before": F.col("text")}
    )

    def count(mark: str) -> Column:
        return F.regexp_count("__before", F.lit(mark))

    left_open = (count("“") > count("”")) | (count('"') % 2 == 1)
    goes_on = F.col("text").rlike(rf'^{T.WS}*["“]')
    return near.withColumn("continues", F.coalesce(left_open & goes_on, F.lit(False))).drop("__before")


def rule_vocative(spans: DataFrame, scene_cast: DataFrame, cast: DataFrame) -> DataFrame:
    """Characters addressed at the start or the end of a line: its listeners."""
    line = F.lower(F.col("text"))
    opening = F.regexp_extract(line, rf"^{T.WS}*([^,!:]+?){T.WS}*[,!:]", 1)
    closing = F.regexp_extract(line, rf",{T.WS}*([^,]+?){T.WS}*[.!?]*{T.WS}*\z", 1)
    asked = spans.select(
        "doc_id", "scene_id", "span_id", F.explode(F.array_distinct(F.array(opening, closing))).alias("variant")
    ).where("variant <> ''")
    known = C.cast_variants(cast).select("doc_id", "char_id", "variant")
    bare = known.withColumn("variant", F.regexp_replace("variant", r"[.!?]+\z", ""))
    return (
        asked.join(known.unionByName(bare).distinct(), ["doc_id", "variant"])
        .join(scene_cast.select("doc_id", "scene_id", "char_id"), ["doc_id", "scene_id", "char_id"])
        .select("doc_id", "span_id", F.col("char_id").alias("listener"))
        .distinct()
    )


def context_window(
    spans: DataFrame, paragraphs: DataFrame, before: int = 3, after: int = 1, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Paragraphs around each line inside its scene, with the line marked.

    A scene is cut into blocks of ``block_rows`` paragraph numbers; the paragraphs next to a
    border stand in both blocks, so each text is sent once and no task gets a whole scene.
    """
    size, at = F.lit(block_rows), F.col("para_idx")
    own = F.floor(at / size)
    blocks = F.array_distinct(F.array(F.floor((at - after) / size), own, F.floor((at + before) / size)))
    placed = paragraphs.select("doc_id", "scene_id", "para_idx", "text", own.alias("__own"), F.explode(blocks).alias("__blk"))
    near = W.partitionBy("doc_id", "scene_id", "__blk").orderBy("para_idx").rangeBetween(-before, after)
    around = F.array_sort(F.collect_list(F.struct("para_idx", "text")).over(near))
    shown = placed.withColumn("around", around).where("__own = __blk").select("doc_id", "scene_id", "para_idx", "around")
    rows = with_paragraph(spans, paragraphs).join(
        shown, ["doc_id", "scene_id", "para_idx"]
    )
    at = span_start()
    mark = F.concat(
        F.substr("para_text", F.lit(1), at), F.lit("[[LINE "), F.col("span_id"), F.lit("]]"), F.col("text"),
        F.lit("[[/LINE]]"), T.from_offset(F.col("para_text"), at + F.length("text"), F.length("para_text")),
    )
    marked = F.when(at.isNull(), F.col("para_text")).otherwise(mark)
    rows = rows.withColumn("__marked", marked)
    lines = F.transform(
        "around",
        lambda p: F.when(p["para_idx"] == F.col("para_idx"), F.col("__marked")).otherwise(p["text"]),
    )
    return rows.select(
        "doc_id",
        "scene_id",
        "span_id",
        F.array_join(lines, "\n\n").alias("context"),
        F.concat(
            F.lit("Which character speaks the line marked [[LINE "), F.col("span_id"), F.lit("]]?")
        ).alias("question"),
    )


# ---------------------------------------------------------------- candidate scores

SPAN = ["doc_id", "span_id"]
ADAPTER = [*SPAN, "adapter"]
RUN = [*ADAPTER, "ordering"]


def _share(score: Column, group: list[str]) -> Column:
    """Score as a share of its group; an all-zero group is uniform."""
    over = W.partitionBy(*group)
    total = F.sum(score).over(over)
    return F.when(total == 0, 1 / F.count(F.lit(1)).over(over)).otherwise(score / total)


def _top(group: list[str]) -> Column:
    rank = F.struct(F.col("score"), -F.col("option_ord"))
    return F.max_by("option_id", rank).over(W.partitionBy(*group))


def normalize_scores(scores: DataFrame) -> DataFrame:
    """Scores of one run as a distribution: negatives clipped, all-zero is uniform.

    Scores are shuffled once, by line. Everything up to the decision groups by the
    line and more, so it stays where it is. A group is the options of one line.
    """
    spread = scores.repartition(*SPAN)
    clipped = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))
    return spread.withColumn("score", clipped).withColumn("score", _share(F.col("score"), RUN))


def debias_orderings(normalized: DataFrame) -> DataFrame:
    """Mean of the runs with forward and reversed options, per adapter."""
    adapter = W.partitionBy(*ADAPTER)
    mean = (
        normalized.withColumn("__t", _top(RUN))
        .groupBy(*ADAPTER, "option_id", "option_ord")
        .agg(F.avg("score").alias("score"), F.min("__t").alias("lo"), F.max("__t").alias("hi"))
    )
    stable = F.min("lo").over(adapter) == F.max("hi").over(adapter)
    return mean.withColumn("top", _top(ADAPTER)).withColumn("stable", stable).drop("lo", "hi")


def _merged(debiased: DataFrame, vocative: DataFrame | None) -> DataFrame:
    """Mean over adapters per option with agreement flags; the addressed lose score."""
    line = W.partitionBy(*SPAN)
    flagged = (
        debiased.withColumn("agree", F.min("top").over(line) == F.max("top").over(line))
        .withColumn("__s", F.min(F.col("stable").cast("int")).over(line) == 1)
        .withColumn("adapters", F.size(F.collect_set("adapter").over(line)).cast("bigint"))
    )
    merged = flagged.groupBy(*SPAN, "option_id", "option_ord").agg(
        F.avg("score").alias("score"),
        F.first("agree").alias("agree"),
        F.first("__s").alias("stable"),
        F.first("adapters").alias("adapters"),
    )
    if vocative is None:
        return merged
    addressed = vocative.groupBy(*SPAN).agg(F.collect_set("listener").alias("__v"))
    lowered = F.greatest(F.col("score") - VOCATIVE_PENALTY, F.lit(0.0))
    hit = F.coalesce(F.array_contains("__v", F.col("option_id")), F.lit(False))
    return (
        merged.join(addressed, SPAN, "left")
        .withColumn("score", F.when(hit, lowered).otherwise(F.col("score")))
        .drop("__v")
    )


def ensemble_scores(
    debiased: DataFrame, vocative: DataFrame | None = None, hint: DataFrame | None = None
) -> DataFrame:
    """Mean over adapters, nudged by who is addressed and whose turn it is."""
    merged = _merged(debiased, vocative)
    if hint is not None:
        turn = hint.groupBy(*SPAN).agg(F.min("hint").alias("__h"))
        raised = F.col("score") + ALTERNATION_BONUS
        merged = (
            merged.join(turn, SPAN, "left")
            .withColumn("score", F.when(F.col("__h") == F.col("option_id"), raised).otherwise(F.col("score")))
            .drop("__h")
        )
    return merged.withColumn("score", _share(F.col("score"), SPAN))


def decide_speaker(ensemble: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Accept the top candidate, ask the fallback choice, or send to review."""
    span = ["doc_id", "span_id"]
    ranked = ensemble.groupBy(*span).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("score")).alias("s"), "option_ord", "option_id"))
        ).alias("r"),
        F.first("agree").alias("agree"),
        F.first("stable").alias("stable"),
        F.first("adapters").alias("adapters"),
    )
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    score = -first["s"]
    gap = score + F.coalesce(second["s"], F.lit(0.0))
    top3 = F.slice("r", 1, 3)
    rows = ranked.select(
        *span,
        "agree",
        "stable",
        "adapters",
        first["option_id"].alias("top"),
        score.alias("top_score"),
        gap.alias("gap"),
        F.transform(top3, lambda x: x["option_id"]).alias("candidates"),
        F.transform(top3, lambda x: F.round(-x["s"], 3)).alias("candidate_scores"),
    )
    choice = F.lit(None).cast("string")
    if fallback is not None:
        rows = rows.join(fallback.select(*span, "choice"), span, "left")
        allowed = F.array_contains(F.array_append("candidates", F.lit(UNKNOWN)), F.col("choice"))
        choice = F.when(allowed, F.col("choice"))
    clean = (
        F.col("agree")
        & F.col("stable")
        & (F.col("top") != UNKNOWN)
        & (F.col("top_score") >= ACCEPT_SCORE)
        & (F.col("gap") >= ACCEPT_GAP)
    )
    guess = F.when(
        (F.col("top") != UNKNOWN) & (F.col("top_score") >= FLOOR_SCORE), F.col("top")
    ).otherwise(F.lit(UNKNOWN))
    return rows.select(
        *span,
        F.when(clean, F.col("top")).otherwise(F.coalesce(choice, guess)).alias("speaker"),
        F.when(clean & (F.col("adapters") > 1), "classifier_agree")
        .when(clean, "classifier")
        .when(choice.isNotNull(), "llm")
        .otherwise("classifier_uncertain")
        .alias("evidence"),
        F.round("top_score", 3).alias("confidence"),
        F.round("gap", 6).alias("gap"),
        (~clean).alias("needs_review"),
        "candidates",
        "candidate_scores",
    )


# ---------------------------------------------------------------- the full pass

_PASS_SCHEMA = (
    "doc_id bigint, scene_id int, chunk bigint, span_id string, seq bigint, speaker string, "
    "evidence string, confidence double, needs_review boolean, s1 string, s2 string, "
    "previous_speaker string, previous_locked boolean"
)


def _choose(row, hint: str | None) -> tuple[str, str, float, bool]:
    """Decision for one line from its scores, given whose turn it may be."""
    if row.option_ids is None or len(row.option_ids) == 0:
        return UNKNOWN, "error", 0.0, True
    names = list(row.option_ids)
    scores = [
        s + (ALTERNATION_BONUS if o == hint else 0.0)
        for o, s in zip(names, row.option_scores, strict=True)
    ]
    total = sum(scores)
    share = [s / total if total else 1 / len(scores) for s in scores]
    order = sorted(range(len(share)), key=lambda i: -share[i])
    best = order[0]
    top, score = names[best], share[best]
    gap = score - (share[order[1]] if len(order) > 1 else 0.0)
    sure = row.agree and row.stable and top != UNKNOWN
    if sure and score >= ACCEPT_SCORE and gap >= ACCEPT_GAP:
        return top, "classifier_agree" if row.adapters > 1 else "classifier", round(score, 3), False
    shortlist = [names[i] for i in order[:3]] + [UNKNOWN]
    if row.choice in shortlist:
        return row.choice, "llm", round(score, 3), True
    keep = top != UNKNOWN and score >= FLOOR_SCORE
    return top if keep else UNKNOWN, "classifier_uncertain", round(score, 3), True


def _speaker_pass(pdf: pd.DataFrame, carried: dict) -> pd.DataFrame:
    head = pdf.iloc[0]
    older, newer = carried.get("s2", head.seed2), carried.get("s1", head.seed1)
    out = []
    for row in pdf.itertuples(index=False):
        known = isinstance(newer, str)
        if isinstance(row.locked, str):
            made = (row.locked, "user_locked", 1.0, False)
        elif row.continues and known and newer != UNKNOWN:
            made = (newer, "continuation", 0.95, False)
        elif isinstance(row.tag, str):
            made = (row.tag, "tag", 0.95, False)
        else:
            turn = (
                row.new_paragraph
                and known
                and isinstance(older, str)
                and older != newer
                and UNKNOWN not in (older, newer)
            )
            made = _choose(row, older if turn else None)
        older, newer = newer, made[0]
        past = (row.previous_speaker, bool(row.previous_locked))
        out.append((row.doc_id, row.scene_id, row.chunk, row.span_id, row.seq, *made, newer, older, *past))
    names = [f.split()[0] for f in _PASS_SCHEMA.split(", ")]
    return pd.DataFrame(out, columns=names)


def attribute_dialogue(
    spans: DataFrame,
    paragraphs: DataFrame,
    cast: DataFrame,
    candidate_scores: DataFrame,
    reference: DataFrame | None = None,
    fallback: DataFrame | None = None,
    **blocking,
) -> DataFrame:
    """Attribute every line in reading order, scene by scene.

    Rules, scores and locks are joined first, for all lines at once. Only the
    turn-taking feedback is sequential, and it depends on the two speakers
    before. Two lines in a row whose speaker no feedback can change (locked, or
    tagged and not a continuation) fix that state, so a scene is cut there and
    its pieces run in parallel.
    """
    # Scenes and their cast are read by several rules: written out once each.
    scenes = ordered.cut_lineage(text_ops.assign_scenes(paragraphs))
    present = ordered.cut_lineage(C.scene_cast(scenes, cast))
    placed = spans.join(
        scenes.select("doc_id", "para_idx", "scene_id"), ["doc_id", "para_idx"]
    )
    tags = rule_tag(spans, scenes, present, cast).select("doc_id", "span_id", F.col("speaker").alias("tag"))
    open_quote = rule_monologue(paragraphs).select("doc_id", "para_idx", "continues")
    vocative = rule_vocative(placed, present, cast)
    debiased = debias_orderings(normalize_scores(candidate_scores))
    # The bonus of the turn comes in the pass, so the shares are taken there.
    options = (
        _merged(debiased, vocative)
        .groupBy(*SPAN)
        .agg(
            F.array_sort(F.collect_list(F.struct("option_ord", "option_id", "score"))).alias("o"),
            *[F.first(c).alias(c) for c in ("agree", "stable", "adapters")],
        )
        .select(
            *SPAN,
            F.transform("o", lambda x: x["option_id"]).alias("option_ids"),
            F.transform("o", lambda x: x["score"]).alias("option_scores"),
            "agree",
            "stable",
            "adapters",
        )
    )

    keys = ["doc_id", "span_id"]
    rows = (
        placed.join(tags, keys, "left")
        .join(open_quote, ["doc_id", "para_idx"], "left")
        .join(options, keys, "left")
    )
    if reference is not None:
        matched = match_previous(spans, reference)
        rows = rows.join(matched, keys, "left")
    else:
        rows = rows.withColumn("previous_speaker", F.lit(None).cast("string")).withColumn(
            "previous_locked", F.lit(False)
        )
    if fallback is not None:
        rows = rows.join(fallback.select(*keys, "choice"), keys, "left")
    else:
        rows = rows.withColumn("choice", F.lit(None).cast("string"))
    rows = rows.withColumn("locked", F.when(F.col("previous_locked"), F.col("previous_speaker")))

    scene = ["doc_id", "scene_id"]
    # What the two lines before bring along, and the paragraph of the one before each.
    back = {f"__para{n}": (F.col("para_idx"), n) for n in (1, 2, 3)}
    for n in (1, 2):
        back |= {f"__locked{n}": (F.col("locked"), n), f"__tag{n}": (F.col("tag"), n), f"__open{n}": (F.col("continues"), n)}
    rows = ordered.lags(rows, scene, "span_ord", back, cut=True)

    def continued(opened: str, before: str, here: str) -> Column:
        return F.coalesce(F.col(opened) & (F.col(before) == F.col(here) - 1), F.lit(False))

    def fixed(n: int) -> Column:
        goes_on = continued(f"__open{n}", f"__para{n + 1}", f"__para{n}")
        return F.coalesce(f"__locked{n}", F.when(~goes_on, F.col(f"__tag{n}")))

    cut = fixed(1).isNotNull() & fixed(2).isNotNull()
    rows = (
        rows.withColumn("new_paragraph", F.coalesce(F.col("__para1") != F.col("para_idx"), F.lit(True)))
        .withColumn("continues", continued("continues", "__para1", "para_idx"))
        .withColumn("seed1", F.when(cut, fixed(1)))
        .withColumn("seed2", F.when(cut, fixed(2)))
        .withColumn("__cut", cut)
    )
    turns = {"seq": ("count", F.lit(1)), "chunk": ("sum", F.col("__cut").cast("int"))}
    rows = ordered.running(rows, scene, "span_ord", turns, cut=True).withColumn("seq", F.col("seq") - 1)
    needed = rows.select(
        "doc_id", "scene_id", "chunk", "span_id", "seq", "locked", "tag", "continues", "new_paragraph",
        "option_ids", "option_scores", "agree", "stable", "adapters", "choice", "seed1", "seed2",
        "previous_speaker", "previous_locked",
    )
    decided = ordered.fold_blocks(
        needed, [*scene, "chunk"], "seq", _speaker_pass, _PASS_SCHEMA, ["s1", "s2"], dense=True, **blocking
    ).drop("chunk", "s1", "s2")
    decided = ordered.cut_lineage(decided)
    out = decided.join(_listeners(decided), keys, "left")
    differs = (
        ~F.coalesce("previous_locked", F.lit(False))
        & F.col("previous_speaker").isNotNull()
        & (F.col("previous_speaker") != UNKNOWN)
        & (F.col("previous_speaker") != F.col("speaker"))
    )
    diff = F.struct(
        "previous_speaker",
        F.col("speaker").alias("proposed_speaker"),
        "confidence",
        F.col("evidence").alias("engine"),
    )
    return out.select(
        "doc_id",
        "scene_id",
        "span_id",
        F.col("seq").cast("int").alias("seq"),
        "speaker",
        "listener",
        "evidence",
        "confidence",
        (F.col("needs_review") | F.coalesce(differs, F.lit(False))).alias("needs_review"),
        F.when(differs, diff).alias("proposed_diff"),
    )


def _listeners(decided: DataFrame, depth: int = HISTORY) -> DataFrame:
    """Latest other known speaker among the ``depth`` lines before each line."""
    scene = ["doc_id", "scene_id"]
    heard = decided.where(F.col("speaker") != UNKNOWN).select(
        *scene,
        F.explode(F.sequence(F.col("seq") + 1, F.col("seq") + depth)).alias("at"),
        F.struct("seq", F.col("speaker").alias("name")).alias("h"),
    )
    asked = decided.select(*scene, F.col("seq").alias("at"), "span_id", "speaker")
    return (
        asked.join(heard, [*scene, "at"])
        .where("h.name <> speaker")
        .groupBy("doc_id", "span_id")
        .agg(F.max("h")["name"].alias("listener"))
    )


# ---------------------------------------------------------------- the light ladder


def rule_attribution_lite(quotes: DataFrame, cast: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Fixed ladder of rules with contexts of each quote.

    ``quotes``: doc_id, seg_idx, text, preceding_context, following_context. The
    last rung depends on the speaker before, but only through who spoke last at a
    line with a speaker of its own and how many lines ago, so it is a running
    value and not a loop.
    """
    key = ["doc_id", "seg_idx"]
    roles = ["text", "preceding_context", "following_context"]
    parts = quotes.select(
        *key,
        F.explode(
            F.array(
                *[F.struct(F.lit(i).alias("role"), F.coalesce(c, F.lit("")).alias("text")) for i, c in enumerate(roles)]
            )
        ).alias("x"),
    ).select(*key, "x.*")
    named = C.mentions(parts, cast, ["seg_idx", "role"])
    verb = F.col("text").rlike(rf"(?i)(?<!{T.W})(?:{VERBS})(?!{T.W})")
    place = F.struct("ord", "variant_ord")
    vocative = (
        named.where("role = 0").groupBy(*key).agg(F.min_by("char_id", place).alias("vocative"))
    )
    tagged = (
        named.join(parts.where(verb & (F.col("role") > 0)).select(*key, "role"), [*key, "role"], "left_semi")
        .join(vocative, key, "left")
        .where("vocative IS NULL OR char_id <> vocative")
        .groupBy(*key)
        .agg(F.min(F.struct("ord", "variant_ord", -F.col("role"), "char_id", "role")).alias("t"))
        .select(
            *key,
            F.col("t.char_id").alias("tagged"),
            F.when(F.col("t.role") == 2, 0.95).otherwise(0.90).alias("tag_conf"),
        )
    )
    # fixed values: pronoun tags after a quote
    she = (
        r"(?i)\b(?:she|her)\s+(?:said|asked|laughed|replied|whispered|murmured|muttered|cried)\b"
        r"|\b(?:said|asked|laughed|replied|whispered)\s+she\b"
    )
    he = (
        r"(?i)\b(?:he|him)\s+(?:said|asked|replied|whispered|murmured|muttered|told)\b"
        r"|\b(?:said|asked|replied|whispered)\s+he\b"
    )
    it = (
        r"(?i)\b(?:it|the machine|the drone)\s+(?:said|asked|replied|whispered|hissed|hummed)\b"
        r"|\b(?:said|asked|replied|hissed)\s+the (?:machine|drone)\b"
    )
    people = cast.groupBy("doc_id").agg(
        F.min(F.struct("ord", "char_id"))["char_id"].alias("lead"),
        F.count(F.lit(1)).alias("n_cast"),
        *[
            F.min(F.when(F.col("gender") == g, F.struct("ord", "char_id"))).alias(g.lower())
            for g in ("Female", "Male", "Machine")
        ],
        *[
            # The two first members tell who "the other one" is.
            F.array_sort(F.slice(F.array_sort(F.collect_set(F.struct("ord", "char_id"))), 1, 2)).alias("pair")
        ],
    )
    males = cast.where("gender = 'Male'").select("doc_id", "ord", F.col("char_id").alias("m"))
    rows = (
        quotes.select(*key, "following_context")
        .join(vocative, key, "left")
        .join(tagged, key, "left")
        .join(people, "doc_id")
    )
    other_male = (
        rows.where("vocative = male.char_id")
        .select(*key, "vocative")
        .join(males, "doc_id")
        .where("m <> vocative")
        .groupBy(*key)
        .agg(F.min(F.struct("ord", "m"))["m"].alias("other_male"))
    )
    rows = rows.join(other_male, key, "left")
    if scores is not None:
        rows = rows.join(scores.select(*key, "choice", "choice_conf"), key, "left")
    else:
        rows = rows.withColumn("choice", F.lit(None).cast("string")).withColumn(
            "choice_conf", F.lit(None).cast("double")
        )
    after = F.coalesce("following_context", F.lit(""))
    is_she, is_he, is_it = after.rlike(she), after.rlike(he), after.rlike(it)
    male = F.when(F.col("vocative") == F.col("male.char_id"), F.col("other_male")).otherwise(
        F.col("male.char_id")
    )
    pronoun = (
        F.when(is_she, F.col("female.char_id")).when(is_he, male).when(is_it, F.col("machine.char_id"))
    )
    scored = F.when(
        (F.col("n_cast") > 1) & (F.col("choice") != F.coalesce("vocative", F.lit(""))), F.col("choice")
    )
    answer = F.when(
        F.col("vocative").isNotNull() & (F.col("n_cast") >= 2),
        F.when(F.col("vocative") == F.col("lead"), F.get("pair", F.lit(1))["char_id"]).otherwise(F.col("lead")),
    )
    own = (
        F.when(F.col("tagged").isNotNull(), F.struct(F.col("tagged").alias("s"), F.col("tag_conf").alias("c"), F.lit("tag").alias("e")))
        .when(pronoun.isNotNull(), F.struct(pronoun.alias("s"), F.when(is_he & ~is_she, 0.80).otherwise(0.85).alias("c"), F.lit("pronoun").alias("e")))
        .when(scored.isNotNull(), F.struct(scored.alias("s"), F.coalesce("choice_conf", F.lit(0.75)).alias("c"), F.lit("scores").alias("e")))
        .when(answer.isNotNull(), F.struct(answer.alias("s"), F.lit(0.70).alias("c"), F.lit("vocative").alias("e")))
    )
    rows = rows.withColumn("own", own)
    rows = ordered.renumber(rows, ["doc_id"], "seg_idx", "pos", cut=True)
    rows = ordered.running(
        rows,
        ["doc_id"],
        "pos",
        cut=True,
        aggs={"pin": ("last", F.when(F.col("own").isNotNull(), F.struct("pos", F.col("own.s").alias("s"))))},
    )
    # Lines since the last own speaker. The very first line of a book without one
    # takes the lead and then counts as that speaker.
    pinned = F.col("pin").isNotNull()
    since = F.col("pos") - F.coalesce(F.col("pin.pos"), F.lit(0))
    base = F.coalesce(F.col("pin.s"), F.col("lead"))
    a, b = F.get("pair", F.lit(0))["char_id"], F.get("pair", F.lit(1))["char_id"]
    after_base = F.when(base == a, b).otherwise(a)
    turn = F.when(since == 0, base).when(since % 2 == 1, after_base).otherwise(
        F.when(after_base == a, b).otherwise(a)
    )
    opening = ~pinned & (since == 0)
    two = F.col("n_cast") == 2
    rung_speaker = F.when(two, turn).otherwise(F.col("lead"))
    rung_conf = (
        F.when(opening, 0.50)
        .when(two, 0.65)
        .when(pinned & (since == 1) & (base != F.col("lead")), 0.60)
        .otherwise(0.50)
    )
    return rows.select(
        *key,
        F.coalesce(F.col("own.s"), rung_speaker).alias("speaker"),
        F.coalesce(F.col("own.c"), rung_conf).alias("confidence"),
        F.coalesce(F.col("own.e"), F.lit("alternation")).alias("rule"),
        "vocative",
    )


def alternation_baseline(spans: DataFrame, cast: DataFrame) -> DataFrame:
    """Cast members in turn over the dialogue; a named tag restarts the turn.

    ``spans``: doc_id, ord, type, tag. The speaker follows from the last restart
    and the number of dialogue lines since, so no loop is needed.
    """
    dialogue = ordered.renumber(spans.where("type = 'dialogue'"), ["doc_id"], "ord", "n")
    names = cast.where("name <> 'Narrator'").select("doc_id", "ord", "name")
    seats = ordered.renumber(names, ["doc_id"], "ord", "seat").select("doc_id", "name", "seat")
    sizes = seats.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cast"))
    tags = dialogue.where("tag <> ''").select("doc_id", "ord", F.col("tag").alias("text"))
    seated = seats.select(
        "doc_id",
        "name",
        F.col("name").alias("char_id"),
        F.col("seat").alias("ord"),
        F.lit(None).cast("array<string>").alias("aliases"),
    )
    named = (
        C.mentions(tags.withColumnRenamed("ord", "line"), seated, ["line"])
        .groupBy("doc_id", F.col("line").alias("ord"))
        .agg(F.min("ord").alias("reset"))
    )
    rows = dialogue.join(named, ["doc_id", "ord"], "left").join(sizes, "doc_id", "left")
    rows = ordered.running(
        rows,
        ["doc_id"],
        "n",
        {"from": ("last", F.when(F.col("reset").isNotNull(), F.struct("n", "reset")))},
        cut=True,
    )
    seat = (
        F.coalesce(F.col("from.reset"), F.lit(0)) + F.col("n") - F.coalesce(F.col("from.n"), F.lit(0))
    ) % F.col("n_cast")
    rows = rows.withColumn("seat", seat)
    return rows.join(seats, ["doc_id", "seat"], "left").select(
        "doc_id", "ord", F.coalesce("name", F.lit("Narrator")).alias("speaker")
    )


def cascade_routing(
    first: DataFrame, second: DataFrame, threshold: float = 0.85, ambiguous: float = 0.55
) -> DataFrame:
    """Send low-confidence lines to the second scorer and keep the better answer."""
    key = ["doc_id", "span_id"]
    asked = first.where(F.col("confidence") < threshold).select(*key)
    answers = second.join(asked, key, "left_semi").select(
        *key, F.col("choice").alias("c2"), F.col("confidence").alias("p2")
    )
    rows = first.join(answers, key, "left")
    better = F.coalesce(F.col("p2") > F.col("confidence"), F.lit(False))
    confidence = F.when(better, F.col("p2")).otherwise(F.col("confidence"))
    return rows.select(
        *key,
        F.when(better, F.col("c2")).otherwise(F.col("choice")).alias("choice"),
        confidence.alias("confidence"),
        F.when(better, "second").otherwise("first").alias("source"),
        (F.col("confidence").isNull() | (rows["confidence"] < threshold)).alias("escalated"),
        (confidence < ambiguous).alias("is_ambiguous"),
    )


# ---------------------------------------------------------------- previous results


def match_previous(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Earlier row for each new line: the first with the same id or the same text."""
    key = ["doc_id", "span_id"]
    old = previous.select(
        "doc_id",
        F.struct(
            "seg_idx", "speaker", F.coalesce("is_user_locked", F.lit(False)).alias("locked")
        ).alias("p"),
        F.col("seg_id").alias("span_id"),
        T.strip(F.col("text")).alias("t"),
    )
    by_id = old.where("span_id IS NOT NULL").groupBy(*key).agg(F.min("p").alias("p1"))
    by_text = old.where("t IS NOT NULL").groupBy("doc_id", "t").agg(F.min("p").alias("p2"))
    rows = (
        new.select(*key, T.strip(F.col("text")).alias("t"))
        .join(by_id, key, "left")
        .join(by_text, ["doc_id", "t"], "left")
        .withColumn("p", F.least("p1", "p2"))
    )
    return rows.select(
        *key,
        F.col("p.speaker").alias("previous_speaker"),
        F.coalesce(F.col("p.locked"), F.lit(False)).alias("previous_locked"),
        F.col("p.seg_idx").alias("previous_idx"),
    )


def speaker_diff(new: DataFrame, previous: DataFrame, by_position: bool = False) -> DataFrame:
    """Keep the earlier speaker and propose the new one where they differ.

    ``new``: doc_id, span_id, seg_idx, text, speaker, confidence, engine.
    """
    key = ["doc_id", "span_id"]
    rows = new.join(match_previous(new, previous), key, "left")
    if by_position:
        spare = previous.select(
            "doc_id",
            "seg_idx",
            F.col("speaker").alias("__s"),
            F.coalesce("is_user_locked", F.lit(False)).alias("__l"),
        )
        missed = F.col("previous_idx").isNull()
        rows = (
            rows.join(spare, ["doc_id", "seg_idx"], "left")
            .withColumn("previous_speaker", F.when(missed, F.col("__s")).otherwise(F.col("previous_speaker")))
            .withColumn("previous_locked", F.when(missed, F.coalesce("__l", F.lit(False))).otherwise(F.col("previous_locked")))
        )
    old = F.col("previous_speaker")
    locked = F.coalesce(F.col("previous_locked"), F.lit(False)) & (F.coalesce(old, F.lit("")) != "")
    differs = F.coalesce(
        ~locked & (old != "") & ~old.isin("unknown", "Unknown", "Character") & (old != F.col("speaker")),
        F.lit(False),
    )
    diff = F.struct(
        "previous_speaker", F.col("speaker").alias("proposed_speaker"), "confidence", "engine"
    )
    return rows.select(
        *key,
        "seg_idx",
        F.when(locked | differs, old).otherwise(F.col("speaker")).alias("speaker"),
        F.when(locked, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        locked.alias("is_user_locked"),
        (~locked & (differs | F.coalesce(F.col("confidence") < 0.55, F.lit(False)))).alias("is_ambiguous"),
        F.when(differs, diff).alias("proposed_diff"),
    )


def apply_diffs(segments: DataFrame, decisions: DataFrame | None = None, bulk: str | None = None) -> DataFrame:
    """Accept or dismiss proposed speakers, listed one by one or all at once."""
    if decisions is not None:
        listed = decisions.groupBy("doc_id", "seg_idx").agg(F.max("action").alias("__a"))
        rows = segments.join(listed, ["doc_id", "seg_idx"], "left")
    else:
        rows = segments.withColumn("__a", F.lit(bulk))
    pending = F.col("proposed_diff").isNotNull()
    accept = F.coalesce(pending & (F.col("__a") == "accept"), F.lit(False))
    closed = accept | F.coalesce(F.col("__a") == "dismiss", F.lit(False))
    name = F.col("proposed_diff.proposed_speaker")
    changed = {
        "speaker": F.when(accept, name).otherwise(F.col("speaker")),
        "type": F.when(accept, F.when(name == "Narrator", "narrator").otherwise("dialogue")).otherwise(F.col("type")),
        "audio_path": F.when(~accept, F.col("audio_path")),
        "proposed_diff": F.when(~closed, F.col("proposed_diff")),
    }
    if "versions" in segments.columns:
        off = F.transform("versions", lambda v: v.withField("is_active", F.lit(False)))
        changed["versions"] = F.when(accept, off).otherwise(F.col("versions"))
    return rows.select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in segments.columns],
        accept.alias("needs_resync"),
    )


def batch_reassign(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Give every line of one speaker to another and lock it."""
    moves = mapping.where("from_speaker <> to_speaker").select(
        "doc_id", F.col("from_speaker").alias("speaker"), F.col("to_speaker").alias("__to")
    )
    moved = F.col("__to").isNotNull()
    rows = segments.join(moves, ["doc_id", "speaker"], "left")
    return rows.select(
        *[
            F.coalesce("__to", "speaker").alias("speaker")
            if c == "speaker"
            else (F.col(c) | moved).alias(c) if c == "is_user_locked" else F.col(c)
            for c in segments.columns
        ],
        moved.alias("was_reassigned"),
    )


def reassign_counts(reassigned: DataFrame) -> DataFrame:
    return (
        reassigned.where("was_reassigned")
        .groupBy("doc_id", "speaker")
        .agg(F.count(F.lit(1)).alias("reassigned_lines"))
    )


def attribution_review_queue(attributed: DataFrame) -> DataFrame:
    """Lines that need review, least certain first."""
    return attributed.where("needs_review").orderBy("confidence", "doc_id", "span_id")
