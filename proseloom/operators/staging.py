"""Acoustic cues, staging of dialogue, emotion state and performance text."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import emotion as E
from ..functions import hashing as H
from ..functions import text as T
from . import ordered

# ---------------------------------------------------------------- acoustic cues

# fixed values: patterns that read voice cues out of narration
VOICE_CLAUSE = r"(?i)(?:her|his|their|[a-zA-Z]+'s)\s+voice\s+(?:was|sounded|became|grew)\s+([^.]+)"
VOICE_PARTICIPLE = (
    r"(?i)(?:her|his|their|[a-zA-Z]+'s)?\s*voice\s+(softening|cracking|breaking|dropping|rising|"
    r"tightening|wavering|trembling|quivering|faltering|thickening)(?:[^,.]+)"
)
TONE_PHRASE = (
    r"(?i)(?:in|with)\s+an?\s+([^.]+?)\s+"
    r"(?:voice|tone|cadence|rasp|murmur|whisper|growl|inflection|diction)"
)
CUE_VERB = (
    r"(?i)(?:,\s*)?(?:(?:she|he|they|[A-Z][a-zA-Z]+)\s+)?(whispered|murmured|muttered|breathed|hissed|"
    r"shouted|yelled|bellowed|screamed|gasped|choked|sobbed|snapped|barked|growled|spat|stammered|"
    r"faltered|sighed|laughed|chuckled|replied|answered|said|asked|called|warned|commanded)"
    r"(?:\s+(softly|quietly|gently|faintly|flatly|coldly|monotonously|harshly|bitterly|sharply|wearily|"
    r"tiredly|heavily|urgently|desperately|breathlessly|huskily|dryly|slowly|firmly|smoothly))?"
)
# fixed values: flag -> (verbs, adverbs, stems) that raise it
FLAGS = {
    "is_whisper": (["whispered", "murmured", "breathed"], [], ["whisper", "murmur"]),
    "is_shout": (["shouted", "yelled", "bellowed", "screamed", "roared"], [], []),
    "is_flat": ([], ["flatly", "coldly"], ["flat", "clipped"]),
    "is_soft": ([], ["softly", "quietly", "gently"], ["softening", "quiet"]),
    "is_harsh": (["snapped", "barked", "growled"], ["harshly", "bitterly"], []),
    "is_hesitant": (["stammered", "faltered", "choked"], [], ["cracking", "trembling"]),
    "is_urgent": ([], ["urgently", "desperately", "breathlessly"], ["urgent"]),
    "is_weary": ([], ["wearily", "tiredly"], ["weary", "exhaustion"]),
    "is_amused": (["laughed", "chuckled"], [], ["amused"]),
}


def with_cues(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the voice cues of a piece of narration as a struct; null for no text.

    What several cues are made of is a column of its own first, so each pattern is searched once a row.
    """

    def part(pattern: str, group: int) -> Column:
        return T.blank_to_null(F.regexp_extract("__t", pattern, group))

    rows = df.withColumn("__text", text).withColumn("__t", T.strip(F.col("__text")))
    rows = rows.withColumns(
        {
            "__clause": T.strip(part(VOICE_CLAUSE, 1)),
            "__participle": T.strip(part(VOICE_PARTICIPLE, 0)),
            "__tone": F.concat(T.strip(part(TONE_PHRASE, 1)), F.lit(" tone")),
            "__verb": F.lower(part(CUE_VERB, 1)),
            "__adverb": F.lower(part(CUE_VERB, 2)),
        }
    )
    rows = rows.withColumn("__raw", F.coalesce("__clause", "__participle", "__tone"))
    rows = rows.withColumn("__search", F.lower(F.concat_ws(" ", "__t", "__raw")))

    def flag(verbs: list[str], adverbs: list[str], stems: list[str]) -> Column:
        hit = F.lit(False)
        if verbs:
            hit = hit | F.coalesce(F.col("__verb").isin(verbs), F.lit(False))
        if adverbs:
            hit = hit | F.coalesce(F.col("__adverb").isin(adverbs), F.lit(False))
        return hit | E.contains_any(F.col("__search"), stems) if stems else hit

    found = F.when(
        F.coalesce("__text", F.lit("")) != "",
        F.struct(
            F.coalesce("__participle", "__clause").alias("vocal_clause"),
            F.col("__verb").alias("speech_verb"),
            F.col("__adverb").alias("speech_adverb"),
            F.col("__tone").alias("in_tone_phrase"),
            F.col("__raw").alias("raw_acoustic_phrase"),
            *[flag(*rule).alias(flagged) for flagged, rule in FLAGS.items()],
        ),
    )
    return rows.select(*[c for c in df.columns if c != name], found.alias(name))


def acoustic_cues(df: DataFrame, col: str = "text") -> DataFrame:
    return with_cues(df, F.col(col), "cues")


# ---------------------------------------------------------------- staging

STYLE = [
    "age_range", "gender", "pitch", "vocal_texture", "pacing", "cadence", "acting_persona",
    "vocal_technique", "rich_emotion",
]
# fixed values: style of narration
NARRATION_STYLE = {
    "age_range": "Adult",
    "gender": "Unknown",
    "pitch": "medium",
    "vocal_texture": "clear, neutral studio presence",
    "pacing": "normal",
    "cadence": "steady cadence",
    "acting_persona": "omniscient storyteller",
    "vocal_technique": "steady rhythmic delivery",
    "rich_emotion": "neutral and observant",
}
# fixed values: what a cue flag (or a word of the voice profile, after "~") selects; first wins
LADDERS = {
    "pitch": (
        [("is_whisper", "low"), ("is_flat", "low"), ("is_shout", "high"), ("~low", "low"), ("~high", "high")],
        "medium",
    ),
    "vocal_texture": (
        [
            ("is_whisper", "soft, breathy whisper"),
            ("is_flat", "flat, clipped timbre with minimal inflection"),
            ("is_harsh", "sharp, hard-edged timbre"),
            ("is_hesitant", "breathless, cracked vocal texture"),
            ("is_soft", "gentle, subdued projection"),
        ],
        None,
    ),
    "pacing": (
        [
            ("is_flat", "measured"),
            ("is_weary", "measured"),
            ("is_urgent", "fast"),
            ("is_shout", "fast"),
            ("is_hesitant", "slow"),
            ("is_soft", "slow"),
            ("is_whisper", "slow"),
            ("~slow", "slow"),
        ],
        "normal",
    ),
    "cadence": (
        [
            ("is_flat", "clipped, precise speech"),
            ("~clipped", "clipped, precise speech"),
            ("is_whisper", "hushed, intimate cadence"),
            ("is_hesitant", "hesitant, unsteady rhythm"),
            ("is_urgent", "rapid, breathless cadence"),
            ("~ceremonial", "ceremonial, rhythmic cadence"),
        ],
        "steady cadence",
    ),
    "vocal_technique": (
        [
            ("is_flat", "compressed timbre, minimal pitch inflection"),
            ("is_whisper", "soft intimate attack, close mic proximity"),
            ("is_harsh", "sharp staccato emphasis and projected volume"),
            ("is_soft", "soft attack, resonant and subdued projection"),
            ("~compressed", "compressed timbre with procedural diction"),
        ],
        "steady rhythm and clear articulation",
    ),
    "rich_emotion": (
        [
            ("is_flat", "flat composure, procedural detachment"),
            ("is_whisper", "hushed secrecy, suppressed tension"),
            ("is_harsh", "contained irritation or sharp demand"),
            ("is_hesitant", "vulnerable hesitation or disbelief"),
            ("is_soft", "gentle reverent calm"),
            ("is_urgent", "pressing urgency"),
        ],
        None,
    ),
    "direction": (
        [
            ("is_whisper", "Soft, intimate whisper with hushed breathy delivery."),
            ("is_flat", "Flat, clipped delivery with procedural composure."),
            ("is_soft", "Soft, gentle delivery with quiet reverence."),
            ("is_harsh", "Sharp, commanding delivery with hardened edge."),
        ],
        None,
    ),
    "emotion": ([("is_whisper", "whisper"), ("is_flat", "calm"), ("is_harsh", "angry")], "calm"),
}


# What the rungs ask for: a bit for each cue flag and each word of the voice profile.
ASKED = [*FLAGS, *dict.fromkeys(key for rungs, _ in LADDERS.values() for key, _ in rungs if key[0] == "~")]


def _mask(cue: Column, profile: Column) -> Column:
    """The bits of what a line has, as a whole number."""
    found = F.lit(0)
    for k, key in enumerate(ASKED):
        hit = profile.contains(key[1:]) if key[0] == "~" else cue[key]
        found = found + F.when(F.coalesce(hit, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0))
    return found


def style_table(spark: SparkSession) -> DataFrame:
    """``mask`` and what each ladder selects for it: a row for each of the 2^15 masks."""

    def chosen(name: str) -> Column:
        rungs, default = LADDERS[name]
        out = F.lit(default).cast("string")
        for key, value in reversed(rungs):
            out = F.when(F.col("mask").bitwiseAND(1 << ASKED.index(key)) != 0, F.lit(value)).otherwise(out)
        return out.alias(f"__s_{name}")

    masks = spark.range(1 << len(ASKED)).select(F.col("id").cast("int").alias("mask"))
    return masks.select("mask", *map(chosen, LADDERS))


def _first_clause(text: Column, cut: str = "[;,.]") -> Column:
    return F.lower(T.strip(F.element_at(F.split(text, cut, 2), 1)))


def stage_segments(segments: DataFrame, cast: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    """Delivery style of each line from the narration beside it and the cast.

    Cues come from the next narrator row, or the one before when the next says
    nothing about the voice. ``relationships``: doc_id, ord, a, b, relation_type,
    relation_tone; the first record that holds the speaker gives the intent.
    """

    # Cues are found once, in the narrator's row, and handed to the rows beside it.
    told = F.when(F.col("type") == "narrator", F.col("text"))
    rows = ordered.neighbours(
        with_cues(segments, told, "__cue"), ["doc_id"], "seg_idx",
        prev={"__cb": F.col("__cue")}, next={"__ca": F.col("__cue")}, cut=True,
    ).drop("__cue")

    def speaks(c: str) -> Column:
        return F.col(f"{c}.raw_acoustic_phrase").isNotNull() | F.col(f"{c}.speech_verb").isNotNull()

    rows = rows.withColumn(
        "cue",
        F.when(F.coalesce(speaks("__ca"), F.lit(False)), F.col("__ca"))
        .when(F.coalesce(speaks("__cb"), F.lit(False)), F.col("__cb"))
        .otherwise(F.col("__ca")),
    )
    rows = rows.withColumn(
        "__name", F.coalesce(T.blank_to_null(F.col("speaker")), F.lit("Character"))
    )
    profile_cols = ["age", "gender", "voice_profile", "traits", "personality_traits",
                    "identity_background", "current_emotion"]
    people = cast.select(
        "doc_id",
        F.col("name").alias("__name"),
        F.struct(
            *[
                (F.col(c) if c in cast.columns else F.lit(None).cast("string")).alias(c)
                for c in profile_cols
            ]
        ).alias("who"),
    )
    rows = rows.join(people, ["doc_id", "__name"], "left")
    if relationships is None:
        rows = rows.withColumn("rel", F.lit(None).cast("struct<tone:string,type:string>"))
    else:
        first = (
            relationships.select(
                "doc_id",
                "ord",
                F.explode(F.array("a", "b")).alias("__name"),
                F.struct(F.col("relation_tone").alias("tone"), F.col("relation_type").alias("type")).alias("rel"),
            )
            .groupBy("doc_id", "__name")
            .agg(F.min_by("rel", "ord").alias("rel"))
        )
        rows = rows.join(first, ["doc_id", "__name"], "left")

    cue, who = F.col("cue"), F.col("who")
    voice = F.lower(F.coalesce(who["voice_profile"], F.lit("")))

    def has(field: str) -> Column:
        return T.blank_to_null(who[field])

    rows = rows.withColumn("mask", _mask(cue, voice)).join(F.broadcast(style_table(rows.sparkSession)), "mask", "left")
    style = {n: F.col(f"__s_{n}") for n in LADDERS}
    style["age_range"] = F.coalesce(has("age"), F.lit("Adult"))
    style["gender"] = F.coalesce(has("gender"), F.lit("Unknown"))
    style["vocal_texture"] = F.coalesce(
        T.strip(cue["raw_acoustic_phrase"]),
        style["vocal_texture"],
        F.concat(_first_clause(has("traits")), F.lit(" delivery")),
        F.lit("smooth and controlled"),
    )
    traits = F.coalesce(has("personality_traits"), has("traits"))
    # fixed value: phrases that end the role part of a background
    role_end = r"(?i)(?:tasked with|responsible for|who is|an adult|serving as|[;.,])"
    role = _first_clause(has("identity_background"), role_end)
    named = ~F.col("__name").isin("Character", "Unknown")
    style["acting_persona"] = (
        F.when((role != "") & (F.length(role) < 80), role)
        .when(role.isNotNull(), _first_clause(F.coalesce(traits, F.lit("focused character"))))
        .when(traits.isNotNull(), _first_clause(traits))
        .when(named, F.concat(F.lower("__name"), F.lit(" persona")))
        .otherwise(F.lit("natural speaker"))
    )
    style["rich_emotion"] = F.coalesce(
        style["rich_emotion"], has("current_emotion"), F.lit("calm delivery")
    )
    phrase = T.capitalise(
        F.regexp_replace(
            cue["raw_acoustic_phrase"],
            r"(?i)^(?:her|his|their)\s+voice\s+(?:was|sounded|became|grew)\s+",
            "",
        )
    )
    direction = F.coalesce(
        F.when(phrase.endswith("."), phrase).otherwise(F.concat(phrase, F.lit("."))),
        style["direction"],
        F.concat(
            T.capitalise(style["rich_emotion"]), F.lit(", "), style["pacing"],
            F.lit(" conversational delivery."),
        ),
    )
    spoken = F.col("type") == "dialogue"
    columns = set(segments.columns)

    def own(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in columns else F.lit(None).cast(kind)

    kept = (
        F.coalesce(own("is_user_locked", "boolean"), F.lit(False))
        & (F.coalesce(own("direction"), F.lit("")) != "")
        & (own("direction") != "expressive delivery")
        & F.coalesce(own("has_style", "boolean"), F.lit(False))
    )
    staged = spoken & ~kept
    intent = F.when(
        F.col("rel.tone").isNotNull(),
        F.concat(
            F.lit("Interpersonal tone: "), F.col("rel.tone"), F.lit(" ("),
            F.coalesce("rel.type", F.lit("interpersonal")), F.lit("). "), direction,
        ),
    ).otherwise(F.lit("Direct dialogue delivery."))
    made = {
        "direction": F.when(staged, direction).otherwise(own("direction")),
        "emotion": F.when(
            staged & F.coalesce(own("emotion"), F.lit("")).isin("", "calm"), style["emotion"]
        ).otherwise(own("emotion")),
        "intent": F.when(
            staged, F.coalesce(T.blank_to_null(own("intent")), intent)
        ).otherwise(own("intent")),
    }
    keep = [c for c in segments.columns if c not in made]
    full = F.struct(*[F.when(spoken, style[n]).otherwise(F.lit(NARRATION_STYLE[n])).alias(n) for n in STYLE])
    return rows.select(
        *keep, *[v.alias(n) for n, v in made.items()], F.when(~(spoken & kept), full).alias("style")
    )


# ---------------------------------------------------------------- emotion


def emotion_palette(df: DataFrame, emotion: str = "emotion", direction: str = "direction") -> DataFrame:
    """Palette label, base intensity and whisper route of a free description."""
    search = F.lower(
        F.concat(F.coalesce(emotion, F.lit("")), F.lit(" "), F.coalesce(direction, F.lit("")))
    )
    label, level = F.lit("calm"), F.lit(0.7)
    for name, base, stems in reversed(E.PALETTE):
        hit = E.contains_any(search, stems)
        label = F.when(hit, F.lit(name)).otherwise(label)
        level = F.when(hit, F.lit(base)).otherwise(level)
    whisper = E.contains_any(search, E.WHISPER_STEMS)
    return (
        df.withColumn("palette_emotion", label)
        .withColumn("palette_intensity", level)
        .withColumn("is_whisper", whisper)
        .withColumn("route", F.when(whisper, "whisper").otherwise("emotion"))
    )


def emotion_band(df: DataFrame, emotion: str = "emotion", intensity: str = "intensity") -> DataFrame:
    number = E.band(F.col(intensity))
    return (
        df.withColumn("band", number)
        .withColumn("band_label", E.band_text(F.col(emotion), number, 0))
        .withColumn("band_description", E.band_text(F.col(emotion), number, 1))
    )


DECAY, MAX_JUMP, STRONG_TRIGGER, START = 0.15, 0.30, 0.40, 0.2
_GRID = 1000


def next_intensity(previous, baseline, trigger, lines, decay=DECAY, max_jump=MAX_JUMP):
    """One step of the intensity recurrence, rounded to the 0.001 grid."""
    raw = baseline + (previous - baseline) * (1 - decay) ** lines + trigger
    limit = max_jump * lines
    if abs(trigger) < STRONG_TRIGGER:
        raw = np.clip(raw, previous - limit, previous + limit)
    return np.floor(np.clip(raw, 0.0, 1.0) * _GRID + 0.5) / _GRID


def step_intensity(previous: float, baseline: float, trigger: float, lines: int) -> float:
    """:func:`next_intensity` for one value."""
    raw = baseline + (previous - baseline) * (1 - DECAY) ** lines + trigger
    if abs(trigger) < STRONG_TRIGGER:
        limit = MAX_JUMP * lines
        raw = min(max(raw, previous - limit), previous + limit)
    return math.floor(min(max(raw, 0.0), 1.0) * _GRID + 0.5) / _GRID


def _arc_inputs(events: DataFrame) -> DataFrame:
    baseline = F.coalesce("baseline", F.lit(START)) if "baseline" in events.columns else F.lit(START)
    lines = F.col("lines_since") if "lines_since" in events.columns else F.lit(1)
    return events.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("char_id").cast("string").alias("char_id"),
        F.col("line_idx").cast("bigint").alias("line_idx"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), baseline)).cast("double").alias("baseline"),
        F.coalesce("trigger_strength", F.lit(0.0)).cast("double").alias("trigger"),
        F.greatest(F.lit(1), F.coalesce(lines, F.lit(1))).cast("int").alias("lines"),
    )


def emotion_arc(events: DataFrame, start: float = START, block_rows: int = 1 << 18) -> DataFrame:
    """Emotional intensity of each character after each event.

    The recurrence is not a window function, but its state is one of 1001 values.
    Blocks of a long timeline are therefore summed up as a table "state before ->
    state after", the tables are chained, and all blocks then run in parallel
    from their known start. Only timelines of more than ``block_rows`` rows are cut;
    all others are walked one after the other in sorted partitions.
    """
    key = ["doc_id", "char_id"]
    rows = _arc_inputs(events)
    first_state = int(round(start * _GRID))

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_idx")
        states = np.arange(_GRID + 1) / _GRID
        for row in pdf.itertuples(index=False):
            states = next_intensity(states, row.baseline, row.trigger, row.lines)
        head = pdf.iloc[0]
        after = np.rint(states * _GRID).astype("int32").tolist()
        return pd.DataFrame([(head.doc_id, head.char_id, head["__blk"], after)],
                            columns=[*key, "__blk", "after"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, starts = pdf.sort_values("__blk"), first_state, []
        for after in pdf["after"]:
            starts.append(state)
            state = int(after[state])
        return pdf[[*key, "__blk"]].assign(start=starts)

    walked = ["doc_id", "char_id", "__blk", "line_idx", "start", "baseline", "trigger", "lines"]

    def walk(batches):
        at, level = None, 0.0
        for batch in batches:
            levels = []
            for doc, who, blk, begin, base, trigger, lines in zip(*(batch[c].to_pylist() for c in walked if c != "line_idx")):
                if (doc, who, blk) != at:
                    at, level = (doc, who, blk), (first_state if begin is None else begin) / _GRID
                level = step_intensity(level, base, trigger, lines)
                levels.append(level)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in (*key, "line_idx")), pa.array(levels, pa.float64())], names=[*key, "line_idx", "intensity"]
            )

    long = ordered.cut_lineage(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block_rows).select(*key))
    none = {"__blk": F.lit(0).cast("bigint"), "start": F.lit(None).cast("int")}
    placed = rows.withColumns(none)
    if long.take(1):
        cut = ordered.renumber(rows.join(long, key, "left_semi"), key, "line_idx", "__pos")
        cut = cut.withColumn("__blk", F.floor(F.col("__pos") / block_rows)).drop("__pos")
        tables = cut.groupBy(*key, "__blk").applyInPandas(table, "doc_id bigint, char_id string, __blk bigint, after array<int>")
        starts = tables.groupBy(*key).applyInPandas(chain, "doc_id bigint, char_id string, __blk bigint, start int")
        placed = rows.join(long, key, "left_anti").withColumns(none).unionByName(cut.join(starts, [*key, "__blk"]))
    out = (
        placed.select(*walked)
        .repartition(*key, "__blk")
        .sortWithinPartitions(*key, "__blk", "line_idx")
        .mapInArrow(walk, "doc_id bigint, char_id string, line_idx bigint, intensity double")
    )
    return out.withColumn("band", E.band(F.col("intensity")))


def relationship_baseline(df: DataFrame, status: str = "status", tone: str = "relation_tone") -> DataFrame:
    s = F.lower(F.coalesce(T.blank_to_null(F.col(status)), F.lit("neutral")))
    t = F.lower(F.coalesce(T.blank_to_null(F.col(tone)), F.lit("neutral")))
    level = (
        F.when((s == "hostile") | (t == "hostile"), 0.55)
        .when((s == "tense") | t.isin("tense", "guarded"), 0.40)
        .when(s == "estranged", 0.35)
        .when(s.isin("warm", "allied") | (t == "warm"), 0.15)
        .otherwise(0.20)
    )
    return df.withColumn("baseline", level)


# fixed values: manner of an expression mode
MANNER = {
    "suppressed": "in a tight, suppressed, quiet, and controlled manner",
    "released": "in an open, dynamic, outward, and projecting manner",
}


def emotion_instruction(df: DataFrame) -> DataFrame:
    """Instruction text from ``emotion, intensity, expression, text``."""
    number = E.band(F.col("intensity"))
    return df.withColumn(
        "instruction",
        F.concat(
            F.lit("Say the following with the same voice, "),
            E.lookup(F.col("expression"), MANNER, F.lit("naturally")),
            F.lit(", with "), E.band_text(F.col("emotion"), number, 0),
            F.lit(" delivery (intensity "), number.cast("string"), F.lit("/5, "),
            E.band_text(F.col("emotion"), number, 1), F.lit("): '"), F.col("text"), F.lit("'"),
        ),
    )


def running_emotion_state(segments: DataFrame) -> DataFrame:
    """Emotion last set for each speaker by a ``state_update`` row before."""
    update = (F.col("type") == "state_update") & (F.col("new_emotion") != "")
    rows = ordered.running(
        segments,
        ["doc_id", "speaker"],
        "seg_idx",
        {"active_emotion_state": ("last", F.when(update, F.col("new_emotion")))},
    )
    return rows.where("type <> 'state_update'").withColumn(
        "active_emotion_state", F.coalesce("active_emotion_state", F.lit("neutral and observant."))
    )


def remap_intensity(requests: DataFrame, caps: DataFrame) -> DataFrame:
    """Limit the requested band to what the character's voice can carry."""
    emotion = F.lower(F.trim(F.coalesce(T.blank_to_null(F.col("emotion")), F.lit("neutral"))))
    asked = requests.withColumn("effective_emotion", emotion).withColumn(
        "original_requested_band",
        F.coalesce(
            F.nullif(F.col("requested_band"), F.lit(0)),
            E.band(F.coalesce("requested_intensity", F.lit(0.3))),
        ),
    )
    limits = caps.select(
        "doc_id", "char_id", F.col("emotion").alias("effective_emotion"), F.col("max_band").alias("__cap")
    )
    rows = asked.join(limits, ["doc_id", "char_id", "effective_emotion"], "left")
    limit = F.coalesce("__cap", F.lit(5))
    capped = F.col("original_requested_band") > limit
    band = F.least(F.col("original_requested_band"), limit)
    level = F.round(E.band_middle(band), 2)
    label = E.band_text(F.col("effective_emotion"), E.band(level), 0)
    return (
        rows.withColumn("was_capped", capped)
        .withColumn("effective_band", band)
        .withColumn("effective_intensity", level)
        .withColumn("pacing_speed_ratio", F.when(capped, 0.88))
        .withColumn("pause_multiplier", F.when(capped, 1.35))
        .withColumn("expression_override", F.when(capped, "suppressed"))
        .withColumn(
            "compensation_note",
            F.when(
                capped,
                F.concat(
                    F.lit("Vocal intensity capped at Band "), band.cast("string"), F.lit(" ("), label,
                    F.lit("); compensating with tight, clipped articulation and deliberate pauses."),
                ),
            ),
        )
        .drop("__cap")
    )


# ---------------------------------------------------------------- performance


def performance_record(df: DataFrame) -> DataFrame:
    """Fill in a performance direction; missing columns count as unset.

    Reads speaker, addressee, distance, emotion, intensity, displayed_emotion,
    displayed_band, felt_emotion, felt_intensity, felt_band, expression,
    physical_state, emphasis, silence_before, silence_after, is_interrupted and
    director_note.
    """
    have = set(df.columns)

    def c(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    def s(name: str) -> Column:
        return T.blank_to_null(c(name))

    shown = F.lower(F.trim(F.coalesce(s("displayed_emotion"), s("emotion"), F.lit("neutral"))))
    shown_band = F.coalesce(
        c("displayed_band", "int"), E.band(F.coalesce(c("intensity", "double"), F.lit(0.2)))
    )
    felt = F.lower(F.trim(F.coalesce(s("felt_emotion"), shown)))
    felt_level = c("felt_intensity", "double")
    felt_band = F.coalesce(
        c("felt_band", "int"), F.when(felt_level.isNotNull(), E.band(felt_level)), shown_band
    )
    none = F.array().cast("array<string>")
    fields = {
        "speaker": F.trim(F.coalesce(s("speaker"), F.lit("narrator"))),
        "addressee": F.trim(s("addressee")),
        "distance": F.coalesce(s("distance"), F.lit("conversational")),
        "displayed": F.struct(shown.alias("emotion"), shown_band.alias("band")),
        "felt": F.struct(felt.alias("emotion"), felt_band.alias("band")),
        "expression": F.coalesce(s("expression"), F.lit("balanced")),
        "physical_state": F.coalesce(c("physical_state", "array<string>"), none),
        "emphasis": F.coalesce(c("emphasis", "array<string>"), none),
        "silence_before": c("silence_before", "double"),
        "silence_after": c("silence_after", "double"),
        "is_interrupted": F.coalesce(c("is_interrupted", "boolean"), F.lit(False)),
        "director_note": s("director_note"),
    }
    return df.withColumn("performance", F.struct(*[v.alias(k) for k, v in fields.items()]))


def _spoken(text: Column) -> Column:
    return F.concat(F.lit("'"), T.strip(F.coalesce(text, F.lit(""))), F.lit("'"))


def _performance_text(p: Column, text: Column, resolve_override: bool) -> Column:
    return F.concat_ws(" ", _performance_lead(p, resolve_override), _spoken(text))


def _performance_lead(p: Column, resolve_override: bool) -> Column:
    """What the instruction says before the line itself."""
    to, far = p["addressee"], p["distance"]
    address = (
        F.when(
            to.isNotNull() & (far == "intimate"),
            F.concat(F.lit("Speaking directly to "), to, F.lit(" in close, intimate proximity")),
        )
        .when(
            to.isNotNull() & (far == "projected"),
            F.concat(F.lit("Projecting voice across distance to "), to),
        )
        .when(to.isNotNull(), F.concat(F.lit("Speaking to "), to))
        .when(far == "intimate", F.lit("Close, intimate vocal delivery"))
        .when(far == "projected", F.lit("Projected voice, addressing the entire room"))
    )

    def named(x: Column, part: int) -> Column:
        return E.band_text(x["emotion"], E.band(E.band_middle(x["band"])), part)

    shown, felt = p["displayed"], p["felt"]
    mixed = (shown["emotion"] != felt["emotion"]) | (shown["band"] != felt["band"])
    delivery = F.when(
        mixed,
        F.concat(
            F.lit("Surface delivery is "), named(shown, 0), F.lit(" ("), named(shown, 1),
            F.lit("), with underlying suppressed "), named(felt, 0), F.lit(" subtext ("), named(felt, 1),
            F.lit(")"),
        ),
    ).otherwise(
        F.concat(F.lit("Delivery is "), named(shown, 0), F.lit(" ("), named(shown, 1), F.lit(")"))
    )
    mode = F.when(
        p["expression"] == "suppressed", F.lit("tightly held-back, suppressed cadence")
    ).when(p["expression"] == "released", F.lit("open, uninhibited vocal release"))
    note = T.blank_to_null(F.trim(p["director_note"]))
    if resolve_override:
        delivery, mode = F.when(note.isNull(), delivery), F.when(note.isNull(), mode)
    body = F.when(
        F.size(p["physical_state"]) > 0,
        F.concat(F.lit("Physical state: "), F.array_join(p["physical_state"], ", ")),
    )
    stress = F.when(
        F.size(p["emphasis"]) > 0,
        F.concat(
            F.lit("emphasizing the word(s) "),
            F.array_join(
                F.transform(p["emphasis"], lambda w: F.concat(F.lit("'"), w, F.lit("'"))), " and "
            ),
        ),
    )
    director = F.concat(F.lit("[Director: "), note, F.lit("]"))
    clauses = F.concat_ws(", ", address, delivery, mode, body, stress, director)
    return F.concat(F.lit("Say the following with the same voice, "), clauses, F.lit(":"))


def performance_instruction(df: DataFrame, resolve_override: bool = False, text: str = "text") -> DataFrame:
    rows = df if "performance" in df.columns else performance_record(df)
    return rows.withColumn(
        "instruction", _performance_text(F.col("performance"), F.col(text), resolve_override)
    )


def jitter(seed: Column, ratio: float = 0.12) -> Column:
    """Timing factor within ``1 +- ratio`` that depends on the seed text only."""
    share = (F.abs(H.name_hash(seed)) % 1000) / F.lit(1000.0)
    return F.round(F.lit(1.0) + (share * 2.0 - 1.0) * ratio, 3)


def timing_jitter(df: DataFrame, col: str = "seg_id", ratio: float = 0.12) -> DataFrame:
    seed = F.coalesce(T.blank_to_null(F.col(col).cast("string")), F.lit("default_seed"))
    return df.withColumn("jitter", jitter(seed, ratio))


def dramatic_pause(segments: DataFrame, tempo: str = "normal", enable_jitter: bool = True) -> DataFrame:
    """Silence around each line from dashes, ellipses, speaker changes and tension."""
    rows = ordered.neighbours(
        segments,
        ["doc_id"],
        "seg_idx",
        prev={"__pt": T.strip(F.col("text")), "__ps": F.lower(F.trim(F.coalesce("speaker", F.lit(""))))},
    )
    have = set(segments.columns)
    scale = {"fast": 0.75, "slow": 1.25}
    if "scene_tempo" in have:
        speed = E.lookup(F.coalesce("scene_tempo", F.lit(tempo)), scale, F.lit(1.0))
    else:
        speed = F.lit(scale.get(tempo, 1.0))
    text = T.strip(F.coalesce("text", F.lit("")))
    dash, dots = rf"(?:--|—|–){T.WS}*\z", rf"(?:\.\.\.|…){T.WS}*\z"
    speaker = F.lower(F.trim(F.coalesce("speaker", F.lit(""))))
    cut_off = F.coalesce(F.col("__pt").rlike(dash), F.lit(False))
    switch = F.coalesce((F.col("__ps") != "") & (speaker != "") & (F.col("__ps") != speaker), F.lit(False))
    crossed = cut_off & switch
    tense = F.lit(False)
    if {"felt_band", "displayed_band"} <= have:
        tense = F.coalesce(F.abs(F.col("felt_band") - F.col("displayed_band")) >= 2, F.lit(False))
    seed = F.coalesce(T.blank_to_null(F.col("seg_id")), text) if "seg_id" in have else text
    factor = jitter(F.coalesce(T.blank_to_null(seed), F.lit("default_seed"))) if enable_jitter else F.lit(1.0)
    before = F.when(crossed, 0.0).when(cut_off, 0.75).when(tense, 0.95).otherwise(0.45)
    after = F.when(text.rlike(dots), 0.85).otherwise(0.45)
    out = {
        "seconds_before": F.round(before * speed * factor, 3),
        "seconds_after": F.round(after * speed * factor, 3),
        "is_interrupted": text.rlike(dash),
        "is_cross_speaker_interruption": crossed,
        "overlap_seconds": F.when(crossed, -0.15).otherwise(0.0),
    }
    return rows.select(
        *[c for c in segments.columns if c not in out], *[v.alias(n) for n, v in out.items()]
    )


# fixed values: the rungs of the comparison and which parts of the direction each one uses
ABLATION = [
    (1, "Bare Baseline", "Neutral dialogue reading without performance staging"),
    (2, "Intensity Band Only", "Emotion and discrete 1-5 intensity band descriptor"),
    (3, "Subtext Layered", "Surface displayed emotion shaded by underlying felt emotion"),
    (4, "Acoustic Proximity & Addressee", "Subtext plus speaker addressee and acoustic distance"),
    (5, "Targeted Word Emphasis", "Adds 1-2 stressed word markers to proximity and subtext"),
    (6, "Physical State Modifier", "Adds bodily condition tags (e.g. breathless, tired)"),
    (7, "Full Performance Stack", "All directorial fields compiled together"),
    (8, "Human Director Override", "Directorial override note resolving and replacing conflicting staging"),
]
DEFAULT_NOTE = "quieter, she is holding back tears"


def prompt_ablation_grid(segments: DataFrame, default_addressee: str = "the listener") -> DataFrame:
    """Instruction text of each line at eight levels of detail, with its size.

    Reads the columns of :func:`performance_record`; unset ones take the default
    of their level.
    """
    have = set(segments.columns)

    def c(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    def feel(prefix: str, emotion: str, band: int) -> Column:
        name, number = c(f"{prefix}_emotion"), c(f"{prefix}_band", "int")
        unset = name.isNull()
        return F.struct(
            F.when(unset, F.lit(emotion)).otherwise(F.lower(F.trim(name))).alias("emotion"),
            F.when(unset, F.lit(band)).otherwise(F.coalesce(number, E.band(F.lit(0.2)))).alias("band"),
        )

    none = F.array().cast("array<string>")
    plain = F.struct(F.lit("neutral").alias("emotion"), F.lit(1).alias("band"))
    calm, angry = feel("displayed", "calm", 1), feel("felt", "angry", 4)
    loud = feel("displayed", "angry", 4)
    shown = feel("displayed", "neutral", 1)
    felt = F.when(c("felt_emotion").isNull(), shown).otherwise(feel("felt", "neutral", 1))
    to = F.coalesce(T.blank_to_null(c("addressee")), F.lit(default_addressee))
    far = T.blank_to_null(c("distance"))
    physical = F.coalesce(c("physical_state", "array<string>"), none)
    emphasis = F.coalesce(c("emphasis", "array<string>"), none)
    note = T.blank_to_null(c("director_note"))

    def level(n: int, **over: Column) -> Column:
        base = {
            "addressee": F.lit(None).cast("string"),
            "distance": F.lit("conversational"),
            "displayed": plain,
            "felt": plain,
            "expression": F.lit("balanced"),
            "physical_state": none,
            "emphasis": none,
            "director_note": F.lit(None).cast("string"),
            **over,
        }
        _, name, about = ABLATION[n - 1]
        return F.struct(
            F.lit(n).alias("level"),
            F.lit(name).alias("name"),
            F.lit(about).alias("description"),
            F.struct(*[v.alias(k) for k, v in base.items()]).alias("p"),
        )

    def or_list(value: Column, default: str) -> Column:
        given = value if value is not None else none
        return F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(default)))

    whole = {
        "addressee": T.blank_to_null(c("addressee")),
        "distance": F.coalesce(far, F.lit("conversational")),
        "displayed": shown,
        "felt": felt,
        "expression": F.coalesce(T.blank_to_null(c("expression")), F.lit("balanced")),
        "physical_state": physical,
        "emphasis": emphasis,
    }
    grid = F.array(
        level(1),
        level(2, displayed=loud, felt=loud),
        level(3, displayed=calm, felt=angry),
        level(4, displayed=calm, felt=angry, addressee=to, distance=F.coalesce(far, F.lit("intimate"))),
        level(5, displayed=calm, felt=angry, addressee=to,
              distance=F.coalesce(far, F.lit("conversational")), emphasis=or_list(emphasis, "you")),
        level(6, displayed=calm, felt=angry, physical_state=or_list(physical, "tired")),
        level(7, **whole),
        level(8, **whole, director_note=F.coalesce(note, F.lit(DEFAULT_NOTE))),
    )
    def commas(value: Column) -> Column:
        return F.length(value) - F.length(F.replace(value, F.lit(","), F.lit("")))

    # A line stands at all levels: it is counted once, and each level adds its own part, which ends before a space.
    line = F.struct(
        _spoken(F.col("text")).alias("text"), T.words(_spoken(F.col("text"))).alias("words"),
        commas(_spoken(F.col("text"))).alias("commas"), T.words(F.col("text")).alias("spoken"),
    )
    rows = segments.withColumn("__line", line).select("doc_id", "seg_idx", "__line", F.explode(grid).alias("g"))
    rows = rows.withColumn("lead", _performance_lead(F.col("g.p"), False)).select(
        "doc_id", "seg_idx", "__line", "lead", "g.level", "g.name",
        F.concat_ws(" ", "lead", "__line.text").alias("instruction"),
        (T.words(F.col("lead")) + F.col("__line.words")).alias("size"),
        (commas(F.col("lead")) + F.col("__line.commas")).alias("commas"),
    )
    size, commas, spoken = F.col("size"), F.col("commas"), F.col("__line.spoken")
    clauses = F.when(commas > 0, commas).otherwise(F.lit(1))
    ratio = F.when(spoken > 0, size / spoken).otherwise(F.lit(1.0))
    risk = (
        F.when((ratio > 6.0) & (size > 35), "high")
        .when((ratio > 3.5) | (clauses > 5), "medium")
        .otherwise("low")
    )
    return rows.select(
        "doc_id",
        "seg_idx",
        "level",
        "name",
        "instruction",
        F.length("instruction").alias("instruction_chars"),
        size.alias("instruction_words"),
        clauses.alias("clause_count"),
        risk.alias("leakage_risk"),
    )


def speech_duration_estimate(segments: DataFrame) -> DataFrame:
    """Expected seconds of speech from words and punctuation, or from a hint."""
    hint = F.col("gen_seconds") if "gen_seconds" in segments.columns else F.lit(None).cast("double")
    marks = F.regexp_count("text", F.lit("[,.?!;:]"))
    raw = F.round(T.words(F.col("text")) / F.lit(2.3) + marks * 0.3 + 0.5, 1)
    estimate = F.greatest(F.lit(1.5), F.least(F.lit(28.0), raw))
    given = F.greatest(F.lit(1.0), F.least(F.lit(28.0), F.round(hint, 1)))
    return segments.withColumn(
        "estimated_seconds", F.when(F.coalesce(hint, F.lit(0.0)) != 0, given).otherwise(estimate)
    )
