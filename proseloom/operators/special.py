"""Inner thoughts, acoustic contexts, letters and walk-on voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import emotion as E
from ..functions import hashing as H
from ..functions import text as T

# fixed values: filter chain of each acoustic context
FILTERS = {
    "none": "anull",
    "phone_call": "highpass=f=300,lowpass=f=3400,volume=1.05",
    "radio_intercom": "highpass=f=450,lowpass=f=2800,volume=1.1,aecho=0.8:0.88:12:0.25",
    "through_wall": "lowpass=f=550,volume=0.85",
    "recording_device": "highpass=f=200,lowpass=f=4000,volume=1.0",
    "megaphone_pa": "highpass=f=500,lowpass=f=4500,volume=1.2,aecho=0.8:0.7:40:0.3",
}
# fixed values: walk-on voices (pool, preset, pitch offset in semitones, speed)
WALK_ONS = [
    ("walkon_male_mature", "Eric", -1, 0.98),
    ("walkon_male_brisk", "Dylan", 0, 1.05),
    ("walkon_male_gravel", "Marcus", -2, 0.94),
    ("walkon_female_warm", "Serena", 0, 1.0),
    ("walkon_female_crisp", "Elena", 1, 1.04),
    ("walkon_female_soft", "Chloe", -1, 0.96),
]
# fixed values: who reads a letter, and how
LETTER_STYLES = {
    "recipient_voice": "reading aloud, paced cadence, slightly flat document delivery",
    "narrator_formal": "formal document narration, measured, neutral pace",
    "sender_voice": "epistolary reading, as if spoken directly from the writer's memory",
}
# fixed values: words that tell a thought
THOUGHT_VERBS = (
    r"(?i)\b(?:thought|wondered|mused|reflected|realized|said to (?:himself|herself|themselves))\b"
)


def inner_thought(segments: DataFrame) -> DataFrame:
    """Flag unspoken lines by italics, thought verbs or an explicit mark."""
    raw = T.strip(F.coalesce("text", F.lit("")))
    direction = F.lower(T.strip(F.coalesce("direction", F.lit(""))))
    starred = raw.rlike(r"^(\*|_)[^*_]+(\*|_)$") | raw.rlike(r"^\*[^*]+\*$")
    tagged = raw.rlike(r"(?i)^<i>[^<]+</i>$")
    directed = direction.rlike(THOUGHT_VERBS)
    marked = (
        F.coalesce("is_thought", F.lit(False)) if "is_thought" in segments.columns else F.lit(False)
    )
    told = raw.rlike(THOUGHT_VERBS) & (F.coalesce("type", F.lit("")) != "dialogue")
    thought = starred | tagged | directed | marked | told
    return segments.select(
        "*",
        thought.alias("is_inner_thought"),
        F.when(starred, T.strip(F.regexp_replace(raw, r"^(\*|_)+|(\*|_)+$", "")))
        .when(tagged, T.strip(F.regexp_replace(raw, r"(?i)^<i>|</i>$", "")))
        .otherwise(raw)
        .alias("thought_text"),
        F.when(thought & (starred | directed), 0.95).when(thought, 0.75).otherwise(0.0).alias("thought_confidence"),
        F.when(thought, "intimate").otherwise("conversational").alias("distance"),
        F.when(thought, "suppressed").otherwise("balanced").alias("expression"),
        F.when(thought, 0.96).otherwise(1.0).alias("pacing_speed_ratio"),
    )


def acoustic_context(segments: DataFrame, col: str = "acoustic_context") -> DataFrame:
    name = F.coalesce(T.blank_to_null(F.col(col)), F.lit("none"))
    key = F.regexp_replace(F.lower(T.strip(name)), rf"(?:{T.WS}|-)+", "_")
    return segments.withColumn("filter_chain", E.lookup(key, FILTERS, F.lit(FILTERS["none"])))


def epistolary_reader(letters: DataFrame, policies: DataFrame) -> DataFrame:
    """Reader of each letter under the policy of its book."""
    rows = letters.join(policies.select("doc_id", "policy", "narrator_voice"), "doc_id", "left")
    narrator = F.coalesce(T.blank_to_null(F.col("narrator_voice")), F.lit("Narrator"))
    to_reader = F.coalesce(T.blank_to_null(F.col("recipient")), narrator)
    from_writer = F.coalesce(T.blank_to_null(F.col("sender")), narrator)
    return rows.select(
        *letters.columns,
        F.when(F.col("policy") == "recipient_voice", to_reader)
        .when(F.col("policy") == "narrator_formal", narrator)
        .otherwise(from_writer)
        .alias("resolved_speaker"),
        E.lookup(F.col("policy"), LETTER_STYLES, F.lit(LETTER_STYLES["sender_voice"])).alias("delivery_style"),
    )


def minor_voice_pool(speakers: DataFrame, col: str = "name", gender: str = "gender_hint") -> DataFrame:
    """Stable walk-on voice of a name, within its gender when that is known."""

    def pool(part: str | None):
        rows = [r for r in WALK_ONS if part is None or r[0].startswith(f"walkon_{part}_")]
        return F.array(
            *[
                F.struct(
                    F.lit(p).alias("pool_id"),
                    F.lit(preset).alias("base_preset"),
                    F.lit(pitch).alias("pitch_offset"),
                    F.lit(speed).alias("speed_ratio"),
                )
                for p, preset, pitch, speed in rows
            ]
        )

    name = F.lower(F.trim(F.coalesce(T.blank_to_null(F.col(col)), F.lit("incidental"))))
    pick = F.abs(H.name_hash(name))
    voice = (
        F.when(F.col(gender).isin("male", "female"),
               F.when(F.col(gender) == "male", F.element_at(pool("male"), (pick % 3 + 1).cast("int")))
               .otherwise(F.element_at(pool("female"), (pick % 3 + 1).cast("int"))))
        .otherwise(F.element_at(pool(None), (pick % len(WALK_ONS) + 1).cast("int")))
    )
    return speakers.withColumn("__v", voice).select(*speakers.columns, "__v.*")
