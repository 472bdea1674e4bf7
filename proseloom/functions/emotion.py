"""Emotion palette, intensity bands and the labels that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: intensity bands by emotion, (label, description) for bands 1 to 5
BANDS = {
    "angry": [
        ("irritated", "mildly annoyed, slight edge in tone"),
        ("frustrated", "visibly displeased, strained patience"),
        ("angry", "firm, stern, unmistakable anger"),
        ("furious", "intense, seething, venomous fury"),
        ("enraged", "explosive, ballistic, trembling with rage"),
    ],
    "fearful": [
        ("uneasy", "wary, hesitant, slight caution"),
        ("anxious", "nervous, rapid breathing, unsettled"),
        ("fearful", "scared, defensive, clear tremble"),
        ("terrified", "intense terror, high-tension panic"),
        ("hysterical", "paralyzed with dread, breathless shock"),
    ],
    "sad": [
        ("somber", "quiet, wistful, subdued"),
        ("gloomy", "downcast, dejected, heavy cadence"),
        ("sorrowful", "sad, melancholic, cracking voice"),
        ("heartbroken", "grief-stricken, choked with emotion"),
        ("despairing", "anguished, completely broken, weeping"),
    ],
    "happy": [
        ("content", "pleased, mild smile, relaxed"),
        ("cheerful", "upbeat, warm, approachable"),
        ("happy", "bright, joyful, noticeable lift"),
        ("delighted", "radiant, laughing, energized"),
        ("ecstatic", "euphoric, triumphant, bubbling over"),
    ],
    "surprised": [
        ("intrigued", "curious, caught by surprise"),
        ("startled", "taken aback, sharp intake of air"),
        ("surprised", "wide-eyed, clear astonishment"),
        ("shocked", "stunned, disbelieving, breathless"),
        ("thunderstruck", "dumbfounded, speech momentarily halted"),
    ],
    "disgusted": [
        ("distasteful", "mild disapproval, curled lip"),
        ("scornful", "sneering, disdainful"),
        ("disgusted", "revolted, unmistakable aversion"),
        ("repulsed", "deep visceral disgust, shuddering"),
        ("nauseated", "sickened, choking back nausea"),
    ],
    "excited": [
        ("eager", "engaged, focused interest"),
        ("animated", "lively, brisk cadence"),
        ("excited", "high-energy, spirited projection"),
        ("thrilled", "exhilarated, electric delivery"),
        ("fervent", "wild enthusiasm, breathless intensity"),
    ],
    "calm": [
        ("steady", "even, standard delivery"),
        ("collected", "composed, unhurried"),
        ("calm", "soothing, tranquil, soft pace"),
        ("serene", "deeply peaceful, meditative"),
        ("tranquil", "whisper-soft, utterly still"),
    ],
    "neutral": [
        ("neutral", "balanced, natural speech"),
        ("neutral", "clear, balanced narrator prose"),
        ("matter-of-fact", "direct, informative, factual"),
        ("detached", "clinical, emotionally reserved"),
        ("monotone", "flat, completely devoid of inflection"),
    ],
}
# fixed values: nouns that stand for a palette emotion
SYNONYMS = {
    "anger": "angry", "rage": "angry", "fear": "fearful", "terror": "fearful",
    "sadness": "sad", "grief": "sad", "joy": "happy", "happiness": "happy",
    "surprise": "surprised", "disgust": "disgusted", "excitement": "excited",
}
# fixed values: upper edge of bands 1 to 4
BAND_EDGES = [0.20, 0.40, 0.65, 0.85]
# fixed values: palette label, base intensity and the word stems that select it, in order
PALETTE = [
    ("angry", 0.85, ["angry", "furious", "snarl", "rage"]),
    ("sad", 0.80, ["sad", "sorrow", "grief", "melanchol"]),
    ("fearful", 0.85, ["fear", "terror", "panic", "afraid", "trembl"]),
    ("excited", 0.80, ["excit", "eager", "enthusias"]),
    ("happy", 0.75, ["happ", "joy", "warmth", "laugh"]),
    ("surprised", 0.75, ["surpris", "shock", "startl"]),
    ("disgusted", 0.75, ["disgust", "sneer", "bitter"]),
    ("neutral", 0.50, ["neutral"]),
]
WHISPER_STEMS = ["whisper", "hushed", "under breath", "murmur"]
# fixed values: similarity a take must reach against its anchor, by band
DRIFT_THRESHOLDS = {1: 0.75, 2: 0.73, 3: 0.70, 4: 0.65, 5: 0.60}


def contains_any(text: Column, stems: list[str]) -> Column:
    found = F.contains(text, F.lit(stems[0]))
    for stem in stems[1:]:
        found = found | F.contains(text, F.lit(stem))
    return found


def lookup(key: Column, table: dict, default: Column) -> Column:
    """Value of a small fixed table, as a map literal."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def band(intensity: Column) -> Column:
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(intensity, F.lit(0.0))))
    out = F.lit(len(BAND_EDGES) + 1)
    for number, edge in reversed(list(enumerate(BAND_EDGES, 1))):
        out = F.when(level <= edge, F.lit(number)).otherwise(out)
    return out


def palette_key(emotion: Column) -> Column:
    """Name of the palette row an emotion word belongs to."""
    key = F.lower(F.trim(F.coalesce(F.nullif(emotion, F.lit("")), F.lit("neutral"))))
    key = lookup(key, SYNONYMS, key)
    return F.when(key.isin(list(BANDS)), key).otherwise(F.lit("neutral"))


def band_text(emotion: Column, number: Column, part: int) -> Column:
    """Label (``part`` 0) or description (1) of an emotion at a band."""
    table = {f"{e}{i}": row[part] for e, rows in BANDS.items() for i, row in enumerate(rows, 1)}
    key = F.concat(palette_key(emotion), number.cast("string"))
    return lookup(key, table, F.lit(None).cast("string"))


def band_middle(number: Column) -> Column:
    """Intensity in the middle of a band."""
    return (number - F.lit(0.5)) / F.lit(5.0)


def drift_threshold(number: Column) -> Column:
    return lookup(number.cast("int"), DRIFT_THRESHOLDS, F.lit(DRIFT_THRESHOLDS[1]))
