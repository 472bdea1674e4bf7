"""Cast lists: aliases, name folding, profiles and who is in a scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hashing as H
from ..functions import text as T

# fixed values: titles that may stand before a surname
HONORIFICS = [
    "dr.", "dr", "doctor", "mr.", "mr", "mister", "mrs.", "mrs", "miss", "ms.", "ms",
    "captain", "capt.", "capt", "detective", "det.", "det", "sergeant", "sgt.", "sgt",
    "professor", "prof.", "prof", "lord", "lady", "sir", "madam",
]
# fixed values: words that never link two names
TITLE_WORDS = [
    "the", "a", "an", "mr", "mrs", "ms", "miss", "dr", "sir", "madam", "uncle", "aunt",
]


def alias_key(name: Column) -> Column:
    k = F.lower(F.coalesce(name, F.lit("")))
    k = F.regexp_replace(k, "[’']", "")
    k = F.regexp_replace(k, f"[^A-Za-z0-9_{T.SPACE}]", " ")
    return T.strip(F.regexp_replace(k, f"{T.WS}+", " "))


def alias_index(cast: DataFrame) -> DataFrame:
    """Lookup from every spelling of a name to the full name; later rows win."""
    name = T.strip(F.col("name"))
    tokens = F.split(name, f"{T.WS}+", -1)
    ends = F.when(
        F.size(tokens) > 1, F.array(F.element_at(tokens, 1), F.element_at(tokens, -1))
    ).otherwise(F.array().cast("array<string>"))
    spellings = F.concat(
        F.array(name), ends, F.coalesce("aliases", F.array().cast("array<string>"))
    )
    return (
        cast.where(name != "")
        .select("doc_id", "ord", name.alias("canonical"), F.explode(spellings).alias("alias"))
        .where("alias IS NOT NULL AND alias <> ''")
        .groupBy("doc_id", alias_key(F.col("alias")).alias("alias_key"))
        .agg(F.max_by("canonical", "ord").alias("canonical"))
    )


def resolve_alias(segments: DataFrame, index: DataFrame, col: str = "speaker") -> DataFrame:
    """Replace a speaker by the full name: exact key, then without a title."""
    titles = "|".join(h for h in HONORIFICS if not h.endswith("."))
    key = alias_key(F.col(col))
    keyed = segments.withColumn("__k1", key).withColumn(
        "__k2", T.strip(F.regexp_replace(key, f"^(?:{titles}) ", ""))
    )
    first = index.select("doc_id", F.col("alias_key").alias("__k1"), F.col("canonical").alias("__c1"))
    second = index.select("doc_id", F.col("alias_key").alias("__k2"), F.col("canonical").alias("__c2"))
    found = keyed.join(first, ["doc_id", "__k1"], "left").join(second, ["doc_id", "__k2"], "left")
    resolved = (
        F.when(F.coalesce(F.col(col), F.lit("")) == "", F.lit("unknown"))
        .otherwise(F.coalesce("__c1", "__c2", T.strip(F.col(col))))
    )
    return found.withColumn("resolved_speaker", resolved).drop("__k1", "__k2", "__c1", "__c2")


def discover_aliases(manuscripts: DataFrame, cast: DataFrame) -> DataFrame:
    """Count "title surname" in each book for cast members with a surname.

    Every title in a text is read once with the word after it; the counts are
    then joined to the surnames, so no text is scanned per cast member.
    """
    titles = "|".join(h.replace(".", r"\.") for h in HONORIFICS)
    pattern = rf"(?i)(?<!{T.W})({titles})(?={T.WS}+([A-Za-z0-9_\x{{c0}}-\x{{24f}}'’-]+))"
    hits = manuscripts.select(
        "doc_id",
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("title"),
                F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("word"),
            )
        ).alias("h"),
    )
    word = F.lower("h.word")
    spellings = F.array_distinct(
        F.array(word, F.regexp_extract(word, r"^[a-z0-9_\x{c0}-\x{24f}]+", 0))
    )
    counted = (
        hits.select("doc_id", F.lower("h.title").alias("title"), F.explode(spellings).alias("surname"))
        .groupBy("doc_id", "title", "surname")
        .agg(F.count(F.lit(1)).alias("occurrence_count"))
    )
    tokens = F.split(T.strip(F.col("name")), f"{T.WS}+", -1)
    surnames = cast.where(F.size(tokens) > 1).select(
        "doc_id", F.col("name").alias("canonical_name"), F.element_at(tokens, -1).alias("__s")
    )
    joined = counted.join(
        surnames.withColumn("surname", F.lower("__s")), ["doc_id", "surname"]
    )
    return joined.select(
        "doc_id",
        "canonical_name",
        F.concat_ws(" ", T.capitalise(F.col("title")), "__s").alias("suggested_alias"),
        "occurrence_count",
    )


def name_words(name: Column) -> Column:
    return F.array_distinct(
        F.filter(
            F.split(F.lower(name), rf"(?:{T.WS}|-)+", -1),
            lambda w: (w != "") & ~w.isin(TITLE_WORDS),
        )
    )


def merge_cast_names(names: DataFrame, cast: DataFrame) -> DataFrame:
    """Fold a name into the first cast name that shares a word with it."""
    asked = names.select("doc_id", "name").distinct()
    links = asked.where(~F.col("name").isin("Narrator", "Unknown")).select(
        "doc_id", "name", F.explode(name_words(F.col("name"))).alias("word")
    )
    known = cast.select(
        "doc_id", "ord", F.col("name").alias("cast_name"), F.explode(name_words(F.col("name"))).alias("word")
    )
    # The first cast name per word is enough, which keeps the join one-to-one.
    first = known.groupBy("doc_id", "word").agg(F.min(F.struct("ord", "cast_name")).alias("c"))
    folded = (
        links.join(first, ["doc_id", "word"])
        .groupBy("doc_id", "name")
        .agg(F.min("c")["cast_name"].alias("folded"))
    )
    return asked.join(folded, ["doc_id", "name"], "left").select(
        "doc_id", "name", F.coalesce("folded", "name").alias("merged_name")
    )


# fixed values: age words in a voice description, first match wins
AGE_WORDS = [
    ("Child", ["child", "young girl", "young boy"]),
    ("Teenager", ["teenager", "teen", "fourteen", "adolescent"]),
    ("Young Adult", ["young adult", "young woman", "young man"]),
    ("Middle-Aged", ["middle-aged", "middle aged"]),
    ("Elderly", ["elderly", "old"]),
]


def profile_gender(profile: Column) -> Column:
    return (
        F.when(profile.contains("female"), "Female")
        .when(profile.contains("male"), "Male")
        .otherwise("Unknown")
    )


def profile_age(profile: Column) -> Column:
    out = F.lit("Adult")
    for label, stems in reversed(AGE_WORDS):
        out = F.when(profile.rlike("|".join(stems)), F.lit(label)).otherwise(out)
    return out


def merge_cast_profiles(cast: DataFrame, discovered: DataFrame) -> DataFrame:
    """Upsert discovered profiles into the cast; locked rows stay as they are.

    A discovered name folds into the first cast name that shares a word, or into
    an earlier discovered name that does and is itself new. The last profile of
    a name wins.
    """
    folded = merge_cast_names(discovered, cast)
    fresh = folded.where(F.col("merged_name") == F.col("name")).join(
        cast.select("doc_id", "name"), ["doc_id", "name"], "left_anti"
    )
    order = discovered.groupBy("doc_id", "name").agg(F.min("ord").alias("ord"))
    heads = fresh.join(order, ["doc_id", "name"]).select("doc_id", "ord", "name")
    among = merge_cast_names(fresh, heads).select(
        "doc_id", "name", F.col("merged_name").alias("__among")
    )
    text = F.lower(
        F.coalesce(T.blank_to_null(F.col("voice_profile")), T.blank_to_null(F.col("base_voice")), F.lit(""))
    )
    newest = (
        discovered.join(folded, ["doc_id", "name"])
        .join(among, ["doc_id", "name"], "left")
        .withColumn("key", F.coalesce("__among", "merged_name"))
        .groupBy("doc_id", F.col("key").alias("name"))
        .agg(
            F.min("ord").alias("d_ord"),
            F.max_by(
                F.struct(
                    F.coalesce(T.blank_to_null(F.col("gender")), profile_gender(text)).alias("gender"),
                    F.coalesce(T.blank_to_null(F.col("implied_age")), profile_age(text)).alias("age"),
                    F.coalesce(
                        T.blank_to_null(F.col("voice_profile")),
                        T.blank_to_null(F.col("base_voice")),
                        F.lit("Normal physical voice"),
                    ).alias("voice_profile"),
                    F.coalesce(
                        T.blank_to_null(F.col("personality_traits")),
                        T.blank_to_null(F.col("voice_profile")),
                        F.lit("Story character"),
                    ).alias("traits"),
                ),
                "ord",
            ).alias("d"),
        )
    )
    merged = cast.join(newest, ["doc_id", "name"], "full")
    locked = F.coalesce("is_locked", F.lit(False))
    out = {
        c: F.when(F.col("d").isNotNull() & ~locked, F.col(f"d.{c}")).otherwise(F.col(c))
        for c in ("gender", "age", "voice_profile")
    }
    return merged.select(
        "doc_id",
        "name",
        *[v.alias(c) for c, v in out.items()],
        F.when(F.col("d").isNotNull() & ~locked, F.col("d.traits")).alias("traits"),
        locked.alias("is_locked"),
        F.col("ord").isNull().alias("is_new"),
        F.when(F.col("ord").isNull(), H.name_seed(F.col("name"))).alias("seed"),
    )


def cast_variants(cast: DataFrame) -> DataFrame:
    """One row per spelling of a cast member, as matched in prose."""
    return (
        cast.select(
            "doc_id",
            "char_id",
            "ord",
            F.posexplode(
                F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
            ).alias("variant_ord", "variant"),
        )
        .where("variant IS NOT NULL AND variant <> ''")
        .withColumn("variant", F.lower("variant"))
        .withColumn("head", F.regexp_extract("variant", r"[\w\x{c0}-\x{24f}]+", 0))
    )


def word_bag(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\w\x{c0}-\x{24f}]+"), F.lit(0)))


def name_regex(variant: Column) -> Column:
    """Case-insensitive pattern of a spelling at word boundaries."""
    return F.concat(
        F.lit(f"(?i)(?<!{T.W})"), T.quote_pattern(variant), F.lit(f"(?!{T.W})")
    )


def mentions(texts: DataFrame, cast: DataFrame, on: list[str]) -> DataFrame:
    """Cast members whose name or alias stands in a text: ``doc_id``, ``on`` and the spelling.

    Joined on the first word of the spelling, so the number of candidate rows is
    bounded by the words of the text. The text itself does not take part in that join;
    only spellings of several words fetch it, by ``on``, to be checked in full.
    """
    columns = ["doc_id", *on, "char_id", "ord", "variant_ord", "variant"]
    words = texts.select("doc_id", *on, F.explode(word_bag(F.col("text"))).alias("head"))
    spellings = cast_variants(cast)
    whole = F.col("variant") == F.col("head")
    short = words.join(spellings.where(whole), ["doc_id", "head"]).select(*columns)
    long = words.join(spellings.where(~whole), ["doc_id", "head"]).select(*columns)
    full = F.contains(F.lower("text"), F.col("variant")) & F.rlike("text", name_regex(F.col("variant")))
    checked = long.join(texts.select("doc_id", *on, "text"), ["doc_id", *on]).where(full).select(*columns)
    return short.unionByName(checked)


def scene_cast(paragraphs: DataFrame, cast: DataFrame, minimum: int = 2) -> DataFrame:
    """Cast named in each scene; the whole cast where fewer than ``minimum`` are."""
    named = mentions(paragraphs, cast, ["scene_id", "para_idx"]).select("doc_id", "scene_id", "char_id")
    scenes = paragraphs.select("doc_id", "scene_id", F.lit(None).cast(named.schema["char_id"].dataType).alias("char_id"))
    present = named.unionByName(scenes).groupBy("doc_id", "scene_id").agg(F.collect_set("char_id").alias("__named"))
    casts = cast.groupBy("doc_id").agg(
        F.collect_set("char_id").alias("__all"), F.collect_set(F.when(F.col("always_present"), F.col("char_id"))).alias("__always")
    )
    found = F.array_union("__named", "__always")
    rows = present.join(casts, "doc_id").withColumn("__found", found)
    enough = F.size("__found") >= minimum
    return rows.select(
        "doc_id", "scene_id", F.explode(F.when(enough, F.col("__found")).otherwise(F.col("__all"))).alias("char_id"), enough.alias("is_named")
    )


def scene_cast_counts(paragraphs: DataFrame, cast: DataFrame) -> DataFrame:
    """Paragraphs of each scene that name a character."""
    found = mentions(paragraphs, cast, ["scene_id", "para_idx"]).select(
        "doc_id", "scene_id", "para_idx", "char_id"
    )
    return (
        found.distinct()
        .groupBy("doc_id", "scene_id", "char_id")
        .agg(F.count(F.lit(1)).alias("paragraphs"))
    )


def autocast(segments: DataFrame, cast: DataFrame, model: str = "default") -> DataFrame:
    """Default voice settings for speakers that have none."""
    speakers = (
        segments.where("speaker IS NOT NULL AND speaker NOT IN ('', 'Narrator')")
        .select("doc_id", F.col("speaker").alias("name"))
        .distinct()
    )
    return speakers.join(cast.select("doc_id", "name"), ["doc_id", "name"], "left_anti").select(
        "doc_id",
        "name",
        F.lit(model).alias("model"),
        F.lit("auto").alias("gender"),
        H.name_seed(F.col("name")).alias("seed"),
        F.lit(1.0).alias("speed"),
        F.lit(0).alias("pitch"),
    )
