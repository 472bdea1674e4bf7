"""Pronunciation lexicon: upserts, replacement and unusual tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import ordered

RULE = ["target_word", "replacement", "type", "case_sensitive"]
# fixed values: kinds of replacement
TYPES = ["respelling", "phoneme", "expansion"]
# fixed values: common words that are never unusual tokens
STOPWORDS = [
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as",
    "you", "do", "at", "this", "but", "his", "by", "from", "they", "we", "say", "her", "she", "or", "an", "will",
    "my", "one", "all", "would", "there", "their", "what", "so", "up", "out", "if", "about", "who", "get", "which",
    "go", "me", "when", "make", "can", "like", "time", "no", "just", "him", "know", "take", "people", "into", "year",
    "your", "good", "some", "could", "them", "see", "other", "than", "then", "now", "look", "only", "come", "its",
    "over", "think", "also",
]


def normalise_entries(entries: DataFrame) -> DataFrame:
    """Trim entries, drop blank ones and default an unknown type."""
    kind = F.when(F.col("type").isin(TYPES), F.col("type")).otherwise(F.lit("respelling"))
    return (
        entries.withColumn("target_word", T.strip(F.col("target_word")))
        .withColumn("replacement", T.strip(F.col("replacement")))
        .where("target_word <> '' AND replacement <> ''")
        .withColumn("type", kind)
        .withColumn("case_sensitive", F.coalesce("case_sensitive", F.lit(False)))
        .withColumn("notes", T.strip(F.coalesce("notes", F.lit(""))))
    )


def lexicon_upsert(lexicon: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace entries of the same word, whatever its case; the last update wins."""
    fold = F.lower("target_word")
    latest = (
        updates.withColumn("__k", fold)
        .groupBy("doc_id", "__k")
        .agg(F.max_by(F.struct(*RULE, "notes"), F.col("arrival_ord")).alias("u"))
    )
    kept = lexicon.withColumn("__k", fold).join(latest, ["doc_id", "__k"], "left_anti").drop("__k")
    new = latest.select("doc_id", "u.*").withColumn(
        "type", F.coalesce("type", F.lit("respelling"))
    ).withColumn("case_sensitive", F.coalesce("case_sensitive", F.lit(False)))
    return kept.select("doc_id", *RULE, "notes").unionByName(new)


def _rule_pattern(rule: Column) -> Column:
    word = rule["target_word"]
    return F.concat(
        F.when(~rule["case_sensitive"], F.lit("(?i)")).otherwise(F.lit("")),
        F.when(word.rlike(f"^{T.W}"), F.lit(f"(?<!{T.W})")).otherwise(F.lit("")),
        T.quote_pattern(word),
        F.when(word.rlike(f"{T.W}$"), F.lit(f"(?!{T.W})")).otherwise(F.lit("")),
    )


def _replace(text: Column, rules: Column, applied: Column) -> Column:
    """Apply the rules in order; each one sees the text the rules before left. ``seen`` has all texts on the way."""

    def step(acc: Column, rule: Column) -> Column:
        word = rule["target_word"]
        present = F.when(rule["case_sensitive"], F.contains(acc["text"], word)).otherwise(
            F.contains(F.lower(acc["text"]), F.lower(word))
        )
        pattern = _rule_pattern(rule)
        # A rule whose word is not there costs one substring search and no regex.
        hits = F.when(present, F.regexp_count(acc["text"], pattern)).otherwise(F.lit(0))
        entry = F.struct(
            word.alias("target_word"),
            rule["replacement"].alias("replacement"),
            rule["type"].alias("type"),
            hits.alias("occurrences"),
        )
        return F.when(
            hits > 0,
            F.struct(
                F.regexp_replace(acc["text"], pattern, T.quote_replacement(rule["replacement"])).alias("text"),
                F.concat(acc["applied"], F.array(entry)).alias("applied"),
                F.concat(acc["seen"], F.array(F.regexp_replace(acc["text"], pattern, T.quote_replacement(rule["replacement"])))).alias("seen"),
            ),
        ).otherwise(acc)

    none = F.array().cast("array<string>")
    return F.aggregate(rules, F.struct(text.alias("text"), applied.alias("applied"), none.alias("seen")), step)


_APPLIED = "array<struct<target_word:string,replacement:string,type:string,occurrences:int>>"
_RULE = "struct<target_word:string,replacement:string,type:string,case_sensitive:boolean>"
_PLACED = f"array<struct<at:struct<scope:int,len:int,ord:bigint,word:string>,rule:{_RULE}>>"


def _lookup_keys(text: Column) -> Column:
    """What a rule can be found by: the words of a text in lower case, and its other signs one by one."""
    words = F.transform(F.regexp_extract_all(text, F.lit(f"{T.W}+"), F.lit(0)), F.lower)
    return F.array_union(words, F.regexp_extract_all(text, F.lit("[^A-Za-z0-9_ ]"), F.lit(0)))


def _rule_key(word: Column) -> Column:
    """The first word inside a rule's word, which a match holds as a whole word; else its first sign."""
    first = F.regexp_extract(word, f"{T.W}+", 0)
    return F.when(first != "", F.lower(first)).otherwise(F.substring(word, 1, 1))


def apply_lexicon(segments: DataFrame, lexicon: DataFrame, line_rules: DataFrame | None = None) -> DataFrame:
    """Whole-word replacement, longest word first; rules of the line come first.

    ``line_rules``: doc_id, seg_idx and the rule columns. Each rule sees the text that
    the rules before it left. A line meets only the rules of its book whose first word it
    holds: its words are joined with the first words of the rules. Where a replacement brings words
    that other rules begin with, the line meets these too and is done again, until no
    line meets further rules; so the cost follows the matches, however many rules a book has.
    """
    line = ["doc_id", "seg_idx"]

    def ruled(rules: DataFrame, scope: int) -> DataFrame:
        given = F.col("ord").cast("bigint") if "ord" in rules.columns else F.lit(0).cast("bigint")
        at = F.struct(F.lit(scope).alias("scope"), (-F.length("target_word")).alias("len"), given.alias("ord"), F.col("target_word").alias("word"))
        placed = F.struct(at.alias("at"), F.struct(*RULE).alias("rule")).alias("placed")
        return normalise_entries(rules).select(*line[: 1 + (scope == 0)], _rule_key(F.col("target_word")).alias("key"), placed)

    book = ordered.cut_lineage(ruled(lexicon, 1))

    def met(rows: DataFrame, keys: Column) -> DataFrame:
        """The rules of the book that begin with one of the keys of a line."""
        asked = rows.select(*line, F.explode(keys).alias("key")).distinct()
        return asked.join(book, ["doc_id", "key"]).select(*line, "placed")

    def replaced(rows: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        rules = F.transform("__rules", lambda x: x["rule"])
        done = _replace(text, rules, F.array().cast(_APPLIED))
        rows = ordered.cut_lineage(rows.withColumn("__done", done))
        # Keys that came with replacements.
        brought = F.array_distinct(F.flatten(F.transform("__done.seen", _lookup_keys)))
        return rows.withColumn("__new", F.array_except(brought, _lookup_keys(text)))

    found = met(segments, _lookup_keys(F.coalesce("text", F.lit(""))))
    if line_rules is not None:
        found = found.unionByName(ruled(line_rules, 0).select(*line, "placed"))
    found = found.groupBy(*line).agg(F.collect_list("placed").cast(_PLACED).alias("__rules"))
    rows = segments.join(found, line, "left").withColumn("__rules", F.array_sort(F.coalesce("__rules", F.array().cast(_PLACED))))
    rows, finished = replaced(rows), None
    while True:
        more = met(rows.where(F.size("__new") > 0), F.col("__new")).groupBy(*line).agg(F.collect_list("placed").cast(_PLACED).alias("__more"))
        again = rows.join(more, line, "left")
        again = again.withColumn("__more", F.array_except(F.coalesce("__more", F.array().cast(_PLACED)), "__rules"))
        again = ordered.cut_lineage(again)
        settled = again.where(F.size("__more") == 0)
        finished = settled if finished is None else finished.unionByName(settled)
        if not again.where(F.size("__more") > 0).take(1):
            break
        rows = again.where(F.size("__more") > 0).withColumn("__rules", F.array_sort(F.array_union("__rules", "__more")))
        rows = replaced(rows.drop("__more", "__done", "__new"))
    return finished.select(
        *[c for c in segments.columns if c != "text"],
        F.col("__done.text").alias("text"),
        F.col("__done.applied").alias("applied"),
    )


TOKEN = rf"(?<!{T.W})[A-Z][a-zA-Z0-9'-]{{1,30}}(?:(?<={T.W})(?!{T.W})|(?<!{T.W})(?={T.W}))"


def rare_tokens(manuscripts: DataFrame, minimum: int = 1, margin: int = 30) -> DataFrame:
    """Capitalised tokens of each book with count, first context and acronym flag.

    A book is cut into lines that carry a margin of the text around them, so the
    context of a token is known without moving the whole book to it.
    """
    lines = F.aggregate(
        F.split("text", "\n", -1),
        F.struct(
            F.lit(0).alias("at"), F.array().cast("array<struct<start:int,line:string>>").alias("out")
        ),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s) + 1).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), s.alias("line")))).alias("out"),
        ),
        lambda acc: F.filter(acc["out"], lambda x: x["line"].rlike("[A-Z]")),
    )
    rows = manuscripts.select("doc_id", "text", F.explode(lines).alias("l")).select(
        "doc_id",
        F.col("l.start").alias("start"),
        F.least(F.col("l.start"), F.lit(margin)).alias("lead"),
        F.length("l.line").alias("len"),
        F.concat(
            T.from_offset(F.col("text"), F.col("l.start") - margin, F.least(F.col("l.start"), F.lit(margin))),
            F.col("l.line"),
            T.from_offset(F.col("text"), F.col("l.start") + F.length("l.line"), F.lit(margin)),
        ).alias("wide"),
        F.split("l.line", TOKEN, -1).alias("gaps"),
        F.regexp_extract_all("l.line", F.lit(TOKEN), F.lit(0)).alias("tokens"),
    )
    placed = F.aggregate(
        F.arrays_zip(F.col("gaps").alias("gap"), F.col("tokens").alias("token")),
        F.struct(
            F.lit(0).alias("at"), F.array().cast("array<struct<at:int,token:string>>").alias("out")
        ),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.length(F.coalesce(p["token"], F.lit("")))).alias("at"),
            F.when(
                p["token"].isNotNull(),
                F.concat(
                    acc["out"],
                    F.array(F.struct((acc["at"] + F.length(p["gap"])).alias("at"), p["token"].alias("token"))),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    found = (
        rows.select("doc_id", "start", "lead", "wide", F.explode(placed).alias("p"))
        .where(~F.lower("p.token").isin(STOPWORDS))
        .select(
            "doc_id",
            F.col("p.token").alias("token"),
            (F.col("start") + F.col("p.at")).alias("pos"),
            F.substr(
                "wide",
                F.greatest(F.col("lead") + F.col("p.at") - margin, F.lit(0)) + 1,
                F.least(F.col("lead") + F.col("p.at"), F.lit(margin)) + F.length("p.token") + margin,
            ).alias("context"),
        )
    )
    counted = found.groupBy("doc_id", "token").agg(
        F.count(F.lit(1)).alias("frequency"), F.min_by("context", "pos").alias("context")
    )
    squeezed = T.strip(F.regexp_replace("context", f"{T.WS}+", " "))
    return counted.where(F.col("frequency") >= minimum).select(
        "doc_id",
        "token",
        "frequency",
        F.concat(F.lit("..."), squeezed, F.lit("...")).alias("sample_context"),
        F.col("token").rlike("^[A-Z]{2,8}$").alias("is_acronym"),
    )
