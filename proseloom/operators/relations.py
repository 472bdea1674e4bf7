"""Relationship timelines between pairs of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import ordered

# fixed values: closed vocabularies
RELATION_TYPES = [
    "family", "romantic", "friendship", "professional", "acquaintance", "mentor_student",
    "service", "allied", "stranger", "unknown",
]
RELATION_TONES = ["warm", "neutral", "tense", "competitive", "hostile", "unknown"]
STATUSES = ["current", "former", "estranged", "developing"]
POWER_DYNAMICS = ["equal", "a_over_b", "b_over_a", "unknown"]
TRANSITIONS = ["instant", "gradual"]

STATE = ["relation_type", "relation_tone", "status", "power_dynamic", "trigger"]
DEFAULTS = {
    "relation_type": "unknown",
    "relation_tone": "neutral",
    "status": "current",
    "power_dynamic": "equal",
}


def pair_id(a: Column, b: Column) -> Column:
    """Order-free identifier of two names."""

    def key(name: Column) -> Column:
        lowered = F.lower(F.coalesce(name, F.lit("")))
        return F.regexp_replace(lowered, rf"(?:{T.WS}|-)+", "_")

    return F.array_join(F.array_sort(F.array(key(a), key(b))), "_")


def with_pair_id(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.withColumn("pair_id", pair_id(F.col(a), F.col(b)))


def _name(col: Column) -> Column:
    return F.lower(T.strip(F.coalesce(col, F.lit(""))))


def _pair(df: DataFrame) -> DataFrame:
    a, b = _name(F.col("a")), _name(F.col("b"))
    return df.withColumn("__p1", F.least(a, b)).withColumn("__p2", F.greatest(a, b))


def _filled(name: str) -> Column:
    value = T.blank_to_null(F.col(name))
    return F.coalesce(value, F.lit(DEFAULTS[name])) if name in DEFAULTS else value


def _flip(power: Column, reverse: Column) -> Column:
    swapped = (
        F.when(power == "a_over_b", "b_over_a").when(power == "b_over_a", "a_over_b").otherwise(power)
    )
    return F.when(reverse, swapped).otherwise(power)


def _asof(queries: DataFrame, states: DataFrame, at: Column, since: Column, flip: bool) -> DataFrame:
    """Latest state at or before each query position; the first state before that.

    Of several states with one boundary the last to arrive counts: by ``arrival_ord``
    where the states have it, else the greatest in the order of its fields.

    States and the distinct positions asked for lie on one axis per pair, which
    is scanned in blocks, so a pair that holds most rows is still cut up.
    """
    key = ["doc_id", "__p1", "__p2"]
    arrival = (F.col("arrival_ord") if "arrival_ord" in states.columns else F.lit(0)).alias("arrival")
    known = (
        _pair(states)
        .withColumn("__since", since)
        .withColumn("__state", F.struct(F.col("a").alias("a0"), *[_filled(c).alias(c) for c in STATE]))
        .groupBy(*key, "__since")
        .agg(F.max_by("__state", F.struct(arrival, "__state")).alias("__state"))
    )
    asked = _pair(queries).withColumn("__at", at)
    axis = known.select(*key, (F.col("__since") * 2).alias("__x"), "__state").unionByName(
        asked.select(*key, (F.col("__at") * 2 + 1).alias("__x")).distinct(),
        allowMissingColumns=True,
    )
    scanned = ordered.running(
        axis, key, "__x", {"__now": ("last", F.col("__state"))}
    )
    now = scanned.where("__x % 2 = 1").select(
        *key, F.floor(F.col("__x") / 2).alias("__at"), "__now"
    )
    first = known.groupBy(*key).agg(F.min_by("__state", "__since").alias("__first"))
    out = (
        asked.join(now, [*key, "__at"], "left")
        .join(first, key, "left")
        .withColumn("__s", F.coalesce("__now", "__first"))
    )
    reverse = _name(F.col("__s.a0")) != _name(F.col("a"))
    power = F.col("__s.power_dynamic")
    return out.select(
        *queries.columns,
        F.col("__s").isNotNull().alias("has_history"),
        *[
            (_flip(power, reverse) if flip and c == "power_dynamic" else F.col(f"__s.{c}")).alias(c)
            for c in STATE
        ],
    )


def relationship_asof(pairs: DataFrame, states: DataFrame, flip: bool = True) -> DataFrame:
    """State of ``(a, b)`` at ``seg_idx``; strangers where there is no history."""
    found = _asof(
        pairs,
        states,
        F.col("seg_idx").cast("bigint"),
        F.coalesce(F.col("from_segment"), F.lit(0)).cast("bigint"),
        flip,
    )
    missing = (F.coalesce("a", F.lit("")) == "") | (F.coalesce("b", F.lit("")) == "")
    stranger = {**DEFAULTS, "relation_type": "stranger"}
    out = found.withColumn(
        "pair_id", F.when(~missing, pair_id(F.col("a"), F.col("b")))
    )
    for c in STATE:
        value = F.when(
            missing, F.lit(DEFAULTS.get(c))
        ).otherwise(F.coalesce(F.col(c), F.lit(stranger.get(c))))
        out = out.withColumn(c, value)
    return out


# Room for every 32-bit segment number below a chapter on the (chapter, segment) axis.
CHAPTER_SPAN = 1 << 31


def relationship_asof_position(positions: DataFrame, states: DataFrame) -> DataFrame:
    """State at ``(chapter, segment)``, seen from ``a``; null without history."""

    def axis(chapter: str, segment: str) -> Column:
        def one(c: str) -> Column:
            return F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1)).cast("int").cast("bigint")

        return one(chapter) * CHAPTER_SPAN + one(segment)

    return _asof(
        positions, states, axis("chapter", "segment"), axis("from_chapter", "from_segment"), True
    )


def merge_relationship_deltas(states: DataFrame, deltas: DataFrame) -> DataFrame:
    """Upsert state changes by pair and boundary; the last arrival wins."""
    usable = deltas.where((T.strip(F.col("a")) != "") & (T.strip(F.col("b")) != ""))
    cols = ["doc_id", "pair_id", "a", "b", "from_segment", *STATE]
    old = states.select(*cols, F.lit(-1).cast("bigint").alias("__ord"))
    new = usable.select(*cols, F.col("arrival_ord").cast("bigint").alias("__ord"))
    rows = old.unionByName(new).select(
        "doc_id",
        F.coalesce(T.blank_to_null(F.col("pair_id")), pair_id(F.col("a"), F.col("b"))).alias("pair_id"),
        T.strip(F.col("a")).alias("a"),
        T.strip(F.col("b")).alias("b"),
        F.coalesce("from_segment", F.lit(0)).alias("from_segment"),
        *[_filled(c).alias(c) for c in STATE],
        "__ord",
    )
    latest = rows.groupBy("doc_id", "pair_id", "from_segment").agg(
        F.max_by(F.struct(*STATE), F.col("__ord")).alias("s")
    )
    # Names as the pair was first written, over all of its states.
    names = rows.groupBy("doc_id", "pair_id").agg(
        F.min(F.struct("__ord", "from_segment", "a", "b")).alias("n")
    )
    return latest.join(names, ["doc_id", "pair_id"]).select(
        "doc_id", "pair_id", F.col("n.a").alias("a"), F.col("n.b").alias("b"), "from_segment", "s.*"
    )


def relationship_pairs_summary(active: DataFrame, states: DataFrame, at: DataFrame) -> DataFrame:
    """One line per pair of active characters that has a history at ``seg_idx``.

    Pairs without history all read the same, so they are counted
    (``unrecorded_pairs``) instead of being written out one by one.
    """
    cast = active.select("doc_id", F.col("name").alias("n"), _name(F.col("name")).alias("k"))
    pairs = _pair(states).select("doc_id", "__p1", "__p2").distinct()
    both = (
        pairs.join(cast.select("doc_id", F.col("k").alias("__p1"), F.col("n").alias("a")), ["doc_id", "__p1"])
        .join(cast.select("doc_id", F.col("k").alias("__p2"), F.col("n").alias("b")), ["doc_id", "__p2"])
        .where("__p1 <> __p2")
        .select("doc_id", "a", "b")
        .join(at.select("doc_id", "seg_idx"), "doc_id")
    )
    known = relationship_asof(both, states)
    sizes = active.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"))
    recorded = both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__r"))
    total = (F.col("__n") * (F.col("__n") - 1) / 2).cast("bigint")
    line = F.concat(
        F.lit("• "), F.col("a"), F.lit(" & "), F.col("b"), F.lit(": "), F.col("relation_type"),
        F.lit(" ("), F.col("relation_tone"), F.lit(", "), F.col("status"), F.lit(")"),
        F.coalesce(F.concat(F.lit(" [Since: "), F.col("trigger"), F.lit("]")), F.lit("")),
    )
    counts = sizes.join(recorded, "doc_id", "left").select(
        "doc_id",
        F.col("__n").alias("active_characters"),
        (total - F.coalesce("__r", F.lit(0))).alias("unrecorded_pairs"),
    )
    none = F.when(
        F.col("active_characters") < 2, F.lit("No multi-character pairs in this scene.")
    ).otherwise(F.lit("No established relationship history."))
    return counts.join(
        known.select("doc_id", "a", "b", line.alias("line")), "doc_id", "left"
    ).withColumn("line", F.coalesce("line", none))


def taxonomy_validate(df: DataFrame) -> DataFrame:
    """Types outside the vocabulary become ``unknown``, tones become null."""
    kind = F.lower(T.strip(F.coalesce("relation_type", F.lit(""))))
    tone = F.lower(T.strip(F.col("relation_tone")))
    return df.withColumn(
        "relation_type", F.when(kind.isin(RELATION_TYPES), kind).otherwise(F.lit("unknown"))
    ).withColumn("relation_tone", F.when(tone.isin(RELATION_TONES), tone))
