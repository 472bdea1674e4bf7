"""Plain-text screenplays: export, import, analytics, revisions and cache plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hashing as H
from ..functions import text as T
from . import ordered

# fixed values: line forms of the screenplay text
SCENE = rf"(?i)^(INT|EXT|INT/EXT|INT\./EXT\.|I/E)(?!{T.W})[{T.SPACE}.]"
FORCED_SCENE = r"^\.[a-zA-Z0-9]"
SECTION = rf"^(#{{1,6}}){T.WS}*(.*)$"
SYNOPSIS = rf"^={T.WS}*(.*)$"
UPPER_CUE = rf"^[A-Z0-9_\-.' ]+({T.WS}*\(.*\))?$"
TITLE_KEY = rf"^([a-zA-Z{T.SPACE}]+):{T.WS}*(.*)$"
# fixed values: reading speed and pauses of the runtime estimate
WORDS_PER_MINUTE, TURN_PAUSE, SCENE_PAUSE = 150, 0.45, 1.8

# ---------------------------------------------------------------- hashes and plans


def _or(value: Column, default: str) -> Column:
    return F.coalesce(T.blank_to_null(value), F.lit(default))


def segment_digest(speaker: Column, direction: Column, text: Column, voice: Column, profile: Column) -> Column:
    return H.short_digest(
        F.lower(F.trim(_or(speaker, "Narrator"))),
        F.lower(F.trim(_or(direction, ""))),
        F.trim(_or(text, "")),
        F.trim(_or(voice, "default")),
        F.trim(_or(profile, "standard")),
        sep="||",
    )


def segment_hash(segments: DataFrame, profile: str | None = None) -> DataFrame:
    """Digest of what a line sounds like: speaker, direction, text, voice, profile."""
    post = F.col(profile) if profile else F.lit(None).cast("string")
    return segments.withColumn(
        "hash",
        segment_digest(*[F.col(c) for c in ("speaker", "direction", "text", "voice_id")], post),
    )


def revision_diff(previous: DataFrame, current: DataFrame, cache: DataFrame) -> DataFrame:
    """Reusable, dirty, new and removed lines between two versions of a script."""
    key = ["doc_id", "seg_id"]
    old = segment_hash(previous).select(*key, F.col("hash").alias("old_hash"))
    new = segment_hash(current).select(*key, F.col("hash").alias("new_hash"), "audio_path")
    paths = cache.groupBy(F.col("hash").alias("new_hash")).agg(F.min("audio_path").alias("cached_path"))
    rows = new.join(paths, "new_hash", "left").join(old, key, "full")
    audio = F.coalesce("cached_path", T.blank_to_null(F.col("audio_path")))
    status = (
        F.when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash").isNull(), "new")
        .when((F.col("old_hash") == F.col("new_hash")) & audio.isNotNull(), "reusable")
        .otherwise("dirty")
    )
    return rows.select(
        *key, "new_hash", status.alias("status"), F.when(status == "reusable", audio).alias("audio_path")
    )


def revision_summary(diff: DataFrame) -> DataFrame:
    def n(*names: str) -> Column:
        return F.count_if(F.col("status").isin(*names))

    total, reused = n("reusable", "dirty", "new"), n("reusable")
    return diff.groupBy("doc_id").agg(
        total.alias("total_segments"),
        reused.alias("reusable"),
        n("dirty", "new").alias("rerender"),
        n("new").alias("new_added"),
        n("removed").alias("removed"),
        F.when(total > 0, F.floor(reused / total * 1000 + 0.5) / 10).otherwise(0.0).alias("savings_pct"),
    )


def take_content_hash(requests: DataFrame) -> DataFrame:
    """Digest of all parameters that change how a take sounds."""
    have = set(requests.columns)

    def low(name: str, default: str = "") -> Column:
        value = F.col(name) if name in have else F.lit(None).cast("string")
        return F.lower(F.trim(_or(value.cast("string"), default)))

    def plain(name: str, default: str = "") -> Column:
        value = F.col(name).cast("string") if name in have else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(default))

    if "phonetic_overrides" in have:
        phonetics = F.array_join(
            F.transform(
                F.array_sort(F.map_entries("phonetic_overrides")),
                lambda e: F.concat(F.lower(e["key"]), F.lit(":"), F.lower(e["value"])),
            ),
            ";",
        )
    else:
        phonetics = F.lit("")
    parts = [
        low("text"), low("speaker"), low("voice"), plain("seed", "default"), low("workflow", "inherit"),
        low("emotion", "neutral"), low("instruction"), plain("speed", "1.0"), low("pitch", "medium"),
        low("volume", "medium"), plain("intensity_band"), low("expression"), low("intent"),
        plain("pre_pause_ms"), plain("post_pause_ms"), plain("inject_breath"), plain("energy"),
        F.coalesce(phonetics, F.lit("")),
    ]
    return requests.withColumn("content_hash", H.short_digest(*parts, sep="|"))


def cache_plan(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Split requests into cache hits and work; equal requests render once.

    ``cache``: content_hash, file_path, stored_at; the newest file of a hash counts.
    """
    hashed = take_content_hash(requests)
    newest = cache.groupBy("content_hash").agg(F.max_by("file_path", "stored_at").alias("cached_file"))
    first = hashed.groupBy("content_hash").agg(F.min("request_id").alias("render_as"))
    rows = hashed.join(newest, "content_hash", "left").join(first, "content_hash")
    hit = F.col("cached_file").isNotNull()
    return rows.select(
        "request_id",
        "content_hash",
        F.when(hit, "hit").when(F.col("render_as") == F.col("request_id"), "render").otherwise("shared").alias("plan"),
        "cached_file",
        F.when(~hit, F.col("render_as")).alias("render_as"),
    )


# ---------------------------------------------------------------- export


def screenplay_export(segments: DataFrame, titles: DataFrame) -> DataFrame:
    """Screenplay text as ordered parts: joined with newlines they are the file.

    Part 0 is the title page, part ``n`` the text of the n-th segment, so a book
    of any length is written by many tasks. ``titles``: doc_id, title, author,
    source, draft_date.
    """
    have = set(segments.columns)

    def c(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    rows = segments.withColumn("__h", T.blank_to_null(c("scene_heading")))
    rows = ordered.running(rows, ["doc_id"], "seg_idx", {"__open": ("last", F.col("__h"))})
    rows = ordered.neighbours(rows, ["doc_id"], "seg_idx", prev={"__was": F.col("__open")}, cut=True)
    rows = ordered.renumber(rows, ["doc_id"], "seg_idx", "part_no", start=1, cut=True)
    heading = F.col("__h")
    opens = heading.isNotNull() & F.coalesce(heading != F.col("__was"), F.lit(True))
    kind = F.lower(_or(c("type"), "narrator"))
    spoken = kind == "dialogue"
    speaker = F.coalesce(
        T.blank_to_null(c("speaker")), F.when(spoken, F.lit("Character")).otherwise(F.lit("Narrator"))
    )
    text, direction = T.strip(F.coalesce(c("text"), F.lit(""))), T.strip(F.coalesce(c("direction"), F.lit("")))
    digest = segment_digest(speaker, direction, text, c("voice_id"), F.lit(None).cast("string"))
    meta = F.to_json(
        F.struct(
            F.coalesce(c("seg_id"), F.concat(F.lit("line_"), F.col("part_no").cast("string"))).alias("id"),
            digest.alias("hash"),
            F.round(c("confidence", "double"), 2).alias("conf"),
            c("audio_path").alias("audio"),
        )
    )
    snapshot = c("relationship_snapshot", "map<string,string>")
    slug = F.when(heading.rlike(SCENE), F.upper(heading)).otherwise(
        F.concat(F.lit("."), F.upper(heading))
    )
    name = T.strip(speaker)
    cue = F.when(name.rlike("[a-z ]"), F.concat(F.lit("@"), name)).otherwise(F.upper(name))
    aside = T.strip(F.regexp_replace(direction, r"^\(+|\)+$", ""))
    none = F.lit(None).cast("string")
    starts = c("chapter_title").isNotNull() & F.coalesce(c("is_chapter_start", "boolean"), F.lit(False))
    blank = F.lit("")
    lines = F.array(
        F.when(starts, blank), F.when(starts, F.concat(F.lit("# "), c("chapter_title"))), F.when(starts, blank),
        F.when(opens, blank), F.when(opens, slug),
        F.when(opens, F.concat(F.lit("= "), T.blank_to_null(c("scene_synopsis")))),
        F.when(
            opens & (F.size(snapshot) > 0),
            F.concat(F.lit("/* [[relationship_snapshot: "), F.to_json(snapshot), F.lit("]] */")),
        ),
        F.when(opens, blank),
        blank, F.when(spoken, cue),
        F.when(spoken & (direction != ""), F.concat(F.lit("("), aside, F.lit(")"))),
        text, F.concat(F.lit("/* [[meta: "), meta, F.lit("]] */")), blank,
    )
    body = rows.select("doc_id", "part_no", F.array_join(F.array_compact(lines), "\n").alias("text"))
    # fixed values: title page defaults
    front = titles.select(
        "doc_id",
        F.lit(0).cast("bigint").alias("part_no"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("Title: "), _or(F.col("title"), "Audiobook Screenplay")),
            F.concat(F.lit("Author: "), _or(F.col("author"), "Unknown Author")),
            F.concat(F.lit("Source: "), _or(F.col("source"), "Generated script")),
            F.concat(F.lit("Draft date: "), F.coalesce(F.col("draft_date").cast("string"), F.current_date().cast("string"))),
            blank, F.lit("=== "), blank,
        ).alias("text"),
    )
    return front.unionByName(body)


# ---------------------------------------------------------------- import


def screenplay_lines(texts: DataFrame) -> DataFrame:
    """Numbered lines of whole screenplay files."""
    return texts.select(
        "doc_id",
        F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n", -1)).alias("line_no", "line"),
    )


def screenplay_import(script_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Title fields and segments of screenplay text.

    Every line is classed by its own form and by running values over the lines
    before it (inside a comment, after the title page, paragraph number, open
    block, current chapter and scene), so the text is read without a parser loop.
    """
    doc, at = ["doc_id"], "line_no"

    def running(rows, keys, idx, aggs, cut=True):
        return ordered.running(rows, keys, idx, aggs, cut=cut)

    def before(rows, keys, **prev):
        return ordered.neighbours(rows, keys, at, prev=prev, cut=True)

    t = T.strip(F.col("line"))
    rows = script_lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), t.alias("t"))

    # Comments: a line that opens one, up to the line that closes it.
    opens = F.col("t").startswith("/*") & ~F.contains("t", F.lit("*/"))
    closes = F.contains("t", F.lit("*/"))
    rows = running(
        rows, doc, at, {"__state": ("last", F.when(closes, F.lit(0)).when(opens, F.lit(1)))}, cut=False
    )
    rows = before(rows, doc, __prev_state=F.col("__state"))
    inside = F.coalesce(F.col("__prev_state") == 1, F.lit(False))
    comment = inside | F.col("t").startswith("/*")
    rows = rows.withColumn("is_comment", comment).withColumn(
        "__first", (F.col("is_comment") & ~inside).cast("int")
    )
    rows = running(rows, doc, at, {"__comment_no": ("sum", F.col("__first"))})

    # Title page: property and blank lines before the first other line or "===".
    plain = ~F.col("is_comment") & (F.col("t") != "")
    rule = plain & ((F.col("t") == "===") | F.col("t").startswith("=== "))
    prop = plain & F.col("t").rlike(TITLE_KEY)
    ends = plain & (rule | ~prop)
    rows = running(rows, doc, at, {"__ends": ("sum", ends.cast("int"))})
    title_line = prop & (F.col("__ends") == 0)
    titles = (
        rows.where(title_line)
        .groupBy("doc_id", F.lower(T.strip(F.regexp_extract("t", TITLE_KEY, 1))).alias("key"))
        .agg(F.max_by(T.strip(F.regexp_extract("t", TITLE_KEY, 2)), F.col("line_no")).alias("value"))
    )
    page_rule = rule & (F.col("__ends") == 1)
    body = rows.where(F.col("is_comment") | (~title_line & ~page_rule)).drop("__state", "__prev_state", "__ends")

    # Paragraphs: runs of lines without a blank one between them.
    blank = ~F.col("is_comment") & (F.col("t") == "")
    body = running(body, doc, at, {"para": ("sum", blank.cast("int"))}).where(
        F.col("is_comment") | (F.col("t") != "")
    )
    scene = F.col("t").rlike(SCENE) | F.col("t").rlike(FORCED_SCENE)
    section = F.col("t").rlike(SECTION) & ~scene
    forced = F.col("t").rlike("^@.+")
    upper = F.col("t").rlike(UPPER_CUE) & (F.length("t") < 50) & ~F.col("t").endswith(".") & ~scene & ~section
    synopsis = F.col("t").rlike(SYNOPSIS)
    form = (
        F.when(F.col("is_comment"), "comment")
        .when(section, "section")
        .when(scene, "scene")
        .when(forced, "cue")
        .when(synopsis, "synopsis")
        .when(upper, "upper")
        .otherwise("plain")
    )
    body = body.withColumn("form", form)
    in_para = ["doc_id", "para"]
    setting = F.when(F.col("form").isin("section", "scene"), F.lit("top")).when(
        F.col("form") == "plain", F.lit("narration")
    )
    body = running(body, in_para, at, {"__now": ("last", setting)})
    body = before(body, in_para, __before=F.col("__now"), __prev_no=F.col("line_no"))
    free = F.coalesce(F.col("__before") != "narration", F.lit(True))
    is_cue = (F.col("form") == "cue") | ((F.col("form") == "upper") & free)
    first_cue = (
        body.where(is_cue)
        .groupBy(*in_para)
        .agg(F.min(F.struct("line_no", F.col("t").alias("cue"))).alias("c"))
        .select(*in_para, F.col("c.line_no").alias("cue_no"), F.col("c.cue").alias("cue"))
    )
    body = body.join(first_cue, in_para, "left")
    in_dialogue = F.coalesce(F.col("line_no") > F.col("cue_no"), F.lit(False))
    follows_cue = F.coalesce(F.col("__prev_no") == F.col("cue_no"), F.lit(False))
    aside = in_dialogue & follows_cue & F.col("t").rlike(r"^\(.*\)$")
    spoken = in_dialogue & (F.col("form") != "comment") & ~aside
    told = (
        ~in_dialogue
        & ~F.coalesce(F.col("line_no") == F.col("cue_no"), F.lit(False))
        & ((F.col("form") == "plain") | (F.col("form").isin("synopsis", "upper") & ~free))
    )
    body = body.withColumn("content", F.when(spoken, "dialogue").when(told, "narrator")).withColumn(
        "aside", F.when(aside, F.regexp_extract("t", r"^\((.*)\)$", 1))
    ).withColumn("free", free).withColumn("in_dialogue", in_dialogue)

    # Segment numbers: a segment opens at its first line of content.
    solid = body.where("form <> 'comment'")
    solid = before(solid, in_para, __c=F.col("content"))
    begin = (F.col("content") == "narrator") & F.col("free") | (
        (F.col("content") == "dialogue") & F.coalesce(F.col("__c") != "dialogue", F.lit(True))
    )
    solid = solid.withColumn("begins", F.coalesce(begin, F.lit(False))).drop("__c")
    comments = body.where("form = 'comment'").withColumn("begins", F.lit(False))
    body = running(
        solid.unionByName(comments),
        doc,
        at,
        {
            "seg_no": ("sum", F.col("begins").cast("int")),
            "chapter_title": ("last", F.when((F.col("form") == "section") & ~F.col("in_dialogue"), T.strip(F.regexp_extract("t", SECTION, 2)))),
            "scene_heading": ("last", F.when((F.col("form") == "scene") & ~F.col("in_dialogue"), T.strip(F.regexp_replace("t", r"^\.", "")))),
            "__syn": (
                "last",
                F.when(~F.col("in_dialogue") & (F.col("form") == "scene"), F.struct(F.lit(None).cast("string").alias("v")))
                .when(~F.col("in_dialogue") & (F.col("form") == "synopsis") & F.col("free"), F.struct(T.strip(F.regexp_extract("t", SYNOPSIS, 1)).alias("v"))),
            ),
        },
    )
    # Whether the last solid line of the paragraph belongs to an open block.
    body = running(
        body,
        in_para,
        at,
        {"__open": ("last", F.when(F.col("form") != "comment", F.col("content").isNotNull()))},
    )

    # A comment belongs to the block it stands in, or else to the next one.
    notes = (
        body.where("form = 'comment'")
        .withColumn(
            "owner",
            F.col("seg_no") + F.when(F.coalesce("__open", F.lit(False)), 0).otherwise(1),
        )
        .groupBy("doc_id", "__comment_no")
        .agg(
            F.min("owner").alias("owner"),
            F.min("line_no").alias("line_no"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " "
            ).alias("payload"),
        )
    )
    meta_json = F.regexp_extract("payload", r"\[\[(?:meta|segment_meta):\s*(\{.*\})\]\]", 1)
    snap_json = F.regexp_extract("payload", r"\[\[relationship_snapshot:\s*(\{.*\})\]\]", 1)
    meta_type = "struct<id:string,hash:string,conf:double,audio:string,direction:string>"
    notes = notes.withColumn("meta", F.from_json(T.blank_to_null(meta_json), meta_type)).withColumn(
        "snapshot",
        F.when(meta_json == "", F.from_json(T.blank_to_null(snap_json), "map<string,string>")),
    )
    meta = (
        notes.where("meta IS NOT NULL")
        .groupBy("doc_id", F.col("owner").alias("seg_no"))
        .agg(F.max_by("meta", "line_no").alias("meta"))
    )
    # Snapshots hold until the next scene heading.
    marks = (
        notes.where("snapshot IS NOT NULL")
        .select("doc_id", "line_no", F.struct("snapshot").alias("s"))
        .unionByName(
            body.where("form = 'scene' AND NOT in_dialogue").select(
                "doc_id",
                "line_no",
                F.struct(F.lit(None).cast("map<string,string>").alias("snapshot")).alias("s"),
            )
        )
    )
    blocks = body.where("content IS NOT NULL")
    grouped = blocks.groupBy("doc_id", "seg_no").agg(
        F.min("content").alias("type"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " "
        ).alias("text"),
        F.first("cue").alias("cue"),
        F.min("para").alias("para"),
        F.min_by("chapter_title", "line_no").alias("chapter_title"),
        F.min_by("scene_heading", "line_no").alias("scene_heading"),
        F.min_by("__syn", "line_no")["v"].alias("scene_synopsis"),
        F.max("line_no").alias("line_no"),
    )
    asides = body.where("aside IS NOT NULL").groupBy(*in_para).agg(F.min("aside").alias("aside"))
    # A snapshot written inside a block is already in force for it.
    late = notes.where("snapshot IS NOT NULL").groupBy("doc_id", F.col("owner").alias("seg_no")).agg(
        F.max("line_no").alias("__late")
    )
    grouped = grouped.join(late, ["doc_id", "seg_no"], "left").withColumn(
        "line_no", F.greatest("line_no", F.coalesce("__late", F.lit(-1)))
    ).drop("__late")
    axis = grouped.withColumn("x", F.col("line_no") * 2 + 1).unionByName(
        marks.select("doc_id", (F.col("line_no") * 2).alias("x"), "s"), allowMissingColumns=True
    )
    axis = running(axis, doc, "x", {"__snap": ("last", F.col("s"))}).where("seg_no IS NOT NULL")
    rows = axis.join(meta, ["doc_id", "seg_no"], "left").join(asides, in_para, "left")
    spoken = F.col("type") == "dialogue"
    by_cue = F.when(
        F.col("cue").startswith("@"), T.strip(F.substring("cue", 2, 1 << 30))
    ).otherwise(T.strip(F.regexp_replace("cue", rf"{T.WS}*\(.*\)$", "")))
    segments = rows.select(
        "doc_id",
        (F.col("seg_no") - 1).cast("int").alias("seg_idx"),
        F.coalesce(F.col("meta.id"), F.concat(F.lit("seg_"), F.col("seg_no").cast("string"))).alias("seg_id"),
        "type",
        F.when(spoken, by_cue).otherwise(F.lit("Narrator")).alias("speaker"),
        "text",
        F.when(
            spoken,
            F.coalesce(T.blank_to_null(T.strip(F.col("aside"))), F.col("meta.direction"), F.lit("expressive dialogue")),
        )
        .otherwise(F.lit("calm, steady narration"))
        .alias("direction"),
        "chapter_title",
        "scene_heading",
        "scene_synopsis",
        F.col("meta.hash").alias("hash"),
        F.when(spoken, F.col("meta.conf")).alias("confidence"),
        F.col("meta.audio").alias("audio_path"),
        F.when(spoken, F.col("__snap.snapshot")).alias("relationship_snapshot"),
    )
    return titles, segments


# ---------------------------------------------------------------- analytics


def _spoken() -> Column:
    return F.lower(F.coalesce("type", F.lit(""))) == "dialogue"


def _speaker() -> Column:
    default = F.when(_spoken(), F.lit("Character")).otherwise(F.lit("Narrator"))
    return F.coalesce(T.blank_to_null(F.col("speaker")), default)


def human_time(seconds: Column) -> Column:
    """Whole minutes and two-digit seconds, as in ``3m 07s``."""
    whole = F.greatest(F.floor(seconds + 0.5), F.lit(0))
    return F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60)


def script_summary(segments: DataFrame) -> DataFrame:
    """Counts and estimated runtime of each script."""
    w = T.words(F.col("text"))
    lines = segments.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.sum(w).alias("total_words"),
        F.count_if(_spoken()).alias("dialogue_lines"),
        F.count_if(~_spoken()).alias("narrator_lines"),
        F.sum(F.when(_spoken(), w).otherwise(0)).alias("__dw"),
    )
    people = (
        segments.where(_spoken())
        .groupBy("doc_id", _speaker().alias("s"))
        .agg(F.lit(1).alias("one"))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("unique_characters"))
    )
    scenes = (
        segments.where("scene_heading <> ''")
        .select("doc_id", "scene_heading")
        .distinct()
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("total_scenes"),
            F.count_if(F.col("scene_heading").rlike(rf"(?i)^INT(?!{T.W})")).alias("interior_scenes"),
            F.count_if(F.col("scene_heading").rlike(rf"(?i)^EXT(?!{T.W})")).alias("exterior_scenes"),
        )
    )
    rows = lines.join(people, "doc_id", "left").join(scenes, "doc_id", "left").na.fill(0)
    spoken = F.col("__dw") / WORDS_PER_MINUTE * 60
    told = (F.col("total_words") - F.col("__dw")) / WORDS_PER_MINUTE * 60
    total = spoken + told + F.col("dialogue_lines") * TURN_PAUSE + F.col("total_scenes") * SCENE_PAUSE
    rows = rows.withColumn("runtime_seconds", F.floor(total + 0.5))
    return rows.withColumn("runtime", human_time(F.col("runtime_seconds"))).drop("__dw")


def character_breakdown(segments: DataFrame, cast: DataFrame) -> DataFrame:
    """Lines, words, share, confidence and casting tier of each speaker.

    Confidences are added in line order, block by block: a mean between two hundredths
    is rounded by its last bit, which follows the order of the sum.
    """

    def added(values: Column) -> Column:
        ordered_ = F.transform(F.array_sort(values), lambda x: x["v"])
        return F.aggregate(ordered_, F.lit(0.0), lambda total, v: total + v)

    def listed(at: Column, value: Column) -> Column:
        return F.collect_list(F.when(value.isNotNull(), F.struct(at.alias("at"), value.cast("double").alias("v"))))

    spoken = segments.where(_spoken())
    block = F.floor(F.col("seg_idx") / F.lit(ordered.BLOCK_ROWS))
    parts = spoken.groupBy("doc_id", _speaker().alias("speaker"), block.alias("__blk")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(T.words(F.col("text"))).alias("__words"),
        F.count("confidence").alias("__rated"),
        added(listed(F.col("seg_idx"), F.col("confidence"))).alias("__sum"),
    )
    stats = parts.groupBy("doc_id", "speaker").agg(
        F.sum("__n").alias("line_count"),
        F.sum("__words").alias("word_count"),
        F.try_divide(added(listed(F.col("__blk"), F.col("__sum"))), F.sum("__rated")).alias("__conf"),
    )
    totals = stats.groupBy("doc_id").agg(F.sum("line_count").alias("__total"))
    voices = cast.groupBy("doc_id", F.col("name").alias("speaker")).agg(
        F.first("voice_id", ignorenulls=True).alias("assigned_voice_id")
    )
    rows = stats.join(totals, "doc_id").join(voices, ["doc_id", "speaker"], "left")
    share = F.floor(F.col("line_count") / F.col("__total") * 1000 + 0.5) / 10
    # fixed values: casting tiers by share of dialogue lines
    tier = (
        F.when(share >= 20, "Lead / Primary Cast (Dedicated Cloned Voice)")
        .when(share >= 5, "Supporting Cast (High-Quality Character Voice)")
        .when(F.col("line_count") <= 2, "One-Off / Cameo (Candidate for Attribution Sanity Audit)")
        .otherwise("Incidental / Minor")
    )
    return rows.select(
        "doc_id",
        "speaker",
        "line_count",
        "word_count",
        share.alias("dialogue_line_pct"),
        F.coalesce(F.floor(F.col("__conf") * 100 + 0.5) / 100, F.lit(1.0)).alias("average_confidence"),
        F.col("assigned_voice_id").isNotNull().alias("has_assigned_voice"),
        "assigned_voice_id",
        tier.alias("casting_tier"),
    )


def sanity_flags(breakdown: DataFrame) -> DataFrame:
    """Speakers with very few lines or low mean confidence."""

    def flag(kind: str, severity: str, *message: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("flag"), F.lit(severity).alias("severity"), F.concat(*message).alias("message")
        )

    name = F.col("speaker")
    few = flag(
        "SUSPICIOUS_LOW_LINE_COUNT", "low",
        F.lit('Character "'), name, F.lit('" has only '), F.col("line_count").cast("string"),
        F.lit(" dialogue line(s). Check if this is an attribution alias mistake."),
    )
    doubtful = flag(
        "LOW_CONFIDENCE_ATTRIBUTION", "medium",
        F.lit('Attribution confidence for "'), name, F.lit('" averages '),
        F.col("average_confidence").cast("string"), F.lit(". Verification recommended."),
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("line_count") <= 2, few),
            F.when(F.col("average_confidence") < 0.70, doubtful),
        )
    )
    return breakdown.select("doc_id", "speaker", F.explode(flags).alias("f")).select(
        "doc_id", "speaker", "f.*"
    )


def scene_cards(segments: DataFrame) -> DataFrame:
    """One card per run of rows under one heading; a heading met again is a new card."""
    rows = segments.withColumn("scene_heading", _or(F.col("scene_heading"), "SCENE 1 (DEFAULT)"))
    rows = ordered.neighbours(
        rows, ["doc_id"], "seg_idx", prev={"__was": F.col("scene_heading")}
    )
    opens = F.coalesce(F.col("scene_heading") != F.col("__was"), F.lit(True))
    rows = ordered.running(
        rows, ["doc_id"], "seg_idx", {"scene_number": ("sum", opens.cast("int"))}, cut=True
    )
    have = set(segments.columns)
    card = ["doc_id", "scene_number"]

    def opening(name: str, default: str) -> Column:
        if name not in have:
            return F.lit(default)
        return _or(F.min_by(name, "seg_idx"), default)

    words = T.words(F.col("text"))
    cards = rows.groupBy(*card).agg(
        F.first("scene_heading").alias("scene_heading"),
        opening("chapter_title", "Chapter").alias("chapter_title"),
        opening("scene_synopsis", "No synopsis recorded.").alias("synopsis"),
        F.array_sort(F.collect_set(F.when(_spoken(), T.blank_to_null(F.col("speaker"))))).alias("characters_present"),
        F.count_if(_spoken()).alias("dialogue_lines"),
        F.count_if(~_spoken()).alias("narrator_lines"),
        F.sum(words).alias("word_count"),
        F.min_by("seg_id", "seg_idx").alias("start_segment_id"),
        F.max_by("seg_id", "seg_idx").alias("end_segment_id"),
    )
    runtime = F.col("word_count") / WORDS_PER_MINUTE * 60 + F.col("dialogue_lines") * TURN_PAUSE
    cards = cards.withColumn("runtime_seconds", F.floor(runtime + 0.5))
    cards = cards.withColumn("runtime", human_time(F.col("runtime_seconds")))
    if "relationship_snapshot" in have:
        snapshots = (
            rows.select(*card, "seg_idx", F.explode("relationship_snapshot").alias("k", "v"))
            .groupBy(*card, "k")
            .agg(F.max_by("v", "seg_idx").alias("v"))
            .groupBy(*card)
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("relationship_snapshot"))
        )
        cards = cards.join(snapshots, card, "left")
    return cards
