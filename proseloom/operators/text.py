"""Cleaning, splitting and segmentation of manuscripts and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from . import ordered
from .ordered import cut_lineage

WSI = T.WS_INLINE

# ---------------------------------------------------------------- cleaning


def sanitize_text(df: DataFrame, col: str = "text", fix_soft: bool = True, british: bool = False):
    return df.withColumn(col, T.clean(F.col(col), fix_soft=fix_soft, british=british))


def normalize_british_quotes(df: DataFrame, col: str = "text", auto: bool = False) -> DataFrame:
    rewrite = T.british_quotes_if_needed if auto else T.british_quotes
    return df.withColumn(col, rewrite(F.col(col)))


def unwrap_lines(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, T.unwrap(F.col(col)))


def word_char_counts(df: DataFrame, col: str = "text") -> DataFrame:
    counted = df.withColumn("word_count", T.words(F.col(col)))
    return counted.withColumn("character_count", F.length(col).cast("bigint")).withColumn(
        "estimated_minutes", T.minutes(F.col("word_count"))
    )


def book_totals(chapters: DataFrame) -> DataFrame:
    totals = chapters.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chapters"),
        F.sum("word_count").alias("word_count"),
        F.sum("character_count").alias("character_count"),
    )
    return totals.withColumn("estimated_minutes", T.minutes(F.col("word_count")))


# ---------------------------------------------------------------- chapters

ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
# fixed values: the forms of a heading
# A heading is a whole line. A free word after "Part" only counts as a number
# ("Part Two") when nothing or a colon follows it, so "Part of the reason" is prose.
HEADING = (
    rf"(?m)^(?:#{{1,3}}{WSI}*)?(?:CHAPTER|Chapter|ACT|Act|PART|Part){WSI}+"
    rf"([0-9]+|[IVXLCDM]+(?![A-Za-z])|[A-Za-z]+(?={WSI}*(?::|$)))"
    rf"(?::?{WSI}*([^\n\r]*))?$"
)
# fixed values: the forms of a heading that stands on a line of its own
KINDS = "chapter|act|part|prologue|epilogue|scene|book"
LINE_HEADING = (
    rf"(?im)^{WSI}*+(?=(?:#++{WSI}*+)?(?:{KINDS}))(?=[^\n]{{1,79}}?{WSI}*$)(?:#+{WSI}*)?"
    rf"({KINDS})(?!{T.W})"
    rf"(?:{WSI}+([0-9ivxlcdm]+|[a-z]+))?(?:{WSI}*[:\-—]{WSI}*([^\n]*?))?{WSI}*$"
)


def roman_value(numeral: Column) -> Column:
    """Value of a Roman numeral: a digit counts negative before a larger one."""
    values = F.transform(
        F.split(numeral, ""),
        lambda c: F.coalesce(
            F.try_element_at(
                F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv]), c
            ),
            F.lit(0),
        ),
    )
    folded = F.aggregate(
        F.reverse(F.filter(values, lambda v: v > 0)),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("right")),
        lambda acc, v: F.struct(
            F.when(v < acc["right"], acc["total"] - v).otherwise(acc["total"] + v).alias("total"),
            F.greatest(v, acc["right"]).alias("right"),
        ),
        lambda acc: acc["total"],
    )
    return folded


def split_chapters(manuscripts: DataFrame, min_prologue: int = 50) -> DataFrame:
    """One row per chapter. The split happens inside the row: no shuffle."""
    cut = manuscripts.select(
        "doc_id", T.strip(F.col("text")).alias("text")
    ).select(
        "doc_id",
        F.split("text", HEADING, -1).alias("bodies"),
        F.regexp_extract_all("text", F.lit(HEADING), F.lit(0)).alias("heads"),
    )
    cut = cut.withColumn("marks", F.transform("heads", lambda h: F.regexp_extract(h, HEADING, 1)))

    def number(mark: Column, position: Column) -> Column:
        return (
            F.when(mark.rlike("^[0-9]+$"), mark.try_cast("int"))
            .when(mark.rlike("^[IVXLCDM]+$"), roman_value(mark))
            .otherwise(position + 1)
        )

    numbered = cut.withColumn("numbers", F.transform("marks", number))
    single = F.size("heads") == 0
    front = T.strip(F.element_at("bodies", 1))
    opening = F.array(
        F.struct(
            F.when(single, F.lit("chapter_01")).otherwise(F.lit("chapter_00")).alias("chapter_id"),
            F.when(single, F.lit(1)).otherwise(F.lit(0)).alias("chapter_number"),
            F.when(single, F.lit("Chapter 1")).otherwise(F.lit("Prologue")).alias("chapter_title"),
            front.alias("raw_text"),
        )
    )

    def chapter(head: Column, i: Column) -> Column:
        n = F.element_at("numbers", i + 1)
        seen = F.size(F.filter(F.slice("numbers", F.lit(1), i), lambda x: x == n))
        plain = F.concat(F.lit("chapter_"), F.lpad(n.cast("string"), 2, "0"))
        wide = F.concat(F.lit("chapter_"), n.cast("string"))
        base = F.when(n < 100, plain).otherwise(wide)
        return F.struct(
            F.when(seen > 0, F.concat(base, F.lit("_"), (seen + 1).cast("string")))
            .otherwise(base)
            .alias("chapter_id"),
            n.alias("chapter_number"),
            T.strip(F.regexp_replace(head, r"^[#\s]+", "")).alias("chapter_title"),
            T.strip(F.element_at("bodies", i + 2)).alias("raw_text"),
        )

    kept_opening = F.when(single | (F.length(front) > min_prologue), opening).otherwise(
        F.filter(opening, lambda _: F.lit(False))
    )
    rows = numbered.select(
        "doc_id",
        F.posexplode(F.concat(kept_opening, F.transform("heads", chapter))).alias("chapter_pos", "c"),
    )
    return word_char_counts(
        rows.select("doc_id", "chapter_pos", "c.*"), "raw_text"
    )


def detect_chapters_by_line(manuscripts: DataFrame, keep_prologue: bool = False) -> DataFrame:
    """Chapters by heading lines, also prologue, epilogue, scene and book."""
    cut = manuscripts.select(
        "doc_id",
        "text",
        F.split("text", LINE_HEADING, -1).alias("bodies"),
        F.regexp_extract_all("text", F.lit(LINE_HEADING), F.lit(0)).alias("heads"),
    )

    def row(head: Column, i: Column) -> Column:
        def at(group: int) -> Column:
            return T.blank_to_null(F.regexp_extract(head, LINE_HEADING, group))

        return F.struct(
            F.concat_ws(
                " ",
                F.initcap(at(1)),
                at(2),
                F.concat(F.lit("— "), at(3)),
            ).alias("title"),
            T.strip(head).alias("heading_line"),
            T.strip(F.element_at("bodies", i + 2)).alias("text"),
        )

    def whole(title: str, heading: str, body: Column) -> Column:
        return F.array(
            F.struct(
                F.lit(title).alias("title"), F.lit(heading).alias("heading_line"), body.alias("text")
            )
        )

    found = F.transform("heads", row)
    if keep_prologue:
        front = T.strip(F.element_at("bodies", 1))
        found = F.when(
            front != "", F.concat(whole("Prologue", "Prologue", front), found)
        ).otherwise(found)
    everything = whole("Chapter 1 (Full Manuscript)", "Chapter 1", T.strip(F.col("text")))
    rows = (
        cut.withColumn("none", F.size("heads") == 0)
        .withColumn("rows", F.when(F.col("none"), everything).otherwise(found))
        .select("doc_id", F.posexplode("rows").alias("pos", "c"))
        .where(F.col("c.text").isNotNull())
        .where((F.col("c.title") != "Chapter 1 (Full Manuscript)") | (F.col("c.text") != ""))
    )
    return rows.select(
        "doc_id",
        (F.col("pos") + 1).alias("index"),
        "c.title",
        "c.heading_line",
        "c.text",
        T.words(F.col("c.text")).alias("word_count"),
    )


# ---------------------------------------------------------------- paragraphs and scenes

# fixed values: the lines that end a scene
SCENE_BREAK = (
    rf"(?i)^{T.WS}*(\*{T.WS}*\*{T.WS}*\*|\*{{3,}}|-{{3,}}|#{{1,3}}{T.WS}[^\n]*|"
    rf"chapter{T.WS}+{T.W}+[^\n]*){T.WS}*\z"
)


def split_paragraphs(manuscripts: DataFrame) -> DataFrame:
    return manuscripts.select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para_idx", "text")
    )


def assign_scenes(paragraphs: DataFrame) -> DataFrame:
    """Number the scenes of each book; break lines leave the table."""
    flagged = paragraphs.withColumn("__break", F.col("text").rlike(SCENE_BREAK))
    near = ordered.neighbours(
        flagged, ["doc_id"], "para_idx", prev={"__before": F.col("__break")}
    )
    opens = ~F.col("__break") & F.coalesce(F.col("__before"), F.lit(True))
    numbered = ordered.running(
        near,
        ["doc_id"],
        "para_idx",
        {"__scene": ("sum", opens.cast("int"))},
        cut=True,
    )
    return (
        numbered.where(~F.col("__break"))
        .withColumn("scene_id", (F.col("__scene") - 1).cast("int"))
        .drop("__break", "__before", "__scene")
    )


def split_paragraphs_scenes(manuscripts: DataFrame) -> DataFrame:
    return assign_scenes(split_paragraphs(manuscripts))


# ---------------------------------------------------------------- sentences and spans


def sentence_split(manuscripts: DataFrame) -> DataFrame:
    """All-narrator segments, one per sentence. Runs inside the row."""
    boundary = rf"(?:(?<=[.?!])|(?<=[.?!][\"'])){T.WS}+(?=[A-Z0-9\"'])"
    sentences = F.flatten(
        F.transform(
            F.split(T.unwrap(F.col("text")), "\n+", -1),
            lambda p: F.transform(F.split(T.strip(p), boundary, -1), T.strip),
        )
    )
    return manuscripts.select(
        "doc_id",
        F.posexplode(F.filter(sentences, lambda s: s != "")).alias("seg_idx", "text"),
    ).select(
        "doc_id",
        "seg_idx",
        F.lit("narrator").alias("type"),
        F.lit("Narrator").alias("speaker"),
        "text",
        F.lit("informative and technical narrator, steady pace").alias("direction"),
    )


QUOTED = '"[^"]+"'


def segment_quoted(paragraphs: DataFrame, context: int = 120) -> DataFrame:
    """Narrator and dialogue pieces of each paragraph in reading order."""
    trimmed = paragraphs.withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    cut = trimmed.withColumn("__n", F.split("text", QUOTED, -1)).withColumn(
        "__q", F.regexp_extract_all("text", F.lit(QUOTED), F.lit(0))
    )
    # Reading order: narration 0, quote 0, narration 1, quote 1, ..., narration n.
    pieces = F.flatten(
        F.transform(
            F.col("__n"),
            lambda body, i: F.array(
                F.struct(F.lit("narrator").alias("type"), body.alias("raw")),
                F.struct(
                    F.lit("dialogue").alias("type"),
                    F.coalesce(F.get("__q", i), F.lit("")).alias("raw"),
                ),
            ),
        )
    )
    placed = F.aggregate(
        pieces,
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<type:string,raw:string,start:int>>").alias("out"),
        ),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["raw"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct(p["type"].alias("type"), p["raw"].alias("raw"), acc["at"].alias("start"))),
            ).alias("out"),
        ),
        lambda acc: F.filter(acc["out"], lambda p: T.strip(p["raw"]) != ""),
    )
    rows = cut.select(
        "doc_id", "para_idx", F.col("text").alias("__para"), F.posexplode(placed).alias("piece_idx", "p")
    )
    spoken = F.col("p.type") == "dialogue"
    stop = F.col("p.start") + F.length("p.raw")
    left = T.from_offset(
        F.col("__para"), F.col("p.start") - context, F.least(F.col("p.start"), F.lit(context))
    )
    right = T.from_offset(F.col("__para"), stop, F.lit(context))
    inner = F.substr(F.col("p.raw"), F.lit(2), F.greatest(F.length("p.raw") - 2, F.lit(0)))
    return rows.select(
        "doc_id",
        "para_idx",
        "piece_idx",
        F.col("p.type").alias("type"),
        F.when(spoken, F.lit("Character")).otherwise(F.lit("Narrator")).alias("speaker"),
        F.when(spoken, T.strip(inner)).otherwise(T.strip(F.col("p.raw"))).alias("text"),
        F.col("p.start").alias("start"),
        F.when(spoken, T.strip(left)).alias("preceding_context"),
        F.when(spoken, T.strip(right)).alias("following_context"),
    )


# fixed values: verbs, pronoun subjects and openers of unquoted speech
UNMARKED_VERBS = (
    "said|asked|replied|whispered|muttered|cried|shouted|yelled|breathed|growled|murmured|"
    "gasped|snapped|called|demanded|told|answered"
)
UNMARKED_SUBJECTS = (
    "he|she|they|the boy|the man|the girl|the woman|the doctor|the soldier|the kid|"
    "one of them|someone"
)
OPENERS = (
    "where|what|why|who|how|when|are you|is it|can we|will we|do you|don't|did you|look|listen|"
    "come on|hurry|wait|yes|no|yeah|nah|hell|god|oh|please"
)
_TAG = (
    f"(?:{UNMARKED_SUBJECTS}){T.WS}+(?:{UNMARKED_VERBS})|"
    f"(?:{UNMARKED_VERBS}){T.WS}+(?:{UNMARKED_SUBJECTS})"
)
SUFFIX_TAG = rf"(?i)^(.+?)(?:,|{T.WS}+)?{T.WS}+({_TAG})([.?!]?.*)$"
PREFIX_TAG = rf"(?i)^({_TAG})(?:,|:)?{T.WS}+(.+)$"
OPENER = rf"(?i)^(?:{OPENERS})(?!{T.W})"


def segment_unmarked(paragraphs: DataFrame) -> DataFrame:
    """Dialogue without quotation marks; adjacent narrator sentences merge."""

    def piece(kind: str, text: Column, glue: bool) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), text.alias("text"), F.lit(glue).alias("glue")
        )

    def classify(s: Column) -> Column:
        spoken = F.regexp_replace(T.strip(F.regexp_extract(s, SUFFIX_TAG, 1)), rf",{T.WS}*$", "")
        tail = T.strip(
            F.concat(F.regexp_extract(s, SUFFIX_TAG, 2), F.regexp_extract(s, SUFFIX_TAG, 3))
        )
        tag = T.strip(F.regexp_extract(s, PREFIX_TAG, 1))
        after = T.strip(F.regexp_extract(s, PREFIX_TAG, 2))
        return (
            F.when(
                s.rlike(SUFFIX_TAG),
                F.array(piece("dialogue", spoken, False), piece("narrator", tail, False)),
            )
            .when(
                s.rlike(PREFIX_TAG),
                F.array(piece("narrator", tag, True), piece("dialogue", after, False)),
            )
            .when(s.endswith("?") | s.rlike(OPENER), F.array(piece("dialogue", s, False)))
            .otherwise(F.array(piece("narrator", s, True)))
        )

    sentences = F.filter(
        F.transform(F.split("text", rf"(?<=[.?!]){T.WS}+", -1), T.strip), lambda s: s != ""
    )
    raw = F.filter(F.flatten(F.transform(sentences, classify)), lambda p: p["text"] != "")

    def join(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        sticks = p["glue"] & F.coalesce(last["type"] == "narrator", F.lit(False))
        fresh = F.struct(p["type"].alias("type"), p["text"].alias("text"))
        merged = F.struct(
            F.lit("narrator").alias("type"), F.concat_ws(" ", last["text"], p["text"]).alias("text")
        )
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(sticks, F.concat(head, F.array(merged))).otherwise(
            F.concat(acc, F.array(fresh))
        )

    spans = F.aggregate(raw, F.array().cast("array<struct<type:string,text:string>>"), join)
    return paragraphs.select(
        "doc_id", "para_idx", F.posexplode(spans).alias("piece_idx", "p")
    ).select("doc_id", "para_idx", "piece_idx", "p.type", "p.text")


# ---------------------------------------------------------------- windows and chunks

def _window_ends(points: DataFrame, max_words: int, overlap: int, block_words: int) -> DataFrame:
    """``doc_id, lo, hi, next``: where the window from each sentence on ends and where the next one begins.

    ``points``: doc_id, i, b (words before sentence ``i``), with a last row for the end of
    each text. Both ends are range lookups in ``b``. A text is cut into blocks of
    ``block_words`` words, and the points near a border belong to both blocks.
    """
    # No window reaches beyond the next block.
    block_words = max(block_words, max_words + 1, overlap + 1)
    blk, size = F.floor(F.col("b") / block_words), F.lit(block_words)
    around = F.array_distinct(F.array_compact(F.array(
        blk, F.when((blk > 0) & (F.col("b") - blk * size <= max_words), blk - 1), F.when((blk + 1) * size - F.col("b") <= max_words, blk + 1)
    )))
    placed = points.select("*", blk.alias("own"), F.explode(around).alias("blk"))
    order = W.partitionBy("doc_id", "blk").orderBy("b")
    ahead = F.max("i").over(order.rangeBetween(0, max_words))
    behind = F.max("i").over(order.rangeBetween(W.unboundedPreceding, -max(overlap, 1)))
    found = placed.select("doc_id", "i", "own", "blk", F.greatest(F.col("i") + 1, ahead).alias("hi"), behind.alias("back"))
    found = cut_lineage(found.where("own = blk").drop("own", "blk"))
    # The shared part is counted back from the end of the window.
    shared = found.select("doc_id", F.col("i").alias("hi"), F.col("back").alias("shared"))
    begin = F.greatest(F.coalesce("shared", F.lit(-1)), F.col("i") + 1) if overlap > 0 else F.col("hi")
    last = found.groupBy("doc_id").agg(F.max("i").alias("n"))
    # The row of the end itself has no window.
    rows = found.drop("back").join(last, "doc_id").where("i < n").join(shared, ["doc_id", "hi"], "left")
    return rows.select("doc_id", F.col("i").alias("lo"), "hi", F.when(F.col("hi") < F.col("n"), begin).alias("next"))


def overlap_windows(
    manuscripts: DataFrame, max_words: int = 1500, overlap: int = 150, block_words: int = 1 << 20
) -> DataFrame:
    """Sentence-aligned windows with overlap; a text that fits stays whole.

    Sentences keep the white space after them, so they cover the text without a
    gap. Texts without sentence ends are cut at lines. Each sentence knows where a window
    that begins with it ends and where the next one would begin; the windows of a text are those
    that its first sentence leads to. They are found by doubling these pointers, so a text of
    many windows takes a few joins.
    """
    mark = "\ue000"
    text = F.coalesce("text", F.lit(""))
    size = T.words(text)
    whole = manuscripts.where(size <= max_words).select(
        "doc_id", F.lit(0).alias("window_idx"), text.alias("text"), size.alias("word_count")
    )
    ends = F.when(
        F.col("text").rlike(rf"[.!?](?:{T.WS}|\z)"),
        F.regexp_replace("text", rf"([.!?]{T.WS}+)", f"$1{mark}"),
    ).otherwise(F.regexp_replace("text", r"(\n+)", f"$1{mark}"))
    sentences = manuscripts.where(size > max_words).select(
        "doc_id", F.posexplode(F.filter(F.split(ends, mark, -1), lambda s: s != "")).alias("i", "s")
    )
    sentences = cut_lineage(sentences.withColumns({"i": F.col("i").cast("bigint"), "w": T.words(F.col("s"))}))
    summed = ordered.running(sentences.select("doc_id", "i", "w"), ["doc_id"], "i", {"c": ("sum", F.col("w"))})
    points = summed.select("doc_id", "i", (F.col("c") - F.col("w")).alias("b"))
    points = points.unionByName(summed.groupBy("doc_id").agg((F.max("i") + 1).alias("i"), F.max("c").alias("b")))
    hops = cut_lineage(_window_ends(points, max_words, overlap, block_words))

    reached = cut_lineage(hops.where("lo = 0").select("doc_id", F.col("lo"), F.lit(0).alias("window_idx")))
    jumps, step = hops.where("next IS NOT NULL").select("doc_id", "lo", "next"), 1
    while True:
        # All windows before ``step`` are known; those from there on are as far behind them.
        more = reached.join(jumps, ["doc_id", "lo"]).select("doc_id", F.col("next").alias("lo"), (F.col("window_idx") + step).alias("window_idx"))
        more = cut_lineage(more)
        if not more.take(1):
            break
        reached = reached.unionByName(more)
        onward = jumps.select("doc_id", F.col("lo").alias("next"), F.col("next").alias("then"))
        jumps = cut_lineage(jumps.join(onward, ["doc_id", "next"]).select("doc_id", "lo", F.col("then").alias("next")))
        step *= 2
    held = reached.join(hops.select("doc_id", "lo", "hi"), ["doc_id", "lo"]).select(
        "doc_id", "window_idx", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("i")
    )
    parts = held.join(sentences, ["doc_id", "i"]).groupBy("doc_id", "window_idx").agg(
        F.sort_array(F.collect_list(F.struct("i", "s"))).alias("parts"), F.sum("w").alias("word_count")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["s"]), "")
    return whole.unionByName(parts.select("doc_id", "window_idx", joined.alias("text"), "word_count"))


def fixed_chunks(manuscripts: DataFrame, size: int = 3500) -> DataFrame:
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    return manuscripts.where("text <> ''").select(
        "doc_id", "text", F.posexplode(starts).alias("chunk_idx", "start")
    ).select(
        "doc_id",
        "chunk_idx",
        "start",
        T.from_offset(F.col("text"), F.col("start"), F.lit(size)).alias("text"),
    )


# ---------------------------------------------------------------- edits of segment tables


def split_segments_at_quotes(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """Replace each listed mixed row by its narration and dialogue parts."""
    chosen = segments.join(ids.select("doc_id", "seg_idx").distinct().withColumn("__cut", F.lit(True)),
                           ["doc_id", "seg_idx"], "left")
    plain = F.regexp_replace(F.regexp_replace("text", "[“”]", '"'), "[‘’]", "'")
    bodies = F.split(plain, '"[^"]*"', -1)
    quotes = F.regexp_extract_all(plain, F.lit('"[^"]*"'), F.lit(0))
    parts = F.filter(
        F.flatten(
            F.transform(
                bodies, lambda b, i: F.array(b, F.coalesce(F.get(quotes, i), F.lit("")))
            )
        ),
        lambda p: T.strip(p) != "",
    )
    cut = F.coalesce(F.col("__cut"), F.lit(False)) & (F.size(parts) > 1)
    rows = chosen.withColumn("__parts", F.when(cut, parts)).select(
        *segments.columns,
        F.posexplode(F.coalesce("__parts", F.array(F.lit(None).cast("string")))).alias("__i", "__p"),
    )
    part = T.strip(F.col("__p"))
    made = F.col("__p").isNotNull()
    spoken = part.startswith('"') & part.endswith('"')
    inner = T.strip(F.regexp_replace(part, r'^"|"\z', ""))
    blank = F.lit(None).cast("string")
    changed = {
        "type": F.when(spoken, F.lit("dialogue")).otherwise(F.lit("narrator")),
        "speaker": F.when(
            spoken, F.coalesce(T.blank_to_null(F.col("speaker")), F.lit("Unknown"))
        ).otherwise(F.lit("Narrator")),
        "text": F.when(spoken, inner).otherwise(part),
        "direction": F.coalesce(
            T.blank_to_null(F.col("direction")) if "direction" in segments.columns else blank,
            F.when(spoken, F.lit("steady delivery")).otherwise(F.lit("neutral attribution tone")),
        ),
        "audio_path": blank,
    }
    for name, value in changed.items():
        if name in segments.columns:
            rows = rows.withColumn(f"__{name}", F.when(made, value).otherwise(F.col(name)))
    rows = rows.select(
        *[
            F.col(f"__{c}").alias(c) if c in changed else F.col(c)
            for c in segments.columns
        ],
        F.col("__i"),
    )
    return ordered.rerank(rows, ["doc_id"], ["seg_idx", "__i"], "new_idx").drop("__i")


def merge_adjacent(segments: DataFrame, merges: DataFrame) -> DataFrame:
    """Join listed rows with the row above or below; the upper row's fields stay.

    ``merges(doc_id, seg_idx, direction)`` refers to the rows before any merge,
    so chains of merges collapse into one row.
    """
    asked = merges.groupBy("doc_id", "seg_idx").agg(
        F.bool_or(F.col("direction") == "above").alias("__up"),
        F.bool_or(F.col("direction") == "below").alias("__down"),
    )
    marked = segments.join(asked, ["doc_id", "seg_idx"], "left")
    near = ordered.neighbours(
        marked,
        ["doc_id"],
        "seg_idx",
        prev={"__first": F.lit(False), "__prev_down": F.coalesce("__down", F.lit(False))},
    )
    has_upper = F.coalesce(~F.col("__first"), F.lit(False))
    linked = has_upper & (
        F.coalesce(F.col("__up"), F.lit(False)) | F.coalesce(F.col("__prev_down"), F.lit(False))
    )
    grouped = ordered.running(
        near.withColumn("__linked", linked),
        ["doc_id"],
        "seg_idx",
        {"__g": ("sum", (~linked).cast("int"))},
        cut=True,
    )
    keep = [c for c in segments.columns if c not in ("doc_id", "text")]
    out = grouped.groupBy("doc_id", "__g").agg(
        F.min_by(F.struct(*keep), F.col("seg_idx")).alias("__row"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("seg_idx", T.strip(F.col("text")).alias("t")))),
                lambda x: x["t"],
            ),
            " ",
        ).alias("__joined"),
        F.count(F.lit(1)).alias("merged_rows"),
        F.min_by("text", "seg_idx").alias("__own"),
    )
    text = F.when(F.col("merged_rows") > 1, F.col("__joined")).otherwise(F.col("__own"))
    return out.select(
        "doc_id",
        *[F.col("__row")[c].alias(c) for c in keep],
        text.alias("text"),
        (F.col("__g") - 1).alias("new_idx"),
        "merged_rows",
    )


def insert_rows(segments: DataFrame, inserts: DataFrame) -> DataFrame:
    """Add blank narrator rows above or below the listed rows and renumber."""
    blank = inserts.select(
        "doc_id",
        "seg_idx",
        F.lit("narrator").alias("type"),
        F.lit("Narrator").alias("speaker"),
        F.lit("").alias("text"),
        F.lit("default delivery").alias("direction"),
        F.when(F.col("direction") == "above", F.lit(0)).otherwise(F.lit(2)).alias("__side"),
        F.lit(True).alias("is_inserted"),
    )
    rows = segments.select("*", F.lit(1).alias("__side"), F.lit(False).alias("is_inserted"))
    both = rows.unionByName(blank, allowMissingColumns=True)
    return ordered.rerank(both, ["doc_id"], ["seg_idx", "__side"], "new_idx").drop("__side")
