"""Pauses, timelines, takes, word timings, exports and production counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from . import ordered

# fixed values: seconds of silence before a line
PAUSES = {"same_speaker": 0.25, "speaker_change": 0.45, "scene_break": 1.0}


def _maybe(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def inter_segment_pause(
    segments: DataFrame, config: dict[str, float] | None = None
) -> DataFrame:
    """Silence before each line; explicit values win over the defaults."""
    pause = {**PAUSES, **(config or {})}
    prev = {
        "__speaker": F.lower(T.strip(F.coalesce(T.blank_to_null(F.col("speaker")), F.lit("narrator")))),
        "__cut": F.coalesce(_maybe(segments, "is_interrupted", "boolean"), F.lit(False)),
        "__after1": _maybe(segments, "silence_after", "double"),
        "__after2": _maybe(segments, "pause_after", "double"),
    }
    rows = ordered.neighbours(segments, ["doc_id"], "seg_idx", prev=prev)

    def given(value: Column) -> Column:
        return F.when(value >= 0, value)

    explicit = [
        given(_maybe(segments, c, "double"))
        for c in ("silence_before", "pause_before_seconds", "gap_before", "pause_before")
    ]
    scene = (
        (F.coalesce("type", F.lit("")) == "scene_heading")
        | F.coalesce(_maybe(segments, "is_scene_break", "boolean"), F.lit(False))
        | F.upper(F.coalesce("text", F.lit(""))).startswith("SCENE")
    )
    cuts_in = F.coalesce(_maybe(segments, "interrupts_previous", "boolean"), F.lit(False))
    default = (
        F.when(scene, pause["scene_break"])
        .when(F.col("__speaker") != prev["__speaker"], pause["speaker_change"])
        .otherwise(pause["same_speaker"])
    )
    value = (
        F.when(F.col("__speaker").isNull(), 0.0)
        .when(F.col("__cut") | cuts_in, 0.0)
        .otherwise(F.coalesce(*explicit, given(F.col("__after1")), given(F.col("__after2")), default))
    )
    return rows.withColumn("pause_before_seconds_used", value).select(
        *segments.columns, F.col("pause_before_seconds_used").alias("pause_seconds")
    )


def timeline_preview(segments: DataFrame, config: dict[str, float] | None = None) -> DataFrame:
    """Estimated start of each line: pauses and earlier durations summed up."""
    rows = inter_segment_pause(segments, config).withColumn(
        "duration_seconds", F.greatest(F.lit(1.5), T.words(F.col("text")) / 2.5)
    )
    rows = ordered.running(
        rows,
        ["doc_id"],
        "seg_idx",
        {"__end": ("sum", F.col("pause_seconds") + F.col("duration_seconds"))},
        cut=True,
    )
    totals = rows.groupBy("doc_id").agg(F.max("__end").alias("__total"))
    return rows.join(totals, "doc_id").select(
        "doc_id",
        "seg_idx",
        "speaker",
        F.substring("text", 1, 60).alias("text_preview"),
        F.col("pause_seconds").alias("pause_before_seconds"),
        F.round(F.col("__end") - F.col("duration_seconds"), 6).alias("start_seconds"),
        F.round("duration_seconds", 6).alias("duration_seconds"),
        F.round("__total", 6).alias("total_seconds"),
    )


# ---------------------------------------------------------------- takes


def latest_take(files: DataFrame) -> DataFrame:
    """Newest take file of each line; a directorial folder goes before the classic one.

    ``files``: doc_id, seg_idx, track (directorial or classic), file_name.
    """
    name = F.col("file_name")
    usable = name.startswith("take_") & name.rlike(r"\.(wav|mp3|flac)$")
    number = F.coalesce(F.regexp_extract(name, r"\d+", 0).try_cast("int"), F.lit(0))
    per_track = files.groupBy("doc_id", "seg_idx", "track").agg(
        F.min(F.when(usable, F.struct((-number).alias("n"), "file_name"))).alias("best")
    )
    chosen = per_track.groupBy("doc_id", "seg_idx").agg(
        F.min(F.struct((F.col("track") != "directorial").alias("later"), "track", "best")).alias("c")
    )
    return chosen.where("c.best IS NOT NULL").select(
        "doc_id",
        "seg_idx",
        F.col("c.track").alias("track"),
        (-F.col("c.best.n")).alias("take"),
        F.col("c.best.file_name").alias("file_name"),
    )


def active_take_playlist(
    segments: DataFrame, takes: DataFrame, lo: int = 0, hi: int | None = None, gap: float = 0.6
) -> DataFrame:
    """Active take of each line in a range with its start on the playlist.

    ``takes``: doc_id, seg_idx, take, file_path, is_active, duration_s. Without an
    active take, take 1 is played.
    """
    rows = segments.where(F.col("seg_idx") >= lo)
    if hi is not None:
        rows = rows.where(F.col("seg_idx") <= hi)
    key = ["doc_id", "seg_idx"]
    flagged = takes.where("is_active").groupBy(*key).agg(
        F.min(F.struct("take", "file_path", "duration_s")).alias("a")
    )
    first = takes.where("take = 1").groupBy(*key).agg(
        F.min(F.struct("take", "file_path", "duration_s")).alias("f")
    )
    rows = rows.join(flagged, key, "left").join(first, key, "left").withColumn("t", F.coalesce("a", "f"))
    default = F.concat(F.lit("audio/takes/line_"), F.col("seg_idx").cast("string"), F.lit("/take_1.mp3"))
    seconds = F.coalesce(F.col("t.duration_s"), F.lit(0.0))
    rows = rows.withColumn("duration", seconds)
    rows = ordered.running(
        rows,
        ["doc_id"],
        "seg_idx",
        {"__end": ("sum", F.col("duration") + gap)},
    )
    return rows.select(
        "doc_id",
        "seg_idx",
        F.coalesce(T.blank_to_null(F.col("speaker")), F.lit("Narrator")).alias("speaker"),
        F.coalesce(F.col("t.take"), F.lit(1)).alias("active_take"),
        F.coalesce(F.col("t.file_path"), default).alias("file_path"),
        F.round(F.col("__end") - F.col("duration") - gap, 6).alias("start_seconds"),
        F.round("duration", 6).alias("duration_seconds"),
    )


def assembly_plan(segments: DataFrame, files: DataFrame, config: dict[str, float] | None = None) -> DataFrame:
    """Clip and pause of every line; lines without a take are marked missing."""
    rows = inter_segment_pause(segments, config).join(
        latest_take(files).select("doc_id", "seg_idx", "file_name"), ["doc_id", "seg_idx"], "left"
    )
    missing = F.col("file_name").isNull()
    return rows.select(
        "doc_id",
        "seg_idx",
        "speaker",
        "file_name",
        F.when(~missing, F.col("pause_seconds")).alias("pause_seconds"),
        missing.alias("is_missing"),
    )


def assembly_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("doc_id").agg(
        F.count_if(~F.col("is_missing")).alias("clips"), F.count_if("is_missing").alias("missing")
    )


# ---------------------------------------------------------------- word timings


def word_timestamps(takes: DataFrame) -> DataFrame:
    """Start and end of each word of a take.

    Recognised tokens are used when there is one per word. Otherwise time is
    shared by word weight, and the last word takes what is left. Reads doc_id,
    seg_id, text, duration_s and optionally stt_tokens.
    """
    words = F.filter(F.split(T.strip(F.coalesce("text", F.lit(""))), f"{T.WS}+", -1), lambda w: w != "")
    rows = takes.withColumn("w", words).where((F.size("w") > 0) & (F.col("duration_s") > 0))
    total = F.col("duration_s").cast("double")

    def weight(w: Column) -> Column:
        # fixed values: extra weight of pauses after punctuation
        extra = F.when(w.rlike(r"[,\-—;]$"), 3).when(w.rlike(r"[.!?]$"), 5).otherwise(0)
        return F.greatest(F.lit(2), F.length(w) + extra)

    rows = rows.withColumns({"__wt": F.transform("w", weight), "__n": F.size("w"), "__row": F.monotonically_increasing_id()})
    rows = rows.withColumn("__unit", total / F.aggregate("__wt", F.lit(0).cast("bigint"), lambda a, x: a + x))
    if "stt_tokens" in takes.columns:
        observed = F.coalesce(F.size("stt_tokens") == F.col("__n"), F.lit(False))
        heard = F.transform("stt_tokens", lambda t: F.struct(t["word"].alias("word"), F.least(F.col("duration_s"), t["timestamp_seconds"]).alias("end")))
        rows = rows.withColumn("__heard", F.when(observed, heard))
    else:
        rows = rows.withColumn("__heard", F.lit(None).cast("array<struct<word:string,end:double>>"))
    word = F.struct(
        F.coalesce(F.get("__heard", F.col("__k"))["word"], F.get("w", F.col("__k"))).alias("word"),
        F.get("__wt", F.col("__k")).alias("weight"),
        F.get("__heard", F.col("__k"))["end"].alias("heard"),
        F.coalesce(F.get("__heard", F.col("__k") - 1)["end"], F.lit(0.0)).alias("before"),
    )
    each = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).select(
        "doc_id", "seg_id", "__row", F.col("__k").alias("word_idx"), "duration_s", "__unit", "__n", F.col("__heard").isNotNull().alias("observed"), word.alias("x")
    )
    # Shares are whole milliseconds, so their running sum is exact.
    part = F.round(F.col("x.weight") * F.col("__unit"), 3)
    earlier = W.partitionBy("__row").orderBy("word_idx").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.round(part * 1000).cast("bigint")).over(earlier), F.lit(0)) / 1000.0
    each = each.withColumn("__at", F.when(F.col("observed"), F.col("x.before")).otherwise(at))
    left = F.greatest(F.lit(0.05), F.round(F.col("duration_s") - F.col("__at"), 3))
    shared = F.when(F.col("word_idx") == F.col("__n") - 1, left).otherwise(part)
    told = F.greatest(F.lit(0.05), F.round(F.col("x.heard") - F.col("__at"), 3))
    length, start = F.when(F.col("observed"), told).otherwise(shared), F.round(F.col("__at"), 3)
    return each.select(
        "doc_id",
        "seg_id",
        "word_idx",
        F.col("x.word").alias("word"),
        start.alias("start_seconds"),
        F.when(F.col("observed"), F.round(F.col("x.heard"), 3)).otherwise(F.round(start + length, 3)).alias("end_seconds"),
        length.alias("duration_seconds"),
    )


def vtt_time(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``, every part floored."""
    s = F.greatest(F.lit(0.0), F.coalesce(seconds, F.lit(0.0)))
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(s / 3600),
        F.floor(s % 3600 / 60),
        F.floor(s % 60),
        F.floor(s % 1 * 1000),
    )


def webvtt_export(word_timings: DataFrame, offset: float | Column = 0.0) -> DataFrame:
    """Caption file body of each take, one numbered cue per word."""
    shift = F.lit(offset) if isinstance(offset, (int, float)) else offset
    cue = F.concat(
        (F.col("word_idx") + 1).cast("string"), F.lit("\n"),
        vtt_time(F.col("start_seconds") + shift), F.lit(" --> "), vtt_time(F.col("end_seconds") + shift),
        F.lit("\n"), F.col("word"), F.lit("\n"),
    )
    return word_timings.groupBy("doc_id", "seg_id").agg(
        F.concat(
            F.lit("WEBVTT\n\n"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("word_idx", cue.alias("c")))), lambda x: x["c"]),
                "\n",
            ),
        ).alias("vtt")
    )


def _xml(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def _plain_number(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def smil_export(word_timings: DataFrame, chapters: DataFrame) -> DataFrame:
    """Read-along overlay of each chapter as ordered parts of the file.

    ``word_timings`` has doc_id, chapter_id, word_no (1-based in the chapter),
    start_seconds and end_seconds; ``chapters``: doc_id, chapter_id, xhtml_path,
    audio_path. Part 0 opens the file, part n is word n, the last part closes it.
    """
    key = ["doc_id", "chapter_id"]
    page, sound, chapter = _xml(F.col("xhtml_path")), _xml(F.col("audio_path")), _xml(F.col("chapter_id"))

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    head = chapters.select(
        *key,
        F.lit(0).cast("bigint").alias("part_no"),
        text(
            '<?xml version="1.0" encoding="utf-8"?>\n'
            '<smil xmlns="http://www.w3.org/ns/SMIL" xmlns:epub="http://www.idpf.org/2007/ops" version="3.0">\n'
            '  <body id="', chapter, '_overlay">\n    <seq id="', chapter, '_seq" epub:textref="', page, '">',
        ).alias("smil"),
    )
    n = F.col("word_no").cast("string")
    body = word_timings.join(chapters, key).select(
        *key,
        F.col("word_no").cast("bigint").alias("part_no"),
        text(
            '      <par id="par_', n, '">\n        <text src="', page, "#w_", n, '"/>\n        <audio src="', sound,
            '" clipBegin="', _plain_number(F.col("start_seconds")), 's" clipEnd="',
            _plain_number(F.col("end_seconds")), 's"/>\n      </par>',
        ).alias("smil"),
    )
    last = word_timings.groupBy(*key).agg(F.max("word_no").alias("m"))
    foot = chapters.join(last, key, "left").select(
        *key,
        (F.coalesce("m", F.lit(0)) + 1).cast("bigint").alias("part_no"),
        F.lit("    </seq>\n  </body>\n</smil>\n").alias("smil"),
    )
    return head.unionByName(body).unionByName(foot)


def chapter_marker_export(chapters_timed: DataFrame, books: DataFrame) -> DataFrame:
    """Chapter metadata of each book as ordered parts of the file.

    ``chapters_timed``: doc_id, chapter_idx (0-based), title, start_seconds,
    end_seconds; ``books``: doc_id, title, author.
    """

    def ms(value: Column) -> Column:
        return F.floor(F.coalesce(value, F.lit(0.0)) * 1000 + 0.5).cast("string")

    title = F.coalesce(T.blank_to_null(F.col("title")), F.lit("Audiobook"))
    head = books.select(
        "doc_id",
        F.lit(0).cast("bigint").alias("part_no"),
        F.concat(
            F.lit(";FFMETADATA1\ntitle="), title, F.lit("\nartist="),
            F.coalesce(T.blank_to_null(F.col("author")), F.lit("Author")), F.lit("\nalbum="), title,
        ).alias("meta"),
    )
    number = (F.col("chapter_idx") + 1).cast("string")
    end = F.coalesce(F.nullif("end_seconds", F.lit(0.0)), "start_seconds")
    body = chapters_timed.select(
        "doc_id",
        (F.col("chapter_idx") + 1).cast("bigint").alias("part_no"),
        F.concat(
            F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), ms(F.col("start_seconds")), F.lit("\nEND="), ms(end),
            F.lit("\ntitle="), F.coalesce(T.blank_to_null(F.col("title")), F.concat(F.lit("Chapter "), number)),
        ).alias("meta"),
    )
    return head.unionByName(body)


# ---------------------------------------------------------------- books


def master_timeline(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """All segments of a book in chapter order with one running index.

    ``chapters``: doc_id, chapter_pos, chapter_id, chapter_title.
    """
    rows = segments.join(
        chapters.select("doc_id", "chapter_pos", "chapter_id", "chapter_title"), ["doc_id", "chapter_id"]
    )
    sizes = rows.groupBy("doc_id", "chapter_pos").agg(F.count(F.lit(1)).alias("__n"))
    offsets = ordered.running(
        sizes,
        ["doc_id"],
        "chapter_pos",
        {"__end": ("sum", F.col("__n"))},
    ).select(
        "doc_id", "chapter_pos", (F.col("__end") - F.col("__n")).alias("__base")
    )
    rows = ordered.renumber(
        rows,
        ["doc_id", "chapter_pos"],
        "seg_idx",
        "__pos",
    )
    return (
        rows.join(offsets, ["doc_id", "chapter_pos"])
        .withColumn("global_segment_index", F.col("__base") + F.col("__pos"))
        .withColumn("is_chapter_start", F.col("__pos") == 0)
        .drop("__base", "__pos")
    )


def chapter_upsert(segments: DataFrame, update: DataFrame) -> DataFrame:
    """Replace the rows of the chapters in ``update``; all others stay."""
    touched = update.select("doc_id", "chapter_id").distinct()
    kept = segments.join(touched, ["doc_id", "chapter_id"], "left_anti")
    return kept.unionByName(update, allowMissingColumns=True)


def chapter_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("doc_id", "chapter_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(T.words(F.col("text"))).alias("word_count")
    )


# fixed values: kinds of defects that are counted
DEFECTS = ["stt_mismatch", "timbre_drift", "pacing_anomaly", "cross_character_conflict"]


def production_metrics(segments: DataFrame, takes: DataFrame, reviews: DataFrame, defects: DataFrame) -> DataFrame:
    """Review effort, false alarms and re-renders of each book.

    ``segments``: doc_id, duration_s, is_flagged; ``takes``: doc_id; ``reviews``:
    doc_id, outcome (modified or accepted); ``defects``: doc_id, defect.
    """
    book = segments.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.sum("duration_s").alias("__s"),
        F.count_if(F.coalesce("is_flagged", F.lit(False))).alias("__f"),
    )
    made = takes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__t"))
    seen = reviews.groupBy("doc_id").agg(
        F.count_if(F.col("outcome") == "modified").alias("__m"),
        F.count_if(F.col("outcome") == "accepted").alias("__a"),
    )
    found = defects.groupBy("doc_id").pivot("defect", DEFECTS).count()
    rows = (
        book.join(made, "doc_id", "left").join(seen, "doc_id", "left").join(found, "doc_id", "left").na.fill(0)
    )
    hours = F.col("__s") / 3600.0
    n, flags, audited, t = F.col("total_segments"), F.col("__f"), F.col("__m") + F.col("__a"), F.col("__t")
    minutes = F.round(flags * 1.5, 1)

    def rate(top: Column, bottom: Column, ok: Column | None = None) -> Column:
        return F.when((bottom > 0) if ok is None else ok, F.round(top / bottom * 100.0, 1)).otherwise(0.0)

    return rows.select(
        "doc_id",
        "total_segments",
        F.round(hours, 2).alias("runtime_hours"),
        F.when(hours > 0, F.round(minutes / hours, 1)).otherwise(0.0).alias("review_minutes_per_hour"),
        minutes.alias("review_minutes"),
        rate(flags, n).alias("flagged_pct"),
        rate(F.col("__a"), audited).alias("false_positive_pct"),
        rate(t - n, n, (n > 0) & (t > n)).alias("rerender_pct"),
        F.when(n > 0, F.round(t / n, 2)).otherwise(1.0).alias("takes_per_segment"),
        *DEFECTS,
    )


def synthesis_progress(segments: DataFrame) -> DataFrame:
    """Lines with audio and whole percent done, per book and track."""
    done = F.count_if(F.coalesce("audio_path", F.lit("")) != "")
    return segments.groupBy("doc_id", "track").agg(
        F.count(F.lit(1)).alias("total"),
        done.alias("completed"),
        F.floor(done / F.count(F.lit(1)) * 100).cast("int").alias("progress_pct"),
    )
