"""Queries over sources and sinks: project files, logs, markers, lexicons, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import readers as RD
from ..sources import writers as WR
from ..streaming import qc as SQ
from .inputs import Inputs
from .registry import query
from .script_queries import ARC_SQL, _arc_events
from .text_queries import SP


def _folder(t: Inputs, label: str) -> str:
    """A fresh folder beside the checkpoints, on the storage all executors share."""
    return f"{checkpoint_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


# A project file per document; every tenth one is cut off in the middle.
def _projects(t: Inputs):
    lines = F.filter(F.split("text", "\n", -1), lambda s: s != "")
    segments = F.transform(
        lines,
        lambda s, i: F.struct(
            F.when(i % 2 == 0, F.concat(F.lit("seg_"), i.cast("string"))).alias("id"),
            F.when(i % 3 == 0, "dialogue").otherwise("narrator").alias("type"),
            F.when(i % 3 == 0, F.col("source")).otherwise(F.lit("Narrator")).alias("speaker"),
            s.alias("text"),
            F.when(i % 4 == 0, 0.5).alias("confidence"),
            F.when(i % 5 == 0, F.lit(True)).alias("is_user_locked"),
        ),
    )
    chapters = F.transform(
        F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")),
        lambda n: F.struct(
            F.concat(F.lit("chapter_0"), n.cast("string")).alias("chapter_id"),
            n.alias("chapter_number"),
            F.concat(F.lit("Part "), n.cast("string")).alias("chapter_title"),
        ),
    )
    state = F.struct(
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("Book "), F.col("doc_id").cast("string"))).alias("projectName"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("chapter_02")).alias("active_chapter_id"),
        F.when(F.col("doc_id") % 6 != 0, segments).alias("scriptSegments"),
        F.when(F.col("doc_id") % 5 != 0, chapters).alias("chapters"),
        F.create_map(F.col("source"), F.struct(F.col("lang").alias("voice"), F.lit(True).alias("isLocked"))).alias("voiceMapping"),
        F.array(
            F.struct(
                F.col("source").alias("char_a"),
                F.lit("Narrator").alias("b"),
                F.array(F.struct(F.lit(0).alias("from_segment"), F.lit("allied").alias("relation_type"))).alias("states"),
            )
        ).alias("relationships"),
    )
    raw = F.to_json(state)
    cut = F.substr(raw, F.lit(1), F.floor(F.length(raw) / 2).cast("int"))
    return t.documents.select(
        "doc_id",
        F.concat(F.lit("folder_"), F.col("doc_id").cast("string")).alias("project_name"),
        F.when(F.col("doc_id") % 10 == 7, cut).otherwise(raw).alias("raw"),
    )


_LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


@query(
    "project_catalog",
    f"""SELECT doc_id, CASE WHEN ok THEN CASE WHEN doc_id % 4 <> 0 THEN 'Book ' || doc_id ELSE 'folder_' || doc_id END END AS title,
          CASE WHEN ok THEN CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 3 + 1 AS INT) ELSE 1 END END AS chapters_count,
          CASE WHEN ok THEN CASE WHEN doc_id % 6 <> 0 THEN CAST(len({_LINES}) AS INT) ELSE 0 END END AS segments_count,
          CASE WHEN ok THEN CASE WHEN doc_id % 2 = 0 THEN 'chapter_02' ELSE 'chapter_01' END END AS active_chapter_id,
          CASE WHEN NOT ok THEN 'Invalid project file' END AS error
        FROM (SELECT *, doc_id % 10 <> 7 AS ok FROM documents) q""",
)
def project_catalog(t: Inputs):
    return RD.project_catalog(_projects(t))


_SEGS = f"""
    l AS (SELECT doc_id, source, {_LINES} AS s FROM documents WHERE doc_id % 10 <> 7 AND doc_id % 6 <> 0),
    segs AS (
      SELECT doc_id, CAST(i AS INT) AS seg_idx, CASE WHEN i % 2 = 0 THEN 'seg_' || i ELSE 'seg_' || (i + 1) END AS seg_id,
             CASE WHEN i % 3 = 0 THEN 'dialogue' ELSE 'narrator' END AS type,
             CASE WHEN i % 3 = 0 THEN source ELSE 'Narrator' END AS speaker, s[i + 1] AS text,
             CASE WHEN i % 4 = 0 THEN 0.5 END::DOUBLE AS confidence, i % 5 = 0 AS is_user_locked
      FROM (SELECT doc_id, source, s, unnest(range(0, len(s))) AS i FROM l) q)"""
_COLS = ["doc_id", "seg_idx", "seg_id", "type", "speaker", "text", "confidence", "is_user_locked"]


@query("load_project_state", f"WITH {_SEGS} SELECT * FROM segs")
def load_project_state(t: Inputs):
    return RD.project_tables(_projects(t))["segments"].select(*_COLS)


@query("save_tables", f"WITH {_SEGS} SELECT * REPLACE (CASE WHEN doc_id % 50 = 3 THEN 'Rewritten' ELSE speaker END AS speaker) FROM segs")
def save_tables(t: Inputs):
    """Write the tables, write single books of several buckets again, and read everything back."""
    tables = {"segments": RD.project_tables(_projects(t))["segments"].select(*_COLS)}
    path = _folder(t, "state")
    WR.save_tables(tables, path, buckets=8)
    again = tables["segments"].where("doc_id % 50 = 3").withColumn("speaker", F.lit("Rewritten"))
    WR.save_tables({"segments": again}, path, buckets=8)
    return WR.load_table(t.spark, path, "segments")


def _log_lines(t: Inputs):
    line = t.table("events").select(
        "event_id",
        F.to_json(
            F.struct(
                F.col("event_id").cast("string").alias("id"),
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
                F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("question_type"),
                F.col("event_type").alias("task"),
                F.when(F.col("event_id") % 4 != 0, F.col("value") / 1000).alias("raw_probability"),
                F.when(F.col("event_id") % 5 == 0, F.lit(True)).alias("human_verdict"),
                F.when(F.col("event_id") % 6 == 0, F.lit("")).when(F.col("event_id") % 6 == 1, F.lit("b1")).alias("book_id"),
                F.create_map(F.lit("k"), F.col("event_type")).alias("criteria"),
            )
        ).alias("value"),
    )
    half = F.substr("value", F.lit(1), F.floor(F.length("value") / 2).cast("int"))
    broken = F.when(F.col("event_id") % 11 == 10, half).when(F.col("event_id") % 13 == 12, F.lit("null"))
    return line.select(F.coalesce(broken, F.col("value")).alias("value"), "event_id")


_LOG_SQL = """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS question_type, CASE WHEN event_id % 4 <> 0 THEN value / 1000 ELSE 0.5 END AS raw_probability,
       CASE WHEN event_id % 5 = 0 THEN TRUE END AS human_verdict, CASE WHEN event_id % 6 = 1 THEN 'b1' ELSE 'default_book' END AS book_id,
       event_type AS criterion, '' AS state, 0.0::DOUBLE AS elapsed_ms FROM events
WHERE event_id % 11 <> 10 AND event_id % 13 <> 12"""


def _log_view(df):
    return df.select(
        "id", "question_type", "raw_probability", "human_verdict", "book_id",
        F.col("criteria")["k"].alias("criterion"), "state", "elapsed_ms",
    )


@query("qc_log_read", _LOG_SQL)
def qc_log_read(t: Inputs):
    return _log_view(RD.qc_log_parse(_log_lines(t)))


@query("qc_log_quarantine", "SELECT event_id FROM events WHERE event_id % 11 = 10 OR event_id % 13 = 12")
def qc_log_quarantine(t: Inputs):
    return RD.qc_log_quarantine(_log_lines(t)).select("event_id")


@query("qc_log_append", _LOG_SQL)
def qc_log_append(t: Inputs):
    path = _folder(t, "log")
    records = RD.qc_log_parse(_log_lines(t))
    even = F.col("id").cast("bigint") % 2 == 0
    WR.qc_log_append(records.where(even), path)
    WR.qc_log_append(records.where(~even), path)
    return _log_view(RD.qc_log_read(t.spark, path))


@query(
    "timeline_markers_read",
    f"""SELECT CAST(seg_idx + doc_id * 100 AS INT) AS index_position, CASE WHEN seg_idx % 4 = 0 THEN 'Unknown' ELSE speaker END AS speaker,
          'Line "' || seg_id || '", ' || trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), {SP}) AS text,
          CASE WHEN seg_idx % 3 = 0 THEN 0.0 ELSE intensity END AS start_time_seconds
        FROM script WHERE (doc_id + seg_idx) % 7 <> 0""",
    ["script"],
)
def timeline_markers_read(t: Inputs):
    def quoted(value):
        return F.concat(F.lit('"'), F.regexp_replace(value, '"', '""'), F.lit('"'))

    one_line = F.trim(F.regexp_replace("text", r"[\r\n]+", " "))
    said = F.concat(F.lit('Line "'), F.col("seg_id"), F.lit('", '), one_line)
    short = (F.col("doc_id") + F.col("seg_idx")) % 7 == 0
    line = F.concat_ws(
        ",",
        (F.col("seg_idx") + F.col("doc_id") * 100).cast("string"),
        F.when(F.col("seg_idx") % 4 == 0, F.lit("")).otherwise(quoted(F.col("speaker"))),
        F.when(~short, quoted(said)),
        F.when(~short, F.when(F.col("seg_idx") % 3 == 0, F.lit("")).otherwise(F.col("intensity").cast("string"))),
    )
    path = _folder(t, "markers")
    head = "index_position,speaker,text,start_time_seconds"
    rows = t.script.select(line.alias("value"))
    # Every part file starts with its own header line.
    rows.withColumn("p", F.spark_partition_id()).mapInPandas(
        lambda parts: (
            f.assign(value=[f"{head}\n{f['value'].iloc[0]}", *f["value"].iloc[1:]])[["value"]] if i == 0 and len(f) else f[["value"]]
            for i, f in enumerate(parts)
        ),
        "value string",
    ).write.text(path)
    return RD.timeline_markers_read(t.spark, path)


def _lexicons(t: Inputs):
    word, other = F.substring("text", 1, 3), F.col("lang")
    entry = F.struct(
        F.concat(F.lit(" "), word).alias("target_word"), other.alias("replacement"), F.lit("odd").alias("type"),
        F.lit(True).alias("case_sensitive"),
    )
    blank = F.struct(
        F.lit(" ").alias("target_word"), other.alias("replacement"), F.lit("phoneme").alias("type"), F.lit(False).alias("case_sensitive")
    )
    named = F.struct(other.alias("key"), F.col("source").alias("value"), F.lit("phoneme").alias("type"))
    listed, entries = F.to_json(F.array(entry, blank)), F.to_json(F.struct(F.array(named).alias("entries")))
    plain = F.to_json(F.create_map(other, F.col("source"), F.lit("Mr"), F.lit("Mister")))
    kind = F.col("doc_id") % 3
    return t.documents.select(
        "doc_id", F.when(kind == 0, listed).when(kind == 1, entries).otherwise(plain).alias("raw")
    )


@query(
    "lexicon_load",
    f"""
    SELECT doc_id, trim(substr(text, 1, 3), {SP}) AS target_word, lang AS replacement, 'respelling' AS type, TRUE AS case_sensitive FROM documents
      WHERE doc_id % 3 = 0 AND trim(substr(text, 1, 3), {SP}) <> ''
    UNION ALL SELECT doc_id, lang, source, 'phoneme', FALSE FROM documents WHERE doc_id % 3 = 1
    UNION ALL SELECT doc_id, lang, source, 'respelling', FALSE FROM documents WHERE doc_id % 3 = 2
    UNION ALL SELECT doc_id, 'Mr', 'Mister', 'respelling', FALSE FROM documents WHERE doc_id % 3 = 2""",
)
def lexicon_load(t: Inputs):
    return RD.lexicon_load(_lexicons(t)).select("doc_id", "target_word", "replacement", "type", "case_sensitive")


# Model answers: fenced, plain, with prose around the block, broken, of other kinds, and without content.
def _answers(t: Inputs):
    spans = F.to_json(
        F.struct(
            F.array(
                F.struct(F.lit("dialogue").alias("type"), F.col("speaker").alias("speaker"), F.col("text").alias("text")),
                F.struct(F.lit("other").alias("type"), F.lit("Narrator").alias("speaker"), F.col("seg_id").alias("text")),
                F.struct(F.lit("narrator").alias("type"), F.lit("Narrator").alias("speaker"), F.lit(" ").alias("text")),
            ).alias("spans")
        )
    )
    person = F.struct(F.col("speaker").alias("name"), F.array("seg_id").alias("aliases"))
    tie = F.struct(
        F.col("speaker").alias("char_a"),
        F.lit("Narrator").alias("b"),
        F.array(F.struct(F.col("seg_idx").cast("int").alias("from_segment"), F.lit("allied").alias("relation_type"))).alias("states"),
    )
    k = (F.col("doc_id") + F.col("seg_idx")) % 9
    raw = (
        F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), spans, F.lit("\n```\nDone.")))
        .when(k == 1, spans)
        .when(k == 2, F.concat(F.lit("Sure {not json} then "), spans, F.lit(" as asked.")))
        .when(k == 3, F.concat(F.lit("No luck: "), F.substr(spans, F.lit(1), F.floor(F.length(spans) / 2).cast("int"))))
        .when(k == 4, F.to_json(F.struct(F.array(person).alias("cast"))))
        .when(k == 5, F.to_json(F.struct(F.array(tie).alias("relationships"))))
        .when(k == 6, F.concat(F.lit("See [1] first. "), spans))
        .when(k == 7, F.lit('{"foo": 1}'))
        .otherwise(F.to_json(F.array(person)))
    )
    return t.script.select(
        F.concat_ws("_", "doc_id", "seg_idx").alias("response_id"),
        F.when(k == 8, "cast").otherwise("spans").alias("kind"),
        raw.alias("raw"),
    )


@query(
    "model_response_ingest",
    f"""
    WITH s AS (SELECT * FROM script WHERE (doc_id + seg_idx) % 9 IN (0, 1, 2, 6))
    SELECT doc_id || '_' || seg_idx AS response_id, 'spans' AS kind, 0 AS ord, 'dialogue' AS type, speaker, trim(text, {SP}) AS text FROM s
    UNION ALL SELECT doc_id || '_' || seg_idx, 'spans', 1, 'narrator', 'Narrator', seg_id FROM s""",
    ["script"],
)
def model_response_ingest(t: Inputs):
    return RD.model_response_ingest(_answers(t))[0]


@query(
    "model_response_cast",
    """SELECT doc_id || '_' || seg_idx AS response_id, CASE WHEN (doc_id + seg_idx) % 9 = 8 THEN 'cast' ELSE 'spans' END AS kind,
         0 AS ord, speaker AS name, seg_id AS alias FROM script WHERE (doc_id + seg_idx) % 9 IN (4, 8) AND trim(speaker) <> ''""",
    ["script"],
)
def model_response_cast(t: Inputs):
    found = RD.model_response_tables(_answers(t))["cast"]
    return found.select("response_id", "kind", "ord", "name", F.explode("aliases").alias("alias"))


@query(
    "model_response_relationships",
    """SELECT doc_id || '_' || seg_idx AS response_id, speaker AS a, 'Narrator' AS b, CAST(seg_idx AS INT) AS from_segment,
         'allied' AS relation_type FROM script WHERE (doc_id + seg_idx) % 9 = 5 AND speaker IS NOT NULL""",
    ["script"],
)
def model_response_relationships(t: Inputs):
    found = RD.model_response_tables(_answers(t))["relationships"]
    return found.select("response_id", "a", "b", F.explode("states").alias("s")).select(
        "response_id", "a", "b", "s.from_segment", "s.relation_type"
    )


@query(
    "model_response_quarantine",
    "SELECT doc_id || '_' || seg_idx AS response_id, 'spans' AS kind FROM script WHERE (doc_id + seg_idx) % 9 IN (3, 7)",
    ["script"],
)
def model_response_quarantine(t: Inputs):
    return RD.model_response_ingest(_answers(t))[1].drop("raw")


# ---------------------------------------------------------------- streams


def _run(t: Inputs, stream, label: str, mode: str = "append", out: str | None = None):
    """Run a stream over everything there is, from its checkpoint in ``out`` if there is one, and read what it wrote."""
    out = out or _folder(t, label)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state")
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{out}/rows")
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{out}/rows")


def _event_stream(t: Inputs):
    schema = t.table("events").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


# Events in the order of their ids, in several files; the last one brings some of the first again.
_PARTS = 4
_PART = f"CAST(floor((event_id - lo) * {_PARTS} / (hi - lo + 1)) AS INT)"
_BOUNDS = "(SELECT min(event_id) AS lo, max(event_id) AS hi FROM {events}) b"
_RESENT = f"event_id % 50 = 0 AND {_PART} = 0"


def _run_restarted(t: Inputs, build, label: str, mode: str, resend: bool = False):
    """Run a stream over one part of the files after the other, each time from its checkpoint."""
    folder, out, result = _folder(t, f"{label}-files"), _folder(t, label), None
    low, high = t.table("events").agg(F.min("event_id"), F.max("event_id")).first()
    placed = t.table("events").withColumns({"lo": F.lit(low), "hi": F.lit(high)})
    with SQ.stateful(t.spark):
        for part in range(_PARTS):
            rows = placed.where(f"{_PART} = {part}")
            if resend and part == _PARTS - 1:
                rows = rows.unionByName(placed.where(_RESENT))
            # The rows of a file are in no order.
            rows.drop("lo", "hi").sortWithinPartitions(F.xxhash64("event_id")).write.parquet(f"{folder}/{part}")
            stream = t.spark.readStream.schema(t.table("events").schema).parquet(f"{folder}/*")
            result = _run(t, build(stream), label, mode, out)
    return result


@query(
    "streaming_qc",
    """SELECT event_type AS question_type, count(*) AS total, count_if(event_id % 5 = 0)::BIGINT AS with_verdict,
              count_if(event_id % 2 = 0)::BIGINT AS agreements FROM events GROUP BY event_type""",
)
def streaming_qc(t: Inputs):
    def build(events):
        return SQ.task_totals(events.selectExpr(
            "event_type AS question_type", "CASE WHEN event_id % 5 = 0 THEN true END AS human_verdict",
            "event_id % 2 = 0 AS is_agreement",
        ))

    return _run_restarted(t, build, "totals", "complete")


def _settled(t: Inputs):
    """All decisions; a third has a verdict, half of these five hours late."""

    def parts(rows):
        decisions = rows.selectExpr("CAST(event_id AS STRING) AS id", "ts")
        verdicts = rows.where("event_id % 3 = 0").selectExpr(
            "CAST(event_id AS STRING) AS id",
            "CASE WHEN event_id % 6 = 3 THEN ts + INTERVAL 5 HOURS ELSE ts + INTERVAL 10 MINUTES END AS ts",
            "event_type = 'click' AS verdict", "'' AS notes",
        )
        return decisions, verdicts

    stamped = F.col("ts").cast("timestamp")
    streamed = _run(t, SQ.attach_verdicts(*parts(_event_stream(t).withColumn("ts", stamped))), "verdicts")
    decisions, verdicts = parts(t.table("events").withColumn("ts", stamped))
    return SQ.settle_verdicts(decisions, streamed, verdicts)


@query(
    "streaming_verdicts",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN event_type = 'click' END AS verdict,
              event_id % 6 = 3 AS is_late FROM events""",
)
def streaming_verdicts(t: Inputs):
    return _settled(t).select("id", "verdict", "is_late")


@query(
    "streaming_late_verdicts",
    """SELECT count(*) AS decisions, count_if(event_id % 3 = 0)::BIGINT AS with_verdict, count_if(event_id % 6 = 3)::BIGINT AS late
       FROM events""",
)
def streaming_late_verdicts(t: Inputs):
    return SQ.late_counts(_settled(t))


def _streamed_arc(t: Inputs):
    def build(events):
        source = Inputs(t.spark, t.folder)
        source.table = lambda _name: events
        return SQ.emotion_arc_stream(_arc_events(source))

    return _run_restarted(t, build, "arc", "append", resend=True)


@query(
    "streaming_emotion_arc",
    f"""{ARC_SQL} SELECT doc_id, char_id, line_idx, intensity, FALSE AS is_dropped FROM arc
    UNION ALL SELECT user_id % 10, 'u' || user_id, event_id, NULL, TRUE FROM events, {_BOUNDS.format(events="events")} WHERE {_RESENT}""",
)
def streaming_emotion_arc(t: Inputs):
    return _streamed_arc(t)


@query(
    "streaming_dropped_rows",
    f"""SELECT user_id % 10 AS doc_id, 'u' || user_id AS char_id, count(*) AS kept, count_if({_RESENT})::BIGINT AS dropped
    FROM events, {_BOUNDS.format(events="events")} GROUP BY ALL""",
)
def streaming_dropped_rows(t: Inputs):
    return SQ.dropped_rows(_streamed_arc(t))
