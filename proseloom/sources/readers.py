"""Readers: books, project files, decision logs, markers, lexicons, model answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as t

from ..functions import text as T
from ..operators import lexicon as L

# ---------------------------------------------------------------- books


def load_manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """Whole-text books or scene files with the number in their name as order."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.xxhash64("path").alias("doc_id"),
        F.coalesce(F.regexp_extract(name, r"\d+", 0).try_cast("int"), F.lit(0)).alias("file_no"),
        name.alias("source"),
        T.strip(F.col("text")).alias("text"),
    )


def manuscripts_from_table(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", "lang", "source")


# ---------------------------------------------------------------- project files

_SEGMENT = (
    "struct<id:string,type:string,speaker:string,text:string,direction:string,confidence:double,"
    "scene_heading:string,is_user_locked:boolean,audioPath:string>"
)
_STATE = (
    "struct<from_segment:int,relation_type:string,relation_tone:string,status:string,"
    "power_dynamic:string,trigger:string>"
)
PROJECT_SCHEMA = (
    f"projectName string, active_chapter_id string, rawBookText string, "
    f"scriptSegments array<{_SEGMENT}>, "
    f"chapters array<struct<chapter_id:string,chapter_number:int,chapter_title:string,raw_text:string>>, "
    f"voiceMapping map<string,struct<voice:string,gender:string,age:string,isLocked:boolean,aliases:array<string>>>, "
    f"relationships array<struct<id:string,a:string,char_a:string,b:string,char_b:string,states:array<{_STATE}>>>, "
    f"pronunciationDictionary map<string,string>, _corrupt string"
)


def read_project_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw project files, one row each: doc_id, project_name, raw."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("p"), F.col("value").alias("raw")
    )
    return files.select(
        F.xxhash64("p").alias("doc_id"), F.element_at(F.split("p", "/"), -2).alias("project_name"), "raw"
    )


def _parsed(raw: DataFrame) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return raw.withColumn("s", F.from_json("raw", PROJECT_SCHEMA, options))


def project_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """Explode project files (doc_id, raw) into normalised tables."""
    state = _parsed(raw).where("s._corrupt IS NULL").select("doc_id", "s.*")

    def rows(field: str, name: str) -> DataFrame:
        return state.select("doc_id", F.posexplode(field).alias(name, "x"))

    segments = rows("scriptSegments", "seg_idx").select(
        "doc_id",
        "seg_idx",
        F.coalesce("x.id", F.concat(F.lit("seg_"), (F.col("seg_idx") + 1).cast("string"))).alias("seg_id"),
        *[F.col(f"x.{c}").alias(c) for c in ("type", "speaker", "text", "direction", "confidence", "scene_heading")],
        F.coalesce("x.is_user_locked", F.lit(False)).alias("is_user_locked"),
        F.col("x.audioPath").alias("audio_path"),
    )
    chapters = rows("chapters", "chapter_pos").select("doc_id", "chapter_pos", "x.*")
    cast = state.select("doc_id", F.explode("voiceMapping").alias("name", "x")).select(
        "doc_id", "name", "x.voice", "x.gender", "x.age",
        F.coalesce("x.isLocked", F.lit(False)).alias("is_locked"), "x.aliases",
    )
    states = (
        rows("relationships", "ord")
        .select(
            "doc_id",
            F.col("x.id").alias("pair_id"),
            F.coalesce("x.a", "x.char_a").alias("a"),
            F.coalesce("x.b", "x.char_b").alias("b"),
            F.explode("x.states").alias("s"),
        )
        .select("doc_id", "pair_id", "a", "b", "s.*")
    )
    lexicon = state.select("doc_id", F.explode("pronunciationDictionary").alias("target_word", "replacement"))
    books = state.select("doc_id", F.col("projectName").alias("title"), "active_chapter_id", F.col("rawBookText").alias("text"))
    return {
        "manuscripts": books,
        "chapters": chapters,
        "segments": segments,
        "cast": cast,
        "relationship_states": states,
        "lexicon": lexicon,
    }


def project_catalog(raw: DataFrame) -> DataFrame:
    """Title, sizes and active chapter of each project; bad files become error rows."""
    rows = _parsed(raw)
    bad = F.col("s._corrupt").isNotNull() | F.col("s").isNull()

    def ok(value: Column) -> Column:
        return F.when(~bad, value)

    return rows.select(
        "doc_id",
        ok(F.coalesce(T.blank_to_null(F.col("s.projectName")), F.col("project_name"))).alias("title"),
        ok(F.coalesce(F.size("s.chapters"), F.lit(1))).alias("chapters_count"),
        ok(F.coalesce(F.size("s.scriptSegments"), F.lit(0))).alias("segments_count"),
        ok(F.coalesce(T.blank_to_null(F.col("s.active_chapter_id")), F.lit("chapter_01"))).alias("active_chapter_id"),
        F.when(bad, F.lit("Invalid project file")).alias("error"),
    )


# ---------------------------------------------------------------- decision log

LOG_SCHEMA = (
    "id string, timestamp string, question_type string, task string, claim string, state string, "
    "criteria map<string,string>, raw_probability double, choice string, human_verdict boolean, "
    "book_id string, notes string, elapsed_ms double, is_agreement boolean"
)


def _log_rows(lines: DataFrame, col: str) -> DataFrame:
    """Lines that are not blank, with their record ``r`` and whether it is broken."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    record = F.from_json(col, f"{LOG_SCHEMA}, _corrupt string", options)
    rows = lines.where(F.trim(col) != "").withColumn("r", record)
    broken = ~F.trim(col).startswith("{") | F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.withColumn("broken", broken)


def qc_log_quarantine(lines: DataFrame, col: str = "value") -> DataFrame:
    """The rows whose line holds no decision record, as they are."""
    return _log_rows(lines, col).where("broken").select(*lines.columns)


def qc_log_parse(lines: DataFrame, col: str = "value") -> DataFrame:
    """Decision records of JSON lines with the defaults of missing fields.

    Broken lines are left to :func:`qc_log_quarantine`.
    """
    rows = _log_rows(lines, col).where("NOT broken")
    return rows.select(
        "r.id",
        F.to_timestamp("r.timestamp").alias("timestamp"),
        F.coalesce("r.question_type", "r.task").alias("question_type"),
        "r.claim",
        F.coalesce("r.state", F.lit("")).alias("state"),
        F.coalesce("r.criteria", F.create_map().cast("map<string,string>")).alias("criteria"),
        F.coalesce("r.raw_probability", F.lit(0.5)).alias("raw_probability"),
        "r.choice",
        "r.human_verdict",
        F.coalesce(T.blank_to_null(F.col("r.book_id")), F.lit("default_book")).alias("book_id"),
        "r.notes",
        F.coalesce("r.elapsed_ms", F.lit(0.0)).alias("elapsed_ms"),
        "r.is_agreement",
    )


def qc_log_read(spark: SparkSession, path: str) -> DataFrame:
    return qc_log_parse(spark.read.text(path))


# ---------------------------------------------------------------- markers

_MARKERS = "index_position string, speaker string, text string, start string, _corrupt string"


def timeline_markers_read(spark: SparkSession, path: str) -> DataFrame:
    """Markers of CSV files with a header; rows of fewer than four fields go."""
    rows = spark.read.csv(
        path,
        schema=_MARKERS,
        header=True,
        quote='"',
        escape='"',
        mode="PERMISSIVE",
        columnNameOfCorruptRecord="_corrupt",
        enforceSchema=True,
    )
    return rows.where("start IS NOT NULL OR _corrupt IS NULL").select(
        F.col("index_position").try_cast("int").alias("index_position"),
        F.coalesce(T.blank_to_null(F.col("speaker")), F.lit("Unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("start").try_cast("double"), F.lit(0.0)).alias("start_time_seconds"),
    )


# ---------------------------------------------------------------- lexicon

_ENTRY = (
    "struct<target_word:string,key:string,replacement:string,value:string,type:string,"
    "case_sensitive:boolean,notes:string>"
)


def lexicon_load(raw: DataFrame) -> DataFrame:
    """Lexicon entries of JSON texts (doc_id, raw): a list, ``{entries: []}`` or a map."""
    body = F.trim("raw")
    is_list = body.startswith("[")
    listed = F.when(is_list, F.from_json("raw", f"array<{_ENTRY}>")).otherwise(
        F.from_json("raw", f"entries array<{_ENTRY}>")["entries"]
    )
    plain = F.when(
        ~is_list & listed.isNull(), F.map_entries(F.from_json("raw", "map<string,string>"))
    )
    as_entries = F.transform(
        plain,
        lambda e: F.when(
            e["value"].startswith("{"),
            F.from_json(e["value"], _ENTRY[len("struct<") : -1].replace(":", " ")).withField("target_word", e["key"]),
        ).otherwise(
            F.from_json(F.lit("{}"), _ENTRY[len("struct<") : -1].replace(":", " "))
            .withField("target_word", e["key"])
            .withField("replacement", e["value"])
        ),
    )
    rows = raw.select("doc_id", F.posexplode(F.coalesce(listed, as_entries)).alias("ord", "e"))
    return L.normalise_entries(
        rows.select(
            "doc_id",
            "ord",
            F.coalesce(T.blank_to_null(F.col("e.target_word")), F.col("e.key")).alias("target_word"),
            F.coalesce(T.blank_to_null(F.col("e.replacement")), F.col("e.value")).alias("replacement"),
            F.col("e.type").alias("type"),
            F.col("e.case_sensitive").alias("case_sensitive"),
            F.col("e.notes").alias("notes"),
        )
    )


# ---------------------------------------------------------------- model answers

_BAD_ESCAPE = re.compile(r'\\([^"\\/bfnrtu])')
_WANTED = ("cast", "script_segments", "spans", "relationships")


def _closing(text: str, at: int) -> int:
    """Offset after the bracket that closes the one at ``at``, or -1."""
    brackets = r"[{}]" if text[at] == "{" else r"[\[\]]"
    depth = 0
    for token in re.compile(rf'"(?:\\.|[^"\\])*(?:"|\Z)|{brackets}', re.S).finditer(text, at):
        if token.group() == text[at]:
            depth += 1
        elif len(token.group()) == 1 and token.group() != '"':
            depth -= 1
            if depth == 0:
                return token.end()
    return -1


def _first_block(text: str) -> str | None:
    """First balanced JSON block with known content, else the first valid one."""
    spare, at = None, 0
    while match := re.compile(r"[\[{]").search(text or "", at):
        end = _closing(text, match.start())
        if end < 0:
            break
        block, at = _BAD_ESCAPE.sub(r"\\\\\1", text[match.start() : end]), end
        try:
            value = json.loads(block)
        except ValueError:
            continue
        if isinstance(value, list):
            if any(isinstance(entry, dict) for entry in value):
                return block
        elif any(value.get(k) for k in _WANTED):
            return block
        spare = spare or block
    return spare


@F.pandas_udf(t.StringType())
def _scan(raw: pd.Series) -> pd.Series:
    return raw.map(_first_block)


_PARTS = {
    "spans": "struct<type:string,speaker:string,text:string>",
    "cast": "struct<name:string,gender:string,age:string,voice_profile:string,aliases:array<string>>",
    "relationships": f"struct<a:string,char_a:string,b:string,char_b:string,states:array<{_STATE}>>",
}


def _answers(responses: DataFrame) -> DataFrame:
    """Model answers with the entries of each kind that say something.

    A fenced block is tried first, then the whole text. Only what is left is
    scanned for a balanced block, in Python. A bare list is of the kind asked for.
    """
    raw = T.strip(F.coalesce("raw", F.lit("")))

    def valid(value: Column) -> Column:
        safe = F.regexp_replace(T.strip(value), r'\\([^"\\/bfnrtu])', r"\\\\$1")
        return F.when(F.try_parse_json(safe).isNotNull() & safe.rlike(r"^[\[{]"), safe)

    fence = T.blank_to_null(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1))
    rows = responses.withColumn("doc", F.coalesce(valid(fence), valid(raw)))
    rows = rows.where("doc IS NOT NULL").unionByName(rows.where("doc IS NULL").withColumn("doc", _scan(raw)))
    inner = F.from_json("doc", f"{', '.join(f'{n} array<{kind}>' for n, kind in _PARTS.items())}, script_segments array<{_PARTS['spans']}>")

    def entries(name: str) -> Column:
        own = F.col("kind") == name if name != "spans" else ~F.coalesce(F.col("kind").isin("cast", "relationships"), F.lit(False))
        listed = F.when(F.col("doc").startswith("[") & own, F.from_json("doc", f"array<{_PARTS[name]}>"))
        found = F.coalesce(listed, inner[name], inner["script_segments"]) if name == "spans" else F.coalesce(listed, inner[name])
        said = {
            "spans": lambda x: T.strip(F.coalesce(x["text"], F.lit(""))) != "",
            "cast": lambda x: T.strip(F.coalesce(x["name"], F.lit(""))) != "",
            "relationships": lambda x: F.coalesce(x["a"], x["char_a"]).isNotNull() & F.coalesce(x["b"], x["char_b"]).isNotNull(),
        }[name]
        numbered = F.transform(found, lambda x, i: F.struct(i.alias("ord"), x.alias("x")))
        return F.coalesce(F.filter(numbered, lambda e: e["x"].isNotNull() & said(e["x"])), F.array())

    return rows.select("response_id", "kind", "raw", *[entries(name).alias(name) for name in _PARTS])


def model_response_tables(responses: DataFrame) -> dict[str, DataFrame]:
    """Typed rows of raw model answers, and the answers without any row.

    ``spans``, ``cast`` and ``relationships`` hold one row for each entry that says
    something; every other answer is in ``quarantine``.
    """
    found = _answers(responses)

    def rows(name: str) -> DataFrame:
        return found.select("response_id", "kind", F.explode(name).alias("e")).select("response_id", "kind", "e.ord", "e.x")

    states = rows("relationships").select("response_id", "kind", "ord", "x.*")
    return {
        "spans": rows("spans").select(
            "response_id",
            "kind",
            "ord",
            F.when(F.col("x.type") == "dialogue", "dialogue").otherwise("narrator").alias("type"),
            F.col("x.speaker").alias("speaker"),
            T.strip(F.col("x.text")).alias("text"),
        ),
        "cast": rows("cast").select("response_id", "kind", "ord", "x.*"),
        "relationships": states.select(
            "response_id", "kind", "ord", F.coalesce("a", "char_a").alias("a"), F.coalesce("b", "char_b").alias("b"), "states"
        ),
        "quarantine": found.where(" AND ".join(f"size({name}) = 0" for name in _PARTS)).select("response_id", "kind", "raw"),
    }


def model_response_ingest(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans of model answers, and the answers without anything that can be read."""
    tables = model_response_tables(responses)
    return tables["spans"], tables["quarantine"]
