"""Streaming form of the decision log, its verdicts and the emotion state."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import staging
from ..operators.staging import START, step_intensity

# The process that prepares a stateful operator on the driver does not see shipped packages.
for _module in (staging.__name__, __name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])


def task_totals(decisions: DataFrame) -> DataFrame:
    """Running totals per task; write in complete or update mode."""
    return decisions.groupBy("question_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("human_verdict").alias("with_verdict"),
        F.count_if(F.coalesce("is_agreement", F.lit(False))).alias("agreements"),
    )


def attach_verdicts(decisions: DataFrame, verdicts: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Join each decision with a verdict that comes within ``lateness``.

    Both sides carry a watermark, so the join state is bounded. Decisions whose
    verdict comes later leave with a null verdict; :func:`settle_verdicts` attaches it.
    """
    d = decisions.withWatermark("ts", lateness)
    v = verdicts.select(
        F.col("id").alias("v_id"), F.col("ts").alias("v_ts"), "verdict", "notes"
    ).withWatermark("v_ts", lateness)
    near = F.expr(f"id = v_id AND v_ts >= ts AND v_ts <= ts + INTERVAL {lateness}")
    return d.join(v, near, "left_outer").drop("v_id")


def settle_verdicts(decisions: DataFrame, streamed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every decision with its verdict: as streamed, or as it came too late for the stream.

    A batch step over what the stream wrote and the verdicts that arrived meanwhile.
    ``is_late`` marks the verdicts the stream left out. Of several for one decision the
    last counts.
    """
    on_time = streamed.where("verdict IS NOT NULL").select("id", "verdict", "notes").dropDuplicates(["id"])
    newest = verdicts.groupBy("id").agg(F.max_by(F.struct("verdict", "notes"), "ts").alias("v"))
    late = newest.join(on_time, "id", "left_anti").select("id", "v.verdict", "v.notes")
    known = on_time.withColumn("is_late", F.lit(False)).unionByName(late.withColumn("is_late", F.lit(True)))
    return decisions.join(known, "id", "left").withColumn("is_late", F.coalesce("is_late", F.lit(False)))


def late_counts(settled: DataFrame) -> DataFrame:
    """How many decisions there are, with a verdict, and with one that came late."""
    return settled.agg(
        F.count(F.lit(1)).alias("decisions"),
        F.count("verdict").alias("with_verdict"),
        F.count_if("is_late").alias("late"),
    )


ARC_SCHEMA = "doc_id bigint, char_id string, line_idx bigint, intensity double, is_dropped boolean"
_ARC_STATE = "level double, line_idx bigint"
# State with a time to live needs this store. A run over what there is must not go on for the sake of its clocks.
_STATEFUL = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Session settings under which streams with expiring state start and end; as before afterwards."""
    before = {key: spark.conf.get(key, None) for key in _STATEFUL}
    for key, value in _STATEFUL.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class ArcState(StatefulProcessor):
    """Level and last line of one character, forgotten ``idle_ms`` after they last changed."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.arc = handle.getValueState("arc", _ARC_STATE, self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.arc.get()
        level, seen = (START, -1) if held is None else held
        parts = list(rows)
        # Most characters have few rows in a batch: plain lists cost less than frames do.
        at, baseline, trigger, lines = (
            np.concatenate([part[name].to_numpy() for part in parts]) for name in ("line_idx", "baseline", "trigger", "lines")
        )
        order = np.argsort(at, kind="stable")
        at, intensity, dropped = at[order].tolist(), [], []
        for here, *change in zip(at, baseline[order].tolist(), trigger[order].tolist(), lines[order].tolist(), strict=True):
            late = here <= seen
            if not late:
                level, seen = step_intensity(level, *change), here
            intensity.append(None if late else level)
            dropped.append(late)
        self.arc.update((level, seen))
        columns = (key[0], key[1], at, intensity, dropped)
        yield pd.DataFrame(dict(zip([f.split()[0] for f in ARC_SCHEMA.split(", ")], columns, strict=True)))

    def close(self) -> None:
        pass


def emotion_arc_stream(events: DataFrame, idle: timedelta = timedelta(days=7)) -> DataFrame:
    """Emotion recurrence per character over a stream of events.

    Within a micro-batch rows are taken in line order; a row that is not newer than the last
    one seen is marked as dropped and changes nothing (:func:`dropped_rows` counts
    these). The state of a character that gets no rows for ``idle`` expires; one that
    comes back begins anew. Write in append mode, within :func:`stateful`.
    """
    rows = events.select(
        "doc_id",
        "char_id",
        "line_idx",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("baseline", F.lit(START)))).alias("baseline"),
        F.coalesce("trigger_strength", F.lit(0.0)).alias("trigger"),
        F.greatest(F.lit(1), F.coalesce("lines_since", F.lit(1))).cast("int").alias("lines"),
    )
    return rows.groupBy("doc_id", "char_id").transformWithStateInPandas(
        ArcState(int(idle.total_seconds() * 1000)), ARC_SCHEMA, "append", "processingTime"
    )


def dropped_rows(streamed: DataFrame) -> DataFrame:
    """How many rows of each character the stream kept and dropped."""
    return streamed.groupBy("doc_id", "char_id").agg(
        F.count_if(~F.col("is_dropped")).alias("kept"), F.count_if("is_dropped").alias("dropped")
    )
