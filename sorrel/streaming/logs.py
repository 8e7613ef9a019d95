"""Structured Streaming over append-only logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import parse_session_log
from ..sources.repo import session_line_stream


def windowed_counts(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) per event-time window; a watermark is set if ``late`` is given."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def session_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of session logs as events (session_id, line_no, type, title, ts_ms, message); see :mod:`sources.session_logs`."""
    return parse_session_log(session_line_stream(spark, folder))


class SessionFold(StatefulProcessor):
    """Per session its title, times and number of messages, as a replay of the log has them: a creation starts anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "title string, created_at bigint, updated_at bigint, message_count bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.now.get() if self.now.exists() else None
        every = pd.concat(list(rows)).sort_values("place", kind="stable")
        for kind, title, ts in every[["type", "title", "ts"]].itertuples(index=False, name=None):
            ts = None if pd.isna(ts) else int(ts)
            if kind == "session_created":
                state = (None if pd.isna(title) else title, ts, ts, 0)
            elif state is not None:
                times = [t for t in (state[2], ts) if t is not None]
                state = (state[0], state[1], max(times, default=None), state[3] + 1)
        if state is not None:
            self.now.update(tuple(state))
            yield pd.DataFrame([(key[0], *state)], columns=["session_id", "title", "created_at", "updated_at", "message_count"]).astype({"created_at": "Int64", "updated_at": "Int64"})

    def close(self) -> None:
        pass


def session_totals(events: DataFrame) -> DataFrame:
    """Running (session_id, title, created_at, updated_at, message_count) of a stream of session events, for update mode.

    A session's creation resets it and messages before any creation don't count, as in a replay. Within a batch a
    session's events go by line_no.
    """
    place = F.concat_ws("|", F.col("line_no.part").cast("string"), "line_no.path", F.lpad(F.col("line_no.start").cast("string"), 20, "0"))
    rows = events.select("session_id", "type", "title", F.coalesce("message.timestamp", "ts_ms").alias("ts"), place.alias("place"))
    out = "session_id string, title string, created_at bigint, updated_at bigint, message_count bigint"
    return rows.groupBy("session_id").transformWithStateInPandas(SessionFold(), out, "Update", "None")


class EditGuard(StatefulProcessor):
    """Per session the digests of the last ``recent`` recorded actions; an edit among them is warned of."""

    def __init__(self, recent: int = 32):
        self.recent = recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        history = [d for (d,) in self.history.get()]
        out = []
        for pdf in rows:
            for r in pdf.sort_values("seq").itertuples():
                digest = f"{r.kind}:{r.payload}"
                again = r.kind == "EditFile" and digest in history
                if r.denied is None or r.denied != r.denied:
                    history = [*history, digest][-self.recent :]
                    out.append((key[0], r.seq, "Warn" if again else "Allow"))
                else:
                    out.append((key[0], r.seq, "Deny"))
        self.history.put([(d,) for d in history])
        yield pd.DataFrame(out, columns=["session_id", "seq", "decision"])

    def close(self) -> None:
        pass


def guard_stream(actions: DataFrame, recent: int = 32) -> DataFrame:
    """Decisions (session_id, seq, decision) for a stream of actions (session_id, seq, kind, payload)."""
    from ..functions.tasks import dangerous_command

    bad = F.when(F.col("kind") == "Terminal", dangerous_command(F.coalesce(F.get_json_object("payload", "$.cmd"), F.lit(""))))
    return actions.withColumn("denied", bad).groupBy("session_id").transformWithStateInPandas(EditGuard(recent), "session_id string, seq bigint, decision string", "Append", "None")
