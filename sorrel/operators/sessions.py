"""Sessions, guard and trajectories from append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tasks import dangerous_command, step_reward

SESSION_EVENT = "type string, session_id string, title string, ts_ms bigint, message struct<id:string,role:string,content:string,timestamp:bigint>"


def parse_session_log(text_lines: DataFrame) -> DataFrame:
    """Rows (session_id, line_no, value) as events; blank and malformed lines are skipped.

    The session is named by its file, not by what a line says.
    """
    e = text_lines.where(F.trim("value") != "").select("session_id", "line_no", F.from_json("value", SESSION_EVENT).alias("e"))
    return e.where(F.col("e.type").isin("session_created", "message_appended")).select("session_id", "line_no", "e.type", "e.title", "e.ts_ms", "e.message")


def live_messages(events: DataFrame) -> DataFrame:
    """Messages after a session's last creation, which starts it anew; those before any creation are dropped."""
    made = events.where("type = 'session_created'").groupBy(F.col("session_id").alias("_sid")).agg(F.max("line_no").alias("_at"))
    kept = events.where("type = 'message_appended'").join(made, (F.col("session_id") == F.col("_sid")) & (F.col("line_no") > F.col("_at")))
    return kept.select("session_id", "line_no", "message.*")


def replay(events: DataFrame) -> DataFrame:
    """(session_id, title, created_at, updated_at, message_count): the fold of each session's log.

    Two aggregates, no list of messages: a session of any length is folded map-side.
    """
    made = events.where("type = 'session_created'").groupBy("session_id").agg(F.max_by(F.struct("title", "ts_ms"), "line_no").alias("c"))
    sums = live_messages(events).groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"), F.max("timestamp").alias("last"))
    out = made.join(sums, "session_id", "left")
    return out.select("session_id", F.col("c.title").alias("title"), F.col("c.ts_ms").alias("created_at"), F.greatest(F.col("c.ts_ms"), F.col("last")).alias("updated_at"), F.coalesce("message_count", F.lit(0).cast("bigint")).alias("message_count"))


def list_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "title", "message_count", "updated_at").orderBy(F.desc("updated_at"), "session_id")


def switch_target(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """requests (request_id, wanted): the session local:<wanted>, else wanted itself, else null."""
    ids = sessions.select("session_id").distinct()
    a, b = ids.select(F.col("session_id").alias("_a")), ids.select(F.col("session_id").alias("_b"))
    joined = requests.join(a, F.concat(F.lit("local:"), F.col("wanted")) == F.col("_a"), "left").join(b, F.col("wanted") == F.col("_b"), "left")
    return joined.select("request_id", "wanted", F.coalesce("_a", "_b").alias("session_id"))


def unsaved(messages: DataFrame, saved: DataFrame) -> DataFrame:
    """Messages (session_id, ordinal, ...) that a log doesn't hold yet; what a save appends."""
    return messages.join(saved.select("session_id", "ordinal").distinct(), ["session_id", "ordinal"], "left_anti")


def saved_ordinals(events: DataFrame) -> DataFrame:
    """(session_id, ordinal) of the messages that logs hold since their last creation, numbered from 0."""
    n = live_messages(events).groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 0")
    return n.select("session_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal"))


def session_log_lines(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, place, value): log lines of new sessions (session_id, title, ts_ms), created first, and of messages.

    messages: session_id, ordinal, id, role, content, timestamp.
    """
    made = sessions.select("session_id", F.lit(-1).alias("place"), F.to_json(F.struct(F.lit("session_created").alias("type"), "session_id", "title", "ts_ms")).alias("value"))
    message = F.struct("id", "role", "content", "timestamp").alias("message")
    said = messages.select("session_id", F.col("ordinal").alias("place"), F.to_json(F.struct(F.lit("message_appended").alias("type"), "session_id", message)).alias("value"))
    return made.unionByName(said)


def append_sessions(log_lines: DataFrame, folder: str, batch: str | None = None) -> None:
    """Append lines (session_id, place, value) to the logs of a folder, from which :func:`sources.repo.session_lines` reads.

    A session's lines of one append are one file in the session's folder, in order of place. What is appended again, by a
    repeated task or a job that is run anew, is appended once: an append is known by its session and ``batch``, or by its
    first and last place if that is None; then places are ordinals, of which no two appends may share one.
    """
    from ..sources.session_logs import SessionLogs

    log_lines.sparkSession.dataSource.register(SessionLogs)
    rows = log_lines.select("session_id", F.col("place").cast("bigint").alias("place"), "value").repartition("session_id").sortWithinPartitions("session_id", "place")
    writer = rows.write.format("session_log").mode("append")
    (writer if batch is None else writer.option("batch", batch)).save(folder)


def append_stream(log_lines: DataFrame, folder: str, checkpoint: str, name: str):
    """Start a query that appends a stream of lines (session_id, place, value) to logs, each batch of it once.

    name tells this query's appends from those of others and must stay the same over its restarts.
    """
    each = lambda rows, batch: append_sessions(rows, folder, f"{name}-{batch}")
    return log_lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def append_trajectory(steps: DataFrame, path: str) -> None:
    steps.write.mode("append").partitionBy("session_id").json(path)


def wrap_events(events: DataFrame) -> DataFrame:
    """Events (session_id, event) as trajectory lines."""
    return events.select(F.lit("event").alias("type"), "session_id", "event")


def guard(actions: DataFrame, recent: int = 32) -> DataFrame:
    """Add decision and reason to actions (session_id, seq, kind, payload): Allow, Warn or Deny.

    A forbidden command is denied and not recorded. An edit equal, kind and payload, to one of the session's last
    ``recent`` recorded actions is warned of. That is a distance to the last equal action, so a session's history is one
    window over its rows and no list is built.
    """
    bad = F.when(F.col("kind") == "Terminal", dangerous_command(F.coalesce(F.get_json_object("payload", "$.cmd"), F.lit(""))))
    rows = actions.withColumn("_bad", bad).withColumn("_digest", F.xxhash64("kind", "payload"))
    order = Window.partitionBy("session_id").orderBy("seq")
    rows = rows.withColumn("_n", F.sum(F.col("_bad").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = Window.partitionBy("session_id", "_digest", "kind", "payload", F.col("_bad").isNull()).orderBy("seq")
    rows = rows.withColumn("_last", F.lag("_n").over(same))
    again = (F.col("kind") == "EditFile") & F.col("_bad").isNull() & (F.col("_n") - F.col("_last") <= recent)
    decision = F.when(F.col("_bad").isNotNull(), "Deny").when(F.coalesce(again, F.lit(False)), "Warn").otherwise("Allow")
    return rows.select(*actions.columns, decision.alias("decision"), F.col("_bad").alias("reason"))


def first_failures(steps: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Steps up to each key's first failure, which ends it: what a sequential run would have done."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("ok", ok).withColumn("_failed", F.coalesce(F.sum((~F.col("ok")).cast("int")).over(w), F.lit(0))).where("_failed = 0").drop("_failed")


def step_rewards(steps: DataFrame) -> DataFrame:
    return steps.withColumn("reward", step_reward(F.col("ok")))


def turn_rewards(steps: DataFrame, keys: list[str]) -> DataFrame:
    """1 for a turn with any match, else 0. steps: keys and ``matches``."""
    return steps.groupBy(*keys).agg(F.when(F.coalesce(F.max("matches"), F.lit(0)) > 0, 1.0).otherwise(0.0).alias("reward"))


def rollback(edits: DataFrame) -> DataFrame:
    """(path, content): the first version of every edited file. edits: path, version, content."""
    return edits.groupBy("path").agg(F.min_by("content", "version").alias("content"))
