"""What a user may replace: sources, lookups, tools, planners, guards, stores, recorders and sinks; and the ones that come along."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions
from ..sources import repo


class FileProvider(Protocol):
    """Files of a tree: file_id, rel_path, lang, scan_ord, content."""

    def files(self, spark: SparkSession, root: str) -> DataFrame: ...


class Navigator(Protocol):
    """Definitions and references of names (name), as :mod:`sorrel.operators.navigation` has them."""

    def definitions(self, names: DataFrame) -> DataFrame: ...

    def references(self, names: DataFrame) -> DataFrame: ...


class SymbolResolver(Protocol):
    """locations (file_id, start_line, ...) with their signature."""

    def signatures(self, locations: DataFrame) -> DataFrame: ...


class Tool(Protocol):
    """What a step of its name does: whether it went well, and what it says."""

    def run(self, step: Row) -> tuple[bool, str]: ...


class TaskPlanner(Protocol):
    def plan(self, request: str, task: Row, context: str) -> list[Row] | None: ...


class SafetyGuard(Protocol):
    """Why an action is forbidden, or None; allowed actions are remembered."""

    def check(self, session_id: str, kind: str, payload: dict) -> str | None: ...


class SessionStore(Protocol):
    def create(self, title: str | None = None) -> Session: ...

    def get(self, session_id: str) -> Session | None: ...

    def save(self, session: Session) -> None: ...

    def list(self) -> list[Summary]: ...


class TrajectoryRecorder(Protocol):
    def run_started(self, session_id: str, request: str) -> None: ...

    def event(self, session_id: str, event: dict) -> None: ...

    def step(self, step: dict) -> None: ...

    def run_ended(self, session_id: str, outcome: str) -> None: ...


class EventSink(Protocol):
    def emit(self, event: dict) -> None: ...

    def snapshot(self) -> list[dict] | None: ...


def now_ms() -> int:
    return int(time.time() * 1000)


@dataclass
class Message:
    id: str
    role: str
    content: str
    timestamp: int


@dataclass
class Session:
    id: str
    title: str | None
    created_at: int
    updated_at: int
    messages: list[Message] = field(default_factory=list)

    def push(self, role: str, content: str, clock: Callable[[], int] = now_ms) -> Message:
        m = Message(f"msg:{uuid.uuid4()}", role, content, clock())
        self.messages.append(m)
        self.updated_at = m.timestamp
        return m


@dataclass(frozen=True)
class Summary:
    id: str
    title: str | None
    message_count: int
    updated_at: int


def new_session(title: str | None, clock: Callable[[], int] = now_ms) -> Session:
    at = clock()
    return Session(f"local:{uuid.uuid4()}", title, at, at)


class MemoryStore:
    """Sessions in the driver's memory."""

    def __init__(self, clock: Callable[[], int] = now_ms):
        self._sessions: dict[str, Session] = {}
        self.clock = clock

    def create(self, title: str | None = None) -> Session:
        s = new_session(title, self.clock)
        self.save(s)
        return s

    def get(self, session_id: str) -> Session | None:
        return self._sessions.get(session_id)

    def save(self, session: Session) -> None:
        self._sessions[session.id] = session

    def list(self) -> list[Summary]:
        rows = [Summary(s.id, s.title, len(s.messages), s.updated_at) for s in self._sessions.values()]
        return sorted(rows, key=lambda s: (-s.updated_at, s.id))


class LogStore:
    """Sessions as append-only logs in a folder that driver and executors share. Only one session at a time is collected."""

    MESSAGE = "session_id string, ordinal int, id string, role string, content string, timestamp bigint"
    CREATED = "session_id string, title string, ts_ms bigint"

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], int] = now_ms):
        self.spark, self.folder, self.clock = spark, folder, clock

    def events(self) -> DataFrame:
        return sessions.parse_session_log(repo.session_lines(self.spark, self.folder))

    def _append(self, created: Iterable[tuple], messages: Iterable[tuple]) -> None:
        made, said = self.spark.createDataFrame(list(created), self.CREATED), self.spark.createDataFrame(list(messages), self.MESSAGE)
        sessions.append_sessions(sessions.session_log_lines(made, said), self.folder)

    def create(self, title: str | None = None) -> Session:
        s = new_session(title, self.clock)
        self._append([(s.id, s.title, s.created_at)], [])
        return s

    def get(self, session_id: str) -> Session | None:
        mine = self.events().where(F.col("session_id") == session_id)
        head = sessions.replay(mine).first()
        if head is None:
            return None
        said = sessions.live_messages(mine).orderBy("line_no").collect()
        return Session(session_id, head["title"], head["created_at"], head["updated_at"], [Message(m["id"], m["role"], m["content"], m["timestamp"]) for m in said])

    def save(self, session: Session) -> None:
        """Append the messages beyond those that the log holds; the log of a session that is not there is begun."""
        mine = self.events().where(F.col("session_id") == session.id)
        rows = [(session.id, i, m.id, m.role, m.content, m.timestamp) for i, m in enumerate(session.messages)]
        known = not sessions.replay(mine).isEmpty()
        new = sessions.unsaved(self.spark.createDataFrame(rows, self.MESSAGE), sessions.saved_ordinals(mine)) if known else self.spark.createDataFrame(rows, self.MESSAGE)
        created = self.spark.createDataFrame([] if known else [(session.id, session.title, session.created_at)], self.CREATED)
        new = self.spark.createDataFrame(new.collect(), self.MESSAGE)  # one session's; its log must not be read while it is appended to
        if not known or not new.isEmpty():
            sessions.append_sessions(sessions.session_log_lines(created, new), self.folder)

    def list(self) -> list[Summary]:
        rows = sessions.list_sessions(sessions.replay(self.events())).collect()
        return [Summary(r["session_id"], r["title"], r["message_count"], r["updated_at"]) for r in rows]


class NoRecorder:
    def run_started(self, session_id: str, request: str) -> None:
        pass

    def event(self, session_id: str, event: dict) -> None:
        pass

    def step(self, step: dict) -> None:
        pass

    def run_ended(self, session_id: str, outcome: str) -> None:
        pass


class LogRecorder(NoRecorder):
    """Steps as they are and events as lines of type event, appended to a folder when a run ends."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._lines = spark, folder, []

    def event(self, session_id: str, event: dict) -> None:
        self._lines.append((session_id, json.dumps({"type": "event", "session_id": session_id, "event": event}, sort_keys=True)))

    def step(self, step: dict) -> None:
        self._lines.append((step["session_id"], json.dumps(step, sort_keys=True)))

    def run_ended(self, session_id: str, outcome: str) -> None:
        lines, self._lines = [(s, i, v) for i, (s, v) in enumerate(self._lines)], []
        if lines:
            sessions.append_sessions(self.spark.createDataFrame(lines, "session_id string, place int, value string"), self.folder, batch=uuid.uuid4().hex)


class ListSink:
    def __init__(self) -> None:
        self.events: list[dict] = []

    def emit(self, event: dict) -> None:
        self.events.append(event)

    def snapshot(self) -> list[dict]:
        return list(self.events)


def store_for(spark: SparkSession, env: dict[str, str]) -> SessionStore:
    """Logs in the home folder that the environment names, else memory."""
    home = repo.home_folder(env)
    return LogStore(spark, f"{home}/sessions") if home else MemoryStore()
