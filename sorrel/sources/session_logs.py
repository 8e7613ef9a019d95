"""Append-only session logs as a data source: read in batch or as a stream, and appended to exactly once."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

LINES = "session_id string, line_no struct<part:int,path:string,start:bigint>, value string"
FOLDER = "session_id="
STAGED = "_staged"
#: Bytes of logs that one task reads, and rows of a batch.
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 4096


@dataclass(frozen=True)
class Log:
    """A file of a session: ``<id>.jsonl`` itself (part 0), or one in the folder ``session_id=<quoted id>`` (part 1)."""

    session: str
    part: int
    path: str
    size: int


def list_logs(root: str, only: frozenset[str] | None = None) -> list[Log]:
    """The logs under a folder, or those of some sessions, by path; a folder that isn't there has none.

    Names are read, no file is opened, and folders of sessions that aren't asked for are not entered. Folders above those
    of sessions may be nested.
    """
    out, queue = [], [(root, None)]
    while queue:
        folder, session = queue.pop()
        try:
            entries = list(os.scandir(folder))
        except FileNotFoundError:
            continue
        for e in entries:
            if e.is_dir():
                own = unquote(e.name.removeprefix(FOLDER)) if e.name.startswith(FOLDER) else session
                if e.name != STAGED and (only is None or own is None or own in only):
                    queue.append((e.path, own))
            elif e.name.endswith(".jsonl") or session is not None and e.name.startswith("part-"):
                own = session if session is not None else e.name.removesuffix(".jsonl")
                if only is None or own in only:
                    out.append(Log(own, int(session is not None), os.path.relpath(e.path, root), e.stat().st_size))
    return sorted(out, key=lambda x: x.path)


class _Ranges(InputPartition):
    """Byte ranges (session, part, path, start, stop)."""

    def __init__(self, ranges: list[tuple[str, int, str, int, int]]):
        self.ranges = ranges


def _packed(ranges: Iterator[tuple[str, int, str, int, int]], most: int) -> list[_Ranges]:
    """Ranges cut at ``most`` bytes and put together up to it, so neither one long log nor many short ones make odd tasks."""
    out, held, size = [], [], 0
    for session, part, path, start, stop in ranges:
        for at in range(start, stop, most):
            end = min(at + most, stop)
            if held and size + end - at > most:
                out.append(_Ranges(held))
                held, size = [], 0
            held.append((session, part, path, at, end))
            size += end - at
    return [*out, _Ranges(held)] if held else out


def _lines_of(root: str, ranges: list[tuple[str, int, str, int, int]]) -> Iterator[tuple[str, int, str, int, str]]:
    """Lines that begin in the ranges, whichever range they end in."""
    for session, part, path, start, stop in ranges:
        with open(os.path.join(root, path), "rb") as f:
            if start:
                f.seek(start - 1)
                f.readline()
            while (at := f.tell()) < stop and (line := f.readline()):
                yield session, part, path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")


def _batches(rows: Iterator[tuple[str, int, str, int, str]]) -> Iterator[pa.RecordBatch]:
    place = pa.struct([("part", pa.int32()), ("path", pa.string()), ("start", pa.int64())])
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield _batch(held, place)
            held = []
    if held:
        yield _batch(held, place)


def _batch(rows: list[tuple], place: pa.DataType) -> pa.RecordBatch:
    session, part, path, start, value = zip(*rows, strict=True)
    at = pa.StructArray.from_arrays([pa.array(part, pa.int32()), pa.array(path, pa.string()), pa.array(start, pa.int64())], fields=list(place))
    return pa.RecordBatch.from_arrays([pa.array(session, pa.string()), at, pa.array(value, pa.string())], ["session_id", "line_no", "value"])


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.names = options.get("names", "false").lower() == "true"
        self.only: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on session_id say which folders are entered and which files opened."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("session_id",):
                own = frozenset(f.value if isinstance(f, In) else (f.value,))
                self.only = own if self.only is None else self.only & own
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = [(x.session, x.part, x.path, 0, x.size) for x in list_logs(self.root, self.only)]
        if self.names:
            return [_Ranges(found[i : i + BATCH_ROWS]) for i in range(0, len(found), BATCH_ROWS)] or [_Ranges([])]
        return _packed(iter(found), self.most) or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        if self.names:
            return _batches((session, part, path, 0, None) for session, part, path, _, _ in partition.ranges)
        return _batches(_lines_of(self.root, partition.ranges))


def whole_lines(path: str, size: int, known: int = 0) -> int:
    """Up to which byte a log's first ``size`` bytes are whole lines; the first ``known`` are.

    What follows the last line end counts if it is a JSON object, which can't be the beginning of a longer one; else it is
    a line that is still being written.
    """
    with open(path, "rb") as f:
        tail, at = b"", size
        while at > known and b"\n" not in tail:
            step = min(1 << 16, at - known)
            at -= step
            f.seek(at)
            tail = f.read(step) + tail
    end = tail.rfind(b"\n") + 1
    rest = tail[end:]
    try:
        if rest and isinstance(json.loads(rest), dict):
            return size
    except ValueError:
        pass
    return size - len(rest)


class LogStream(DataSourceStreamReader):
    """A stream whose offset says for each log up to which byte it has been read.

    A batch is a set of byte ranges, so a restart from a checkpoint reads the very same lines again and no others. A log
    that gets shorter isn't append-only and stops the stream.
    """

    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.known: dict[str, tuple[int, int]] = {}  # size when last looked at, and bytes of whole lines in it

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for x in list_logs(self.root):
            size, whole = self.known.get(x.path, (0, 0))
            if x.size < size:
                raise ValueError(f"{x.path} has become shorter")
            if x.size > size:
                self.known[x.path] = (x.size, whole_lines(os.path.join(self.root, x.path), x.size, whole))
        return {path: whole for path, (_, whole) in self.known.items() if whole}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for path, stop in start.items():
            if end.get(path, 0) < stop:
                raise ValueError(f"{path} has become shorter")
        grown = {p for p, stop in end.items() if stop > start.get(p, 0)}
        sessions = {p: _session_of(p) for p in grown}
        return _packed(((*sessions[p], p, start.get(p, 0), end[p]) for p in sorted(grown)), self.most)

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        return _batches(_lines_of(self.root, partition.ranges))


def _session_of(path: str) -> tuple[str, int]:
    folders, name = os.path.split(path)
    for folder in reversed(folders.split(os.sep)):
        if folder.startswith(FOLDER):
            return unquote(folder.removeprefix(FOLDER)), 1
    return name.removesuffix(".jsonl"), 0


@dataclass
class Staged(WriterCommitMessage):
    """(session, first place, last place, staged file) of what one task has written."""

    files: list[tuple[str, int, int, str]]


class LogWriter(DataSourceWriter):
    """Appends rows (session_id, place, value), sorted by session and place in each task.

    A task writes a session's lines to a staged file; only files of tasks that the driver commits are moved, so what a
    failed, repeated or speculative task has written is never seen. An append is known by its session and its name: the
    option ``batch``, or else its first and last place. One that is there already is left as it is, so a job that is run
    again, or dies during its commit and is run again, appends once. Without ``batch`` places are ordinals: an append that
    shares some with another one of the session is an error, and nothing of the job is appended.
    """

    def __init__(self, options: dict):
        self.root, self.batch = options["path"], options.get("batch")

    def write(self, iterator: Iterator) -> Staged:
        os.makedirs(os.path.join(self.root, STAGED), exist_ok=True)
        files = []
        for session, rows in groupby(iterator, key=lambda r: r["session_id"]):
            path, places = os.path.join(self.root, STAGED, f"{uuid.uuid4().hex}.jsonl"), []
            with open(path, "w", encoding="utf-8") as f:
                for r in rows:
                    f.write(r["value"] + "\n")
                    places.append(r["place"])
                f.flush()
                os.fsync(f.fileno())
            files.append((session, places[0], places[-1], path))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = {s: self._names(s) for s, *_ in files}
        new = [(s, self.batch or f"{a}..{b}", path) for s, a, b, path in files if not self._there(s, a, b, names[s])]
        for session, key, path in new:
            folder = self._folder(session)
            os.makedirs(folder, exist_ok=True)
            number = max((int(n.split(".", 1)[0]) for n in self._names(session)), default=0)
            while True:
                number += 1
                try:
                    os.link(path, os.path.join(folder, f"{number:09d}.{quote(key, safe='.-')}.jsonl"))
                    break
                except FileExistsError:
                    continue
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        for m in messages:
            for *_, path in m.files if m is not None else ():
                os.unlink(path)

    def _folder(self, session: str) -> str:
        return os.path.join(self.root, FOLDER + quote(session, safe=""))

    def _names(self, session: str) -> list[str]:
        try:
            return [n for n in os.listdir(self._folder(session)) if n.endswith(".jsonl") and n[:9].isdigit()]
        except FileNotFoundError:
            return []

    def _there(self, session: str, first: int, last: int, names: list[str]) -> bool:
        keys = {unquote(n.split(".", 1)[1].removesuffix(".jsonl")) for n in names}
        if (self.batch or f"{first}..{last}") in keys:
            return True
        if self.batch is None:
            for a, b in (map(int, k.split("..")) for k in keys if re.fullmatch(r"-?\d+\.\.-?\d+", k)):
                if a <= last and first <= b:
                    raise ValueError(f"session {session} already has lines of places {first} to {last}")
        return False


class SessionLogs(DataSource):
    """``session_log``: lines of the logs in a folder that driver and executors share, for read, readStream and write.

    Options: path; splitBytes, the bytes that one task reads; names (true: a row without value for each log, no file is
    opened); batch, the name of an append (see :class:`LogWriter`).
    """

    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("session logs are only appended to")
        return LogWriter(self.options)
