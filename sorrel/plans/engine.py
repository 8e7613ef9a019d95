"""One object over a source tree: index it once, then look up, retrieve, plan and run turns."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import render, tasks, text
from ..functions.languages import symbol_kinds
from ..functions.missing import missing_in
from ..operators import context, extract, navigation, scope
from ..operators.stages import checkpointed
from ..sources import repo
from . import surface
from .completion import CompletionClient, Disabled

# Messages.
TOO_LONG = "❌ Input too long: exceeds max_input_chars={}. Please shorten or split your request."
DANGEROUS = "危险命令拦截：命中 `{}`"
REPEATED = "⚠️ Warning: 重复编辑，请检查逻辑"


@dataclass(frozen=True)
class Budget:
    max_input_chars: int = 32_000
    max_io_bytes: int = 65_536
    max_steps: int = 12
    max_context_tokens: int = 4_000


@dataclass
class Turn:
    task: str
    output: str
    review: str
    events: list[dict] = field(default_factory=list)


class Engine:
    """The index of a tree as tables: files, nodes, edges. Lookups are plans over these; only what they return is collected."""

    def __init__(self, spark: SparkSession, root: str, budget: Budget | None = None, client: CompletionClient | None = None, history: int = 32, prefer_client: bool | None = None, files: surface.FileProvider | None = None, tools: dict[str, surface.Tool] | None = None, guard: surface.SafetyGuard | None = None, store: surface.SessionStore | None = None, recorder: surface.TrajectoryRecorder | None = None, sink: surface.EventSink | None = None):
        """prefer_client: plan with the completion client, which is the default if there is one; anything else given replaces its part."""
        self.spark, self.root, self.budget, self.client, self.history = spark, root, budget or Budget(), client or Disabled(), history
        self.prefer_client = not isinstance(self.client, Disabled) if prefer_client is None else prefer_client
        self.tools, self.guard, self.store = tools or {}, guard, store or surface.MemoryStore()
        self.recorder, self.sink = recorder or surface.NoRecorder(), sink or surface.ListSink()
        self.cache, self._refills, self._refilled = context.ContextCache(), 0, set()
        self.files = (files.files(spark, root) if files else repo.scan(spark, root)).persist()
        captures = checkpointed(extract.extract(self.files))
        self.errors = captures.where("error is not null").select("file_id", "error")
        good = captures.where("error is null").withColumn("lang", F.lower("lang"))
        self.graph = scope.build_scope_graph(good, symbol_kinds(spark), keep=checkpointed)
        self.nodes, self.edges = checkpointed(self.graph.nodes), checkpointed(self.graph.edges)
        self._recorded: dict[str, list[str]] = {}

    def names(self, *names: str) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in names], "name string")

    def goto_definition(self, *names: str, strict: bool = True) -> DataFrame:
        return navigation.goto_definition(self.nodes, self.files, self.names(*names), strict)

    def find_references(self, *names: str, most: int = 100) -> DataFrame:
        return navigation.find_references(self.nodes, self.files, self.names(*names), most)

    def definition_at(self, path: str, line: int, col: int) -> DataFrame:
        mine = F.col("file_id") == path
        return navigation.definition_at(self.nodes.where(mine), self.edges.where(mine), line, col)

    def symbol_context(self, locations: DataFrame) -> DataFrame:
        return navigation.symbol_context(locations, self.files)

    def retrieve_symbol(self, name: str, top_k: int = 10) -> DataFrame:
        return self.retrieve(context.symbol_query(name), top_k)

    def retrieve(self, query: dict, top_k: int = 10) -> DataFrame:
        """Chunks for a query of any kind (:func:`context.symbol_query` and its like), from the cache if it was asked before."""

        def make() -> DataFrame:
            names = [query["name"]] if query["type"] == "symbol" else [query["base_symbol"]] if query["type"] == "related" else query.get("symbols") or []
            named = self.names(*names)
            found = navigation.goto_definition(self.nodes, self.files, named), navigation.find_references(self.nodes, self.files, named)
            return self._held(context.retrieve(context.queries(self.spark, query), *found, self.files, top_k, (query["type"],)))

        return self.cache.get(query, top_k, make)

    def refine(self, chunks: DataFrame) -> DataFrame:
        return context.refine(chunks, ["query_id"], self.budget.max_context_tokens)

    def refill(self, answer: str, rounds: int = 3) -> list[str]:
        """Chunks, up to five a symbol, for all symbols that an answer lacks and that were not refilled before.

        At most ``rounds`` answers of an engine are served; see :meth:`new_conversation`.
        """
        if self._refills >= rounds:
            return []
        new = [s for s in missing_in(answer) if s not in self._refilled]
        out = []
        for name in new:
            out += [r["content"] for r in self.refine(self.retrieve(context.symbol_query(name), 5)).orderBy(F.desc("relevance"), "ord").collect()]
        self._refilled.update(new)
        self._refills += bool(new)
        return out

    def new_conversation(self) -> None:
        self._refills, self._refilled = 0, set()

    def supplement(self, chunks: DataFrame, wanted: list[str]) -> DataFrame:
        """The best chunk of each wanted symbol that no signature of the refined chunks contains."""
        asked = self.names(*wanted).select(F.lit("0").alias("query_id"), "name")
        names = [r["name"] for r in context.missing_from(asked, chunks).collect()]
        queries = context.queries(self.spark, *(context.symbol_query(n) for n in names))
        named = self.names(*names)
        found = navigation.goto_definition(self.nodes, self.files, named), navigation.find_references(self.nodes, self.files, named)
        return context.refine(self._held(context.retrieve(queries, *found, self.files, 1, ("symbol",))), ["query_id"], self.budget.max_context_tokens)

    def _held(self, chunks: DataFrame) -> DataFrame:
        """The chunks as rows of the driver, ``top_k`` for each query, so that plans over them are small."""
        return self.spark.createDataFrame(chunks.collect(), chunks.schema)

    def task_context(self, task: Row) -> str:
        """The prompt's context for a task: its identifiers and paths, ten chunks refined.

        A path without chunks gives its first 50 lines; without any, symbols are at least named; a task that has neither
        has no context.
        """
        kinds = {k: [e["value"] for e in task["entities"] if e["kind"] == k] for k in ("Identifier", "Path")}
        if not kinds["Identifier"] and not kinds["Path"]:
            return ""
        chunks = self.refine(self.retrieve(context.task_query([task["raw_input"]], kinds["Path"], kinds["Identifier"]), 10))
        named = self.files.select("file_id", "rel_path")
        none = F.array().cast("array<string>")
        block = context.chunk_text(F.coalesce("rel_path", F.lit("?")), F.col("ord"), F.col("ord"), F.coalesce("symbol_signatures", none), F.col("content"))
        row = context.prompt(chunks.join(named, "file_id", "left").withColumn("block", block), ["query_id"]).first()
        if row is not None:
            return row["prompt"]
        heads = [(p, self._content(p)) for p in kinds["Path"]]
        shown = [f"// File: {p}\n" + "\n".join(c.splitlines()[:50]) for p, c in heads if c is not None]
        return "\n".join(shown) or (f"// Task mentions symbols: {', '.join(kinds['Identifier'])}" if kinds["Identifier"] else "")

    def answer(self, request: str, explain: bool = False) -> str:
        """Up to three identifiers: place, snippet, other candidates and references of each."""
        df = self.spark.createDataFrame([(request,)], "t string").select(text.identifiers_dedup(F.col("t")).alias("n"), text.file_position(F.col("t")).alias("p"))
        row = df.first()
        if row["p"] is not None:
            return self._answer_position(row["p"], explain)
        names = row["n"][:3]
        head = self.spark.createDataFrame([(names,)], "n array<string>").select(render.found_header(F.col("n"))).first()[0]
        if not names:
            return head + render.NO_IDENTIFIER
        return head + "\n".join(self._answer_name(n, explain) for n in names)

    def _answer_name(self, name: str, explain: bool) -> str:
        found = self.goto_definition(name).persist()
        primary = found.where("rank = 1")
        if primary.isEmpty():
            return render.NOT_FOUND + "\n"
        refs = navigation.references_minus_definitions(self.find_references(name, most=30), found)
        place = lambda p, n: F.struct(F.col(p).alias("path"), F.col(n).alias("line"))
        others = found.where("rank > 1").orderBy("rank").limit(5).agg(F.sort_array(F.collect_list(F.struct("rank", place("rel_path", "start_line").alias("p")))).alias("o")).select(F.transform("o", lambda x: x["p"]).alias("others"))
        uses = refs.orderBy("seq").limit(10).agg(F.sort_array(F.collect_list(F.struct("seq", place("file_id", "start_line").alias("p")))).alias("o")).select(F.transform("o", lambda x: x["p"]).alias("uses"))
        row = self.symbol_context(primary).crossJoin(others).crossJoin(uses)  # one row each
        block = render.result_block(F.lit(name), F.col("rel_path"), F.col("start_line"), F.col("signature"), F.col("snippet"), F.col("others"), F.col("uses"), explain)
        return row.select(block).first()[0]

    def _answer_position(self, at: Row, explain: bool) -> str:
        path = at["path"]
        if os.path.isabs(path):
            inside = os.path.relpath(path, self.root)
            if inside == ".." or inside.startswith("../"):
                return render.NOT_UNDER_ROOT.format(path, self.root)
            path = inside
        hit = self.definition_at(path, at["line"], at["col"]).where("rank = 1").first()
        return self._answer_name(hit["name"], explain) if hit else render.NOT_FOUND

    def plan(self, request: str) -> tuple[Row, list[Row]]:
        t = F.col("task")
        row = self.spark.createDataFrame([(request,)], "t string").select(tasks.task(F.col("t")).alias("task")).select(t, tasks.rule_plan(t).alias("plan")).first()
        steps = row["plan"]["steps"]
        if row["task"]["task_type"] != "Terminal" and self.prefer_client:
            steps = self.ask_plan(request, self.task_context(row["task"])) or steps
        return row["task"], steps

    def ask_plan(self, request: str, known: str = "") -> list[Row] | None:
        """A plan from the completion service, which is told what is known: one request, one repair, then none."""
        system, user = "Answer with a JSON plan: {steps, estimated_tokens}.", f"{known}\n{request}" if known else request
        for _ in range(2):
            try:
                said = self.client.complete(system, user)
            except (RuntimeError, OSError):
                return None
            parsed = self.spark.createDataFrame([(said,)], "s string").select(tasks.parse_plan(F.col("s")).alias("p"))
            row = parsed.select("p", tasks.plan_error(F.col("p.steps"), self.budget.max_steps).alias("e")).first()
            if row["p"] is not None and row["e"] is None:
                return row["p"]["steps"]
            user = f"{request}\n\nThis is not a valid plan, repair it: {said[:500]}"
        return None

    def run_turn(self, request: str, session_id: str = "local") -> Turn:
        """Gate, task, plan, steps until the first that fails, review. Edits change the engine's table of files only."""
        self.recorder.run_started(session_id, request)
        turn = self._turn(request, session_id)
        self._emit(session_id, {"event": "reviewed", "ok": turn.review == "Success"})
        self.recorder.run_ended(session_id, turn.review)
        session = self.store.get(session_id)
        if session is not None:
            session.push("user", request)
            session.push("assistant", turn.output)
            self.store.save(session)
        return turn

    def _emit(self, session_id: str, event: dict) -> None:
        self.sink.emit(event)
        self.recorder.event(session_id, event)

    def _turn(self, request: str, session_id: str) -> Turn:
        if len(request) > self.budget.max_input_chars:
            return Turn("rejected", TOO_LONG.format(self.budget.max_input_chars), "NeedsRevision")
        task, steps = self.plan(request)
        self._emit(session_id, {"event": "classified", "task": task["task_type"]})
        self._emit(session_id, {"event": "planned", "steps": len(steps)})
        out, events, first, reason = [], [], {}, None
        for i, s in enumerate(steps[: self.budget.max_steps]):
            label = f"tool:{s['tool']}" if s["kind"] == "tool_call" else s["kind"]
            self._emit(session_id, {"event": "step started", "step": i, "label": label})
            ok, said = self._step(s, session_id, first)
            self._emit(session_id, {"event": "step completed", "step": i, "ok": ok})
            events.append({"label": label, "ok": ok, "reward": 0.2 if ok else -0.5})
            self.recorder.step({"session_id": session_id, "action": label, "reward": events[-1]["reward"], "outcome": said[:500]})
            out.append(said if len(said.encode()) <= 500 or s["kind"] == "intelligence" else said.encode()[:500].decode(errors="ignore") + "...")
            if not ok:
                reason = said
                break
        if reason is None:
            return Turn(task["task_type"], "\n".join(out), "Success", events)
        if first:
            for path, content in first.items():
                self._write(path, content)
            return Turn(task["task_type"], "rolled back", "NeedsRollback", events)
        return Turn(task["task_type"], reason, "NeedsRevision", events)

    def _allowed(self, session: str, kind: str, payload: dict) -> str | None:
        """What forbids an action, or null; allowed actions are recorded."""
        if self.guard is not None:
            return self.guard.check(session, kind, payload)
        if kind == "Terminal":
            bad = self.spark.createDataFrame([(payload["cmd"],)], "c string").select(tasks.dangerous_command(F.col("c"))).first()[0]
            if bad:
                return DANGEROUS.format(bad)
        digest, recent = f"{kind}:{json.dumps(payload, sort_keys=True)}", self._recorded.setdefault(session, [])
        again = kind == "EditFile" and digest in recent
        self._recorded[session] = [*recent, digest][-self.history :]
        return REPEATED if again else None

    def _content(self, path: str) -> str | None:
        row = self.files.where(F.col("rel_path") == path).select("content").first()
        return row[0] if row else None

    def _write(self, path: str, content: str) -> None:
        new = self.spark.createDataFrame([(path, content)], "_p string, _c string")
        self.files = self.files.join(F.broadcast(new), F.col("rel_path") == F.col("_p"), "left").withColumn("content", F.coalesce("_c", "content")).drop("_p", "_c")
        self.cache.clear()

    def _step(self, s: Row, session: str, first: dict[str, str]) -> tuple[bool, str]:
        kind, tool = s["kind"], s["tool"]
        if kind == "tool_call" and tool in self.tools:
            return self.tools[tool].run(s)
        if kind == "echo" or kind == "think":
            return True, s["text"] or ""
        if kind == "intelligence":
            said = self.answer(s["query"], explain=(s["style"] or "") == "Explain")
            return True, said
        if kind == "verify" or tool == "run_terminal":
            forbidden = self._allowed(session, "Terminal", {"cmd": s["cmd"] or ""})
            return False, forbidden or "commands are not run by this library"
        content = self._content(s["path"] or "")
        if content is None:
            return False, f"no such file: {s['path']}"
        if tool == "read_file":
            return True, content.encode()[: self.budget.max_io_bytes].decode(errors="replace")
        if tool == "edit_file":
            if s["line_1"] is None or s["new_line"] is None:
                return False, "edit_file needs line_1 and new_line"
            forbidden = self._allowed(session, "EditFile", {"path": s["path"], "line_1": s["line_1"], "new_line": s["new_line"]})
            if forbidden:
                return False, forbidden
            one = self.spark.createDataFrame([(content,)], "c string")
            new = one.select(text.replace_lines(F.col("c"), F.lit(s["line_1"]).cast("int"), F.lit(s["line_1"]).cast("int"), F.lit(s["new_line"]))).first()[0]
            if new is None:
                return False, f"line {s['line_1']} is out of range"
            first.setdefault(s["path"], content)
            self._write(s["path"], new)
            return True, f"edited {s['path']}"
        return False, f"unknown tool: {tool}"
