"""Requests in free text: intent, task, plan, safety, commands, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, ascii_lower, best_identifier, char_tokens, file_position, identifiers_dedup, trim_all

# Phrases that mark a request, in Chinese as they stand and in English in lower case.
NAVIGATION = ("定义", "哪里", "在哪", "在哪里")
NAVIGATION_EN = ("definition", "defined", "goto", "go to")
EXPLANATION = ("含义", "是什么", "啥", "作用", "解释", "怎么用", "如何用")
EXPLANATION_EN = ("meaning", "what is", "explain")
#: Parts of a command that forbid it, in the order in which they are tried.
DANGEROUS = ("rm -rf /", "mkfs", "dd if=", "shutdown", "reboot", "curl", "wget", "| sh", "|bash", "sudo ")
#: Tools that a plan may name.
TOOLS = ("read_file", "edit_file", "run_terminal")

STEP = "struct<kind:string,tool:string,style:string,path:string,line_1:bigint,new_line:string,cmd:string,query:string,text:string>"


def _any(c: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def intent(c: Column) -> Column:
    """ExplainSymbol before SymbolNavigation before Other."""
    low = ascii_lower(c)
    explain = best_identifier(c).isNotNull() & (_any(c, EXPLANATION) | _any(low, EXPLANATION_EN))
    navigate = _any(c, NAVIGATION) | file_position(c).isNotNull() | _any(low, NAVIGATION_EN)
    return F.when(explain, F.lit("ExplainSymbol")).when(navigate, F.lit("SymbolNavigation")).otherwise(F.lit("Other"))


_EDIT = rf"(?s)^修改(?: |一下){WS}*([^第]*?){WS}*第{WS}*([0-9]+)"


def edit_request(c: Column) -> Column:
    """struct(path, line_1, new_line) of a request to edit a line; new_line is null if it names none. Null if it is none."""
    s = trim_all(c)
    path, line = F.regexp_extract(s, _EDIT, 1), F.regexp_extract(s, _EDIT, 2).try_cast("bigint")
    to = rf"{_EDIT}{WS}*行{WS}*(?:为|成|= ){WS}*(.*)\z"
    new = F.regexp_extract(s, to, 3)
    ok = s.rlike(_EDIT) & (path != "") & (line > 0)
    whole = ok & (new != "")
    least = ok & s.rlike(rf"{_EDIT}.*行")
    return F.when(whole | least, F.struct(path.alias("path"), line.alias("line_1"), F.when(whole, new).alias("new_line")))


def terminal_request(c: Column) -> Column:
    s = trim_all(c)
    cmd = F.regexp_extract(s, rf"(?s)^(?:运行|执行|run) {WS}*(.*)\z", 1)
    return F.when(cmd != "", cmd)


def _entity(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def task(c: Column) -> Column:
    """struct(task_type, raw_input, intent, entities): an edit with text, an edit, a command, or what the intent says."""
    e, cmd, found = edit_request(c), terminal_request(c), intent(c)
    edit = F.array(_entity("Path", e["path"]), _entity("Line", e["line_1"].cast("string")))
    edit = F.when(e["new_line"].isNull(), edit).otherwise(F.concat(edit, F.array(_entity("Identifier", e["new_line"]))))
    names = F.transform(F.slice(identifiers_dedup(c), 1, 8), lambda x: _entity("Identifier", x))
    kind = F.when(e.isNotNull(), F.lit("Edit")).when(cmd.isNotNull(), F.lit("Terminal")).when(found == "SymbolNavigation", F.lit("Query")).when(found == "ExplainSymbol", F.lit("Explain")).otherwise(F.lit("Chat"))
    plain = e.isNotNull() | cmd.isNotNull()
    entities = F.when(e.isNotNull(), edit).when(cmd.isNotNull(), F.array(_entity("Command", cmd))).otherwise(names)
    return F.struct(kind.alias("task_type"), trim_all(c).alias("raw_input"), F.when(plain, F.lit("Other")).otherwise(found).alias("intent"), entities.alias("entities"))


def _first(task_: Column, kind: str) -> Column:
    return F.get(F.filter(task_["entities"], lambda x: x["kind"] == kind), F.lit(0))["value"]


def step(kind: str, **fields: Column) -> Column:
    names = ("tool", "style", "path", "line_1", "new_line", "cmd", "query", "text")
    cols = [fields[n] if n in fields else F.lit(None) for n in names]
    return F.struct(F.lit(kind).alias("kind"), *(c.alias(n) for c, n in zip(cols, names, strict=True))).cast(STEP)


def rule_plan(task_: Column) -> Column:
    """struct(steps, estimated_tokens) by the type of a task."""
    raw, path, cmd = task_["raw_input"], F.coalesce(_first(task_, "Path"), F.lit("")), F.coalesce(_first(task_, "Command"), F.lit(""))
    line, new = _first(task_, "Line").try_cast("bigint"), _first(task_, "Identifier")
    read = step("tool_call", tool=F.lit("read_file"), path=path)
    edit = F.when(
        line.isNotNull() & new.isNotNull(),
        F.array(read, step("tool_call", tool=F.lit("edit_file"), path=path, line_1=line, new_line=new), read),
    ).otherwise(F.array(read, step("tool_call", tool=F.lit("edit_file"), path=path)))
    kind = task_["task_type"]
    steps = (
        F.when(kind == "Query", F.array(step("intelligence", style=F.lit("Navigation"), query=raw)))
        .when(kind == "Explain", F.array(step("intelligence", style=F.lit("Explain"), query=raw)))
        .when(kind == "Edit", edit)
        .when(kind == "Terminal", F.array(step("tool_call", tool=F.lit("run_terminal"), cmd=cmd)))
        .otherwise(F.array(step("echo", text=F.concat(F.lit("received: "), raw))))
    )
    return F.struct(steps.alias("steps"), char_tokens(raw, F.size(steps)).alias("estimated_tokens"))


# What is said of a plan that is not valid.
UNKNOWN_TOOL, EMPTY_COMMAND, EMPTY_QUERY, TOO_MANY = "unknown tool in plan: ", "verify step cmd is empty", "intelligence step query is empty", "planned steps too many: %d > %d"


def plan_error(steps: Column, max_steps: int = 12) -> Column:
    """Why a plan is not valid, or null: too many steps, then the first step that is wrong."""

    def wrong(s: Column) -> Column:
        return (
            F.when((s["kind"] == "tool_call") & ~F.coalesce(s["tool"].isin(*TOOLS), F.lit(False)), F.concat(F.lit(UNKNOWN_TOOL), F.coalesce(s["tool"], F.lit(""))))
            .when((s["kind"] == "verify") & (trim_all(F.coalesce(s["cmd"], F.lit(""))) == ""), F.lit(EMPTY_COMMAND))
            .when((s["kind"] == "intelligence") & (trim_all(F.coalesce(s["query"], F.lit(""))) == ""), F.lit(EMPTY_QUERY))
        )

    first = F.get(F.filter(F.transform(steps, wrong), lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.size(steps) > max_steps, F.format_string(TOO_MANY, F.size(steps), F.lit(max_steps))).otherwise(first)


def step_label(s: Column) -> Column:
    return (
        F.when(s["kind"] == "tool_call", F.concat(F.lit("tool:"), s["tool"]))
        .when(s["kind"] == "intelligence", F.concat(F.lit("intelligence:"), F.lower(s["style"])))
        .otherwise(s["kind"])
    )


PLAN_JSON = "struct<steps:array<struct<kind:string,call:struct<name:string,args:string>,style:string,query:string,cmd:string,text:string>>,estimated_tokens:bigint>"


def parse_plan(c: Column) -> Column:
    """A plan given as JSON, perhaps in a fenced block, as in :func:`rule_plan`; null if it is not one."""
    from .text import extract_json

    found = F.from_json(extract_json(c), PLAN_JSON)

    def as_step(s: Column) -> Column:
        args = s["call"]["args"]
        fields = (
            F.lower(s["kind"]).alias("kind"), s["call"]["name"].alias("tool"), s["style"].alias("style"), F.get_json_object(args, "$.path").alias("path"), F.get_json_object(args, "$.line_1").try_cast("bigint").alias("line_1"),
            F.get_json_object(args, "$.new_line").alias("new_line"), F.coalesce(s["cmd"], F.get_json_object(args, "$.cmd")).alias("cmd"), s["query"].alias("query"), s["text"].alias("text"),
        )
        return F.struct(*fields).cast(STEP)

    return F.when(found["steps"].isNotNull(), F.struct(F.transform(found["steps"], as_step).alias("steps"), found["estimated_tokens"].alias("estimated_tokens")))


def dangerous_command(c: Column) -> Column:
    """The first part that forbids a command, or null."""
    low = ascii_lower(trim_all(c))
    return F.coalesce(*(F.when(low.contains(p), F.lit(p)) for p in DANGEROUS))


def slash_command(c: Column) -> Column:
    """struct(command, session_id) of /sessions or /switch <id>; null for anything else."""
    words = F.split(trim_all(c), rf"{WS}+")
    name, arg = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    return F.when(name == "/sessions", F.struct(F.lit("sessions").alias("command"), F.lit(None).cast("string").alias("session_id"))).when((name == "/switch") & arg.isNotNull(), F.struct(F.lit("switch").alias("command"), arg.alias("session_id")))


def step_reward(ok: Column) -> Column:
    return F.when(ok, F.lit(0.2)).otherwise(F.lit(-0.5))


def review(failed: Column, edited: Column) -> Column:
    return F.when(failed & edited, F.lit("NeedsRollback")).when(failed, F.lit("NeedsRevision")).otherwise(F.lit("Success"))
