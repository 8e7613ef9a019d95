"""Scalar functions on small inputs."""

import pytest
from pyspark.sql import functions as F

from sorrel.functions import languages, missing, render, tasks, text
from sorrel.operators import context, navigation


@pytest.fixture(scope="module")
def one(spark):
    return lambda value, f: spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(("value", "want"), [("", []), ("a\nb\n", ["a", "b"]), ("a\r\nb", ["a", "b"]), ("\n", [""]), ("a\n\n", ["a", ""])])
def test_lines(one, value, want):
    assert one(value, text.lines) == want


def test_tokens(one):
    assert [one("a" * n, text.byte_tokens) for n in (4, 10, 400)] == [1, 3, 100]
    assert one("é" * 4, text.byte_tokens) == 2 and one("é" * 4, lambda c: text.char_tokens(c, F.lit(2))) == 61


def test_identifiers(one):
    assert one("a b1 a _x é9", text.identifiers_dedup) == ["a", "b1", "_x"]
    assert one("foo snake_case longest_one", text.best_identifier) == "snake_case"
    assert one("ab cd", text.best_identifier) == "cd" and one("12", text.best_identifier) is None


@pytest.mark.parametrize(("value", "want"), [("see (src/a.rs:12:3), ok", ("src/a.rs", 11, 2)), ("lib.rs:7", ("lib.rs", 6, 0)), ("x:0", None), ("a:b", None), ("c:1:x", ("c", 0, 0)), ("", None)])
def test_file_position(one, value, want):
    got = one(value, text.file_position)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    ("value", "task", "steps"),
    [
        ("修改 src/main.rs 第 10 行 为 let x = 1;", "Edit", ["tool:read_file", "tool:edit_file", "tool:read_file"]),
        ("修改一下 main.rs 第 3 行", "Edit", ["tool:read_file", "tool:edit_file"]),
        ("修改 a.rs 第 0 行 为 z", "Chat", ["echo"]),
        ("run cargo test", "Terminal", ["tool:run_terminal"]),
        ("where is parse_plan defined?", "Query", ["intelligence:navigation"]),
        ("explain FooBar", "Explain", ["intelligence:explain"]),
        ("解释 123", "Chat", ["echo"]),
    ],
)
def test_tasks_and_plans(one, value, task, steps):
    assert one(value, lambda c: tasks.task(c)["task_type"]) == task
    assert one(value, lambda c: F.transform(tasks.rule_plan(tasks.task(c))["steps"], tasks.step_label)) == steps


def test_json_plans(one):
    raw = '{"steps":[{"kind":"tool_call","call":{"name":"edit_file","args":{"path":"p","line_1":2,"new_line":"x"}}}],"estimated_tokens":1}'
    for said in (raw, f"```json\n{raw}\n```", f"```\n{raw}```", f" {raw}"):
        step = one(said, lambda c: tasks.parse_plan(c)["steps"])[0]
        assert (step["tool"], step["path"], step["line_1"], step["new_line"]) == ("edit_file", "p", 2, "x")
    assert one("nothing", tasks.parse_plan) is None
    bad = raw.replace("edit_file", "fly")
    assert one(bad, lambda c: tasks.plan_error(tasks.parse_plan(c)["steps"])) == "unknown tool in plan: fly"


@pytest.mark.parametrize(("value", "want"), [("I don't see the implementation of authenticate_user", ["authenticate_user"]), ("function foo_bar is not defined", ["foo_bar"]), ("can't find the definition of UserRepo", ["UserRepo"]), ("all is well", []), (None, [])])
def test_missing_symbols(one, value, want):
    assert one(value, missing.missing_symbols) == want


def test_safety_and_commands(one):
    assert one("SUDO  ls; sudo x", tasks.dangerous_command) == "sudo " and one("ls", tasks.dangerous_command) is None
    assert one(" /sessions  ", tasks.slash_command)["command"] == "sessions" and one("/switch abc", tasks.slash_command)["session_id"] == "abc"
    assert one("/switch", tasks.slash_command) is None and one("hi", tasks.slash_command) is None


def test_edits(one):
    put = lambda a, b: lambda c: text.replace_lines(c, F.lit(a), F.lit(b), F.lit("N"))
    assert one("a\nb\n", put(2, 2)) == "a\nN\n" and one("a\nb\nc", put(1, 2)) == "N\nc" and one("a", put(2, 2)) is None


def test_truncation(one):
    assert one("ab\ncd\nef", lambda c: context.truncate_to_tokens(c, F.lit(1))) == "ab" and one("éééé", lambda c: context.truncate_to_tokens(c, F.lit(1))) == "éé"
    assert one("é" * 300, lambda c: text.truncate_output(c)).endswith("...")


def test_rendering(one):
    assert one("pub async fn f()", render.symbol_kind) == "function" and one("pub enum E", render.symbol_kind) == "enum"
    assert one("a§b§c§", render.highlight) == "a\x1b[7mb\x1b[0mc\x1b[7m\x1b[0m" and one("a§b", lambda c: render.highlight(c, False)) == "ab"
    doc = "x\n/// one\n/// two\nfn f() {}\n"
    assert one(doc, lambda c: render.doc_comment(c, F.lit("fn f()"))) == "one\ntwo"
    assert one("   1 /// d\n   2 fn f() {", lambda c: render.trim_to_definition(c, F.lit("fn f()"))) == "   1 /// d\n   2 fn f() {"
    assert one("l0\nl1\nl2", lambda c: render.snippet(c, F.lit(1), 1)) == "   1 l0\n   2 l1\n   3 l2"
    assert one("", lambda c: render.found_header(F.array(c, c))).startswith("🤔")


def test_signatures(one):
    sig = lambda n: lambda c: navigation.signature(c, F.lit(n))
    assert one("pub trait T {", sig(0)) == "pub trait T" and one("struct S;", sig(0)) == "struct S" and one("fn f() { 1 }", sig(0)) == "fn f()"
    assert one("let foo_bar = 1", lambda c: navigation.identifier_at(c, F.lit(6))) == "foo_bar" and one("a  b", lambda c: navigation.identifier_at(c, F.lit(2))) is None


def test_occurrences(spark, one):
    assert one("the then the_x the", lambda c: navigation.count_occurrences(c, "the")) == 2
    files = spark.createDataFrame([("f", "é ab\nab_c ab")], "file_id string, content string")
    got = navigation.text_occurrences(files, spark.createDataFrame([("ab",), ("x-y",)], "name string"))
    assert sorted((r.line, r.col, r.end_col) for r in got.collect()) == [(0, 3, 5), (1, 5, 7)]


def test_languages(spark, one):
    assert one("h", languages.navigator_language) == "C++" and one("H", languages.context_language) == "C" and one("zz", languages.context_language) == "Unknown"
    assert one("RUST", languages.language_index) == 4 and one("zz", languages.language_index) is None
    assert languages.symbol_kinds(spark).where("lang = 'go' and kind = 'label'").first()["ns_idx"] == 3


def test_context_laws(spark):
    rows = [("q", i, "x" * 100, "symbol_reference", f"s{i % 40}", 1) for i in range(100)]
    chunks = spark.createDataFrame(rows, "query_id string, ord int, content string, chunk_type string, symbol string, n_symbols int")
    kept = context.refine(chunks, ["query_id"], 500)
    assert kept.agg(F.sum("token_count")).first()[0] <= 500 and kept.count() == 20
    once = context.dedup_by_symbol(chunks, ["query_id"])
    assert once.count() == 40 and context.dedup_by_symbol(once, ["query_id"]).count() == 40
    big = spark.createDataFrame([("q", 0, "x" * 9000, "code_block", None, 0), ("q", 1, "x", "code_block", None, 0)], chunks.schema)
    assert context.refine(big, ["query_id"], 100).count() == 0


def test_missing_from_and_cache(spark):
    wanted = spark.createDataFrame([("q", "foo"), ("q", "bar")], "query_id string, name string")
    have = spark.createDataFrame([("q", ["fn foo()"])], "query_id string, symbol_signatures array<string>")
    assert [r.name for r in context.missing_from(wanted, have).collect()] == ["bar"]
    c = context.ContextCache()
    a, b = c.get("x", 1, lambda: wanted), c.get("x", 1, lambda: have)
    assert a is b and c.get("x", 2, lambda: have) is not a and c.stats()["hits"] == 1
    c.clear()
