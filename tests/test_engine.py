"""A small tree from scan to answers."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from sorrel.operators import context, extract, navigation, scope
from sorrel.operators.extract import captures_of
from sorrel.plans import surface
from sorrel.plans.completion import Disabled, Http, Mock, Static
from sorrel.plans.engine import Engine
from sorrel.sources import repo

PY = "import os\n\n\ndef helper(a, b=1):\n    total = a + b\n    return total\n\n\ndef main():\n    x = helper(1)\n    return helper(x, os.sep)\n\n\nclass Box:\n    size = 3\n"
RS = "/// A point.\npub struct Point { x: i32 }\n\npub fn make_point(\n    x: i32,\n) -> Point {\n    let p = Point { x };\n    p\n}\n\nfn user() { make_point(3); }\n"
CC = "class Shape {\npublic:\n  int area() { return side; }\n  int side;\n};\nint run() { Shape s; return s.area(); }\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "src").mkdir()
    (root / "src/app.py").write_text(PY)
    (root / "src/lib.rs").write_text(RS)
    (root / "src/a.cc").write_text(CC)
    (root / "__init__.py").write_text("")
    (root / ".hidden").mkdir()
    (root / ".hidden/x.py").write_text("y = 1\n")
    (root / "target").mkdir()
    (root / "target/x.rs").write_text("fn no() {}")
    (root / "notes.txt").write_text("no")
    (root / "big.py").write_text("#" * 500_001)
    (root / "bad.py").write_bytes(b"\xff\xfe")
    (root / "x.proto").write_text("message M {}\n")
    (root / "link.py").symlink_to(root / "src/app.py")
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, tree):
    return Engine(spark, tree)


def test_scan(spark, tree):
    found = repo.scan(spark, tree)
    assert [r.rel_path for r in found.orderBy("scan_ord").collect()] == ["__init__.py", "x.proto", ".hidden/x.py", "src/a.cc", "src/app.py", "src/lib.rs"]
    assert repo.scan(spark, tree, extensions="proto").count() == 1
    with pytest.raises(Exception):
        repo.list_tree(tree + "/none")


def test_filters_on_names_open_no_other_file(spark, tree, tmp_path):
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(tree, copy, symlinks=True)
    every = {r.rel_path: r for r in repo.scan(spark, str(copy)).collect()}
    reader = repo._Reader({"path": str(copy)})
    assert [f for f in reader.pushFilters([EqualTo(("ext",), "rs"), EqualTo(("content",), "x")])] == [EqualTo(("content",), "x")]
    assert [r[1] for p in reader.partitions() for r in p.rows] == ["src/lib.rs"]
    size = every["src/app.py"].size
    for condition in ("ext = 'rs'", "ext in ('cc', 'rs')", "rel_path like 'src/%'", f"size > {size}", f"size >= {size} and ext = 'py'", f"size < {size} and size <= {size}", "content like '%Point%' and ext = 'rs'", "ext = 'none'", "scan_ord = 1"):
        want = sorted(r.rel_path for r in spark.createDataFrame(list(every.values())).where(condition).collect())
        assert sorted(r.rel_path for r in repo.scan(spark, str(copy)).where(condition).collect()) == want, condition
    rust = repo.scan(spark, str(copy)).where("ext = 'rs'")
    (copy / "src/app.py").unlink()
    (copy / "src/app.py").mkdir()  # opening it as a file would fail, and it would be missing
    assert rust.count() == 1


def test_python_golden(spark):
    src = "def one(a, b=2):\n    c = a + b\n    return c\n\ndef two(d):\n    return one(d)\n\none(1)\ntwo(2)\n"
    g = scope.build_scope_graph(spark.createDataFrame(extract.captures_of("f", "python", src), extract.CAPTURES))
    nodes = {r.node_ix: r for r in g.nodes.collect()}
    refs = {}
    for e in scope.references_of(g).collect():
        refs.setdefault(nodes[e.node_ix].name, []).append(e.ref_ix)
    assert len(refs["one"]) == 2 and len(refs["two"]) == 1
    own = {n.name: n for n in nodes.values() if n.kind == "definition"}
    root = own["one"].root_ix
    assert own["one"].scope_ix == own["two"].scope_ix == root and own["a"].scope_ix != root
    assert own["c"].scope_ix != own["a"].scope_ix


def test_definitions_and_references(engine):
    d = engine.goto_definition("helper").collect()
    assert [(r.rel_path, r.start_line, r["rank"]) for r in d] == [("src/app.py", 3, 1)]
    assert engine.goto_definition("make_point").first().start_line == 3
    assert engine.goto_definition("Shape").first().kind == "class"
    refs = engine.find_references("helper")
    semantic = [(r.file_id, r.start_line) for r in refs.orderBy("seq").collect()]
    assert semantic == [("src/app.py", 9), ("src/app.py", 10)]
    at = engine.definition_at("src/app.py", 9, 9).first()
    assert at["name"] == "helper" and at["start_line"] == 3
    assert engine.errors.where("file_id = 'x.proto'").first()["error"] == extract.UNSUPPORTED


def test_signature_and_snippet(engine):
    c = engine.symbol_context(engine.goto_definition("make_point")).first()
    assert c["signature"] == "pub fn make_point(\n    x: i32,\n) -> Point" and "   4 pub fn make_point(" in c["snippet"]


def test_retrieval(engine):
    chunks = engine.refine(engine.retrieve_symbol("helper"))
    kinds = [r.chunk_type for r in chunks.orderBy(F.desc("relevance"), "ord").collect()]
    assert kinds == ["symbol_definition", "symbol_reference", "symbol_reference"]
    first = engine.refill("I don't see the implementation of helper")
    assert first and engine.refill("helper is not defined") == []  # refilled before
    engine.new_conversation()
    assert engine.refill("helper is not defined") == first
    assert [bool(engine.refill(f"{x} is not defined")) for x in ("Box", "run", "helper")] == [True, True, False]  # three answers in all
    none = chunks.where("false")
    assert engine.supplement(chunks, ["helper"]).count() == 0 and engine.supplement(none, ["helper", "Box"]).count() == 2
    assert [r.symbol_signatures for r in chunks.where("chunk_type = 'symbol_definition'").collect()] == [["helper", "def helper(a, b=1):"]]


def test_all_kinds_of_queries(spark, engine):
    names = engine.names("helper", "Box")
    found = engine.goto_definition("helper", "Box"), engine.find_references("helper", "Box")
    asked = [context.symbol_query("helper"), context.position_query("src/app.py", 4), context.file_query("src/app.py"), context.concept_query("boxes"), context.task_query(["x"], ["src/app.py"], ["helper", "Box", "helper"]), context.related_query("helper")]
    got = context.retrieve(context.queries(spark, *asked), *found, engine.files, 10).collect()
    kinds = {i: [r.chunk_type for r in sorted(got, key=lambda r: r.ord) if r.query_id == str(i)] for i in range(6)}
    assert kinds[0] == ["symbol_definition", "symbol_reference", "symbol_reference"] and kinds[1][0] == "code_block" and kinds[2] == ["file_summary"]
    assert kinds[3] == [] and kinds[4][0] == "symbol_definition" and kinds[4][-1] == "file_summary" and kinds[5] == ["symbol_reference"] * 2
    alone = {i: [r.content for r in engine.retrieve(q, 10).orderBy("ord").collect()] for i, q in enumerate(asked)}
    assert alone == {i: [r.content for r in sorted(got, key=lambda r: r.ord) if r.query_id == str(i)] for i in range(6)} and names.count() == 2
    before = engine.cache.stats()["hits"]
    engine.retrieve(asked[0], 10)
    assert engine.cache.stats()["hits"] == before + 1 and engine.cache.by_symbol("helper").count() >= 1 and engine.cache.by_file("src/app.py").count() >= 1


def test_cache_evicts_the_worse_half(spark):
    at, cache = iter(range(1000)), None
    cache = context.ContextCache(4, clock=lambda: next(at))
    one = spark.range(1)
    for name in ("a", "b", "c", "d"):
        cache.get(name, 1, lambda: one)
    for _ in range(5):
        cache.get("b", 1, lambda: one)
    cache.get("e", 1, lambda: one)
    assert {k[0] for k in cache._frames} == {"b", "d", "e"}


def test_long_signatures(engine, spark):
    text = "fn long(\n" + "".join(f"    a{i}: u8,\n" for i in range(100)) + ") -> u8 {\n}\n"
    (got,) = spark.createDataFrame([(text,)], "c string").select(navigation.signature(F.col("c"), F.lit(0))).first()
    assert got.startswith("fn long(") and got.endswith(") -> u8") and got.count("\n") == 101
    many = "int f(" + ", ".join(f"int a{i}" for i in range(300)) + ") { return g(1); }\n"
    rows = captures_of("f", "C", many)
    assert any(r[2].startswith("hoist.definition") and r[11] == "f" for r in rows)


def test_slow_files_are_given_up(monkeypatch):
    from sorrel.operators import extract

    monkeypatch.setattr(extract, "MAX_SECONDS", -1.0)
    assert [r[-1] for r in captures_of("f", "Python", "a = 1\n")] == ["ParseTimeout"] == [r[-1] for r in captures_of("f", "Rust", "fn a() {}\n")]


def test_places_in_text_that_is_not_ascii():
    rows = captures_of("f", "Rust", "// é😀\nfn größe(ä: u8) {}\nfn b() { größe(1) }\n")
    data = "// é😀\nfn größe(ä: u8) {}\nfn b() { größe(1) }\n".encode()
    assert all(data[r[5] : r[8]].decode() == r[11] for r in rows if r[11]) and sum(r[11] == "größe" for r in rows) == 2


class Loud:
    def run(self, step):
        return True, f"read {step['path']} aloud"


class Never:
    def check(self, session_id, kind, payload):
        return "never"


def test_turns_with_stores_recorders_and_parts(spark, tree, tmp_path):
    plan = '{"steps":[{"kind":"tool_call","call":{"name":"read_file","args":{"path":"src/app.py"}}}],"estimated_tokens":3}'
    store, sink = surface.LogStore(spark, str(tmp_path / "log")), surface.ListSink()
    e = Engine(spark, tree, client=Mock([plan]), tools={"read_file": Loud()}, store=store, sink=sink, recorder=surface.LogRecorder(spark, str(tmp_path / "runs")))
    s = store.create("mine")
    assert e.run_turn("explain helper in src/app.py", s.id).output == "read src/app.py aloud"
    (_, asked), = e.client.asked
    assert "## Relevant Code Context" in asked and "def helper(a, b=1):" in asked and asked.endswith("explain helper in src/app.py")
    assert [m.role for m in store.get(s.id).messages] == ["user", "assistant"] and store.list()[0].message_count == 2
    assert [x["event"] for x in sink.snapshot()] == ["classified", "planned", "step started", "step completed", "reviewed"]
    lines = [json.loads(r.value) for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "runs")).collect()]
    assert sum(x.get("type") == "event" for x in lines) == 5 and [x["reward"] for x in lines if "reward" in x] == [0.2]
    plain = Engine(spark, tree, client=Mock([plan]), prefer_client=False, guard=Never())
    assert plain.run_turn("hello").output == "received: hello" and plain.run_turn("run cargo test").output == "never"
    assert plain.task_context(plain.plan("where is nowhere_at_all defined?")[0]).startswith("// Task mentions symbols: ")


def test_turns(engine):
    said = engine.run_turn("where is helper defined?")
    assert said.review == "Success" and "✅ Found in src/app.py:4" in said.output and "Referenced by" in said.output
    assert "Definition not found" in engine.run_turn("where is nothing_here defined?").output
    assert engine.run_turn("hello").output == "received: hello"
    assert engine.run_turn("run rm -rf / now").review == "NeedsRevision"
    assert engine.run_turn("x" * 40_000).task == "rejected"
    edit = engine.run_turn("修改 src/app.py 第 15 行 为     size = 4")
    assert edit.review == "Success" and engine._content("src/app.py").endswith("size = 4\n")
    again = engine.run_turn("修改 src/app.py 第 15 行 为     size = 4")
    assert again.review == "NeedsRevision"
    assert engine.run_turn("修改 src/app.py 第 999 行 为 z").review == "NeedsRevision"


def test_completion_plans(spark, tree):
    good = '```json\n{"steps":[{"kind":"think","text":"hm"},{"kind":"echo","text":"done"}],"estimated_tokens":3}\n```'
    e = Engine(spark, tree, client=Mock(["nonsense", good]))
    assert e.run_turn("hello").output == "hm\ndone" and len(e.client.asked) == 2
    assert Engine(spark, tree, client=Mock(["bad", "worse"])).run_turn("hello").output == "received: hello"
    assert Static("x").complete("", "") == "x"
    with pytest.raises(RuntimeError):
        Disabled().complete("", "")
    r = Http("http://h/v1/", "k", "m").request("s", "u")
    assert r.full_url == "http://h/v1/chat/completions" and b'"temperature": 0.3' in r.data


@pytest.mark.parametrize(
    ("lang", "src", "defs", "imports"),
    [
        ("rust", "use std::io::Read;\nfn f(a: i32) { let b = a; g(b); }\nenum E { A }\n", {"f", "a", "b", "E"}, {"Read"}),
        ("go", 'package m\nimport "fmt"\nfunc Run(x int) int {\n y := x\n return y\n}\ntype T struct {}\n', {"Run", "x", "y", "T"}, set()),
        ("javascript", "import { a } from 'm';\nfunction f(x) { const y = x; return a(y); }\nclass K {}\n", {"f", "x", "y", "K"}, {"a"}),
        ("java", "import java.util.List;\nclass A { int f(int x) { return x; } }\n", {"A", "f"}, {"List"}),
        ("c", "int add(int a, int b) { return a + b; }\nstruct S { int x; };\n", {"add", "S"}, set()),
        ("ruby", "class A\n  def go(x)\n    y = x\n  end\nend\n", {"A", "go", "y"}, set()),
        ("r", "f <- function(x) {\n  y <- x\n}\n", {"f", "y"}, set()),
        ("php", "<?php function f($a) { $b = $a; return g($b); }", {"f", "a", "b"}, set()),
    ],
)
def test_lexed_languages(lang, src, defs, imports):
    rows = extract.captures_of("f", lang, src)
    assert rows[0][2] == "root"
    names = {r[11] for r in rows if "definition" in r[2]}
    assert defs <= names, (names, rows)
    assert imports <= {r[11] for r in rows if r[2] == "local.import"}
    assert any(r[2] == "local.scope" for r in rows)


def test_roots_and_homes(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "a/b").mkdir(parents=True)
    assert repo.find_root(str(tmp_path / "a/b")) == str(tmp_path)
    assert repo.home_folder({"HOME": "/h"}) == "/h/.sorrel" and repo.home_folder({"SORREL_HOME": "/x"}) == "/x" and repo.home_folder({}) is None
