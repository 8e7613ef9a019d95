"""Edge lists of scope graphs over synthetic intervals: one byte is one line."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sorrel.operators import scope

SCHEMA = "file_id string, capture string, capture_ix int, ord int, start_byte int, end_byte int, start_line int, start_col int, end_line int, end_col int, text string, ns_idx int, sym_idx int"


def captures(spark, rows, root=(0, 20), file_id="f"):
    out = [(file_id, "root", -1, 0, *root, root[0], 0, root[1], 0, None, None, None)]
    for i, (capture, a, b, *rest) in enumerate(rows):
        name, ns = (rest + [None, None])[:2]
        out.append((file_id, capture, 0 if "scope" in capture else 1, i + 1, a, b, a, 0, b, 0, name, ns, 0 if ns is not None else None))
    return spark.createDataFrame(out, SCHEMA)


def edges(spark, rows, **kw):
    g = scope.build_scope_graph(captures(spark, rows, **kw))
    at = {r.node_ix: (r.start_byte, r.end_byte) for r in g.nodes.collect()}
    return sorted((at[e.src_ix], e.kind, at[e.dst_ix]) for e in g.edges.collect())


def test_nested_scopes(spark):
    rows = [("local.scope", *r) for r in ((0, 10), (0, 5), (6, 10), (11, 20), (11, 15), (16, 20))]
    got = edges(spark, rows)
    assert got == sorted(((a, "ScopeToScope", b) for a, b in (((0, 10), (0, 20)), ((0, 5), (0, 10)), ((6, 10), (0, 10)), ((11, 20), (0, 20)), ((11, 15), (11, 20)), ((16, 20), (11, 20)))))


def test_local_and_hoisted_definitions(spark):
    got = edges(spark, [("local.scope", 0, 10), ("hoist.definition", 1, 2, "a"), ("local.definition", 4, 5, "b")])
    assert ((1, 2), "DefToScope", (0, 20)) in got and ((4, 5), "DefToScope", (0, 10)) in got
    assert ((1, 2), "DefToScope", (0, 20)) in edges(spark, [("hoist.definition", 1, 2, "a")])


def test_simple_reference_and_unresolved(spark):
    got = edges(spark, [("local.definition", 0, 3, "x"), ("local.reference", 5, 8, "x"), ("local.reference", 9, 10, "y")])
    assert ((5, 8), "RefToDef", (0, 3)) in got and not any(e[0] == (9, 10) for e in got)


def test_namespaces(spark):
    rows = [("local.definition.a", 3, 6, "n", 0), ("local.definition.b", 17, 20, "n", 1), ("local.reference.a", 22, 25, "n", 0), ("local.reference.b", 29, 32, "n", 1), ("local.reference", 42, 45, "n")]
    got = [e for e in edges(spark, rows, root=(0, 50)) if e[1] == "RefToDef"]
    assert got == [((22, 25), "RefToDef", (3, 6)), ((29, 32), "RefToDef", (17, 20)), ((42, 45), "RefToDef", (3, 6)), ((42, 45), "RefToDef", (17, 20))]


def test_imports_globals_and_ranges_outside(spark):
    rows = [("local.scope", 2, 10), ("local.import", 3, 4, "i"), ("global.definition", 5, 6, "g"), ("local.reference", 7, 8, "i"), ("local.definition", 30, 31, "o"), ("global.definition", 32, 33, "p")]
    got = edges(spark, rows)
    assert ((7, 8), "RefToImport", (3, 4)) in got and ((5, 6), "DefToScope", (0, 20)) in got
    assert not any(e[0] == (30, 31) for e in got) and ((32, 33), "DefToScope", (0, 20)) in got


def test_no_shadowing_and_listing_order(spark):
    rows = [("local.scope", 2, 18), ("local.definition", 1, 2, "x"), ("local.definition", 3, 4, "x"), ("local.reference", 6, 7, "x")]
    g = scope.build_scope_graph(captures(spark, rows))
    at = {r.node_ix: r.start_byte for r in g.nodes.collect()}
    listed = [(r.rank, at[r.dst_ix]) for r in scope.definitions_of(g).orderBy("rank").collect()]
    assert listed == [(1, 1), (2, 3)]


def test_equal_ranges_nest_in_order_and_hover(spark):
    got = edges(spark, [("local.scope", 2, 9), ("local.scope", 2, 9)])
    assert ((2, 9), "ScopeToScope", (0, 20)) in got and ((2, 9), "ScopeToScope", (2, 9)) in got
    g = scope.build_scope_graph(captures(spark, [("local.definition", 4, 5, "a"), ("local.reference", 11, 12, "a")]))
    assert sorted((r.start_byte, r.end_byte) for r in scope.hoverable_ranges(g.nodes).collect()) == [(4, 5), (11, 12)]


def test_lookups(spark):
    g = scope.build_scope_graph(captures(spark, [("local.scope", 4, 15), ("hoist.definition.function", 4, 5, "f"), ("local.definition.variable", 6, 7, "v"), ("local.reference", 8, 9, "v")]))
    assert {(r.name, r.symbol) for r in scope.symbols(g.nodes).collect()} == {("f", "function"), ("v", "variable")}
    assert scope.count_kinds(g.nodes).first().asDict() == {"file_id": "f", "scopes": 2, "defs": 2, "refs": 1, "imports": 0}
    from pyspark.sql import functions as F

    hit = scope.node_at_range(g.nodes, F.lit(6), F.lit(7)).join(g.nodes, ["file_id", "node_ix"]).first()
    assert hit["name"] == "v"
    values = {r.node_ix: r.value_ix for r in scope.value_of_definition(g.nodes).collect()}
    names = {r.node_ix: r.name for r in g.nodes.where("kind = 'definition'").collect()}
    assert [values[k] for k, n in names.items() if n == "f"] == [1]
    assert scope.debug_tree(g).count() == 2


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.data())
def test_sweep_equals_join(spark, data):
    """Random nesting scopes: both ways to find the innermost scope agree, and every scope but the root has one parent."""
    rows, todo = [], [(0, 64)]
    while todo and len(rows) < 12:
        a, b = todo.pop(0)
        if b - a < 4:
            continue
        mid = data.draw(st.integers(a + 1, b - 1))
        for r in ((a, mid), (mid, b)):
            if data.draw(st.booleans()):
                rows.append(("local.scope", *r))
                todo.append(r)
    points = [("local.definition", p, p + 1, f"n{p}") for p in data.draw(st.lists(st.integers(0, 63), max_size=8, unique=True))]
    # rows that are empty, reach over the ends of scopes or begin where a scope ends
    points += [("local.definition", a, a + n, f"w{a}") for a, n in data.draw(st.lists(st.tuples(st.integers(0, 60), st.sampled_from([0, 3, 9, 40])), max_size=6, unique_by=lambda x: x[0]))]
    c = captures(spark, [*rows, *points], root=(0, 64))
    one, two = scope.build_scope_graph(c, strategy="join"), scope.build_scope_graph(c)
    pick = lambda g: sorted((e.src_ix, e.dst_ix, e.kind) for e in g.edges.where("kind <> 'ScopeToScope'").collect())
    assert pick(one) == pick(two)
    up = [e.src_ix for e in one.edges.where("kind = 'ScopeToScope'").collect()]
    assert len(up) == len(set(up)) == len(rows)


def test_one_file_of_very_many_scopes(spark):
    """A million rows in one file, half a million of them under as many scopes: two sorts, no pairs."""
    from pyspark.sql import functions as F

    n = 250_000
    ids = spark.range(n)
    scopes = ids.select(F.lit("f").alias("s_file"), F.col("id").cast("int").alias("s_ix"), (F.col("id") * 10).alias("s_s"), (F.col("id") * 10 + 9).alias("s_e"))
    inner = ids.select(F.lit("f").alias("s_file"), (F.col("id") + n).cast("int").alias("s_ix"), (F.col("id") * 10 + 2).alias("s_s"), (F.col("id") * 10 + 6).alias("s_e"))
    rows = spark.range(2 * n).select(F.lit("f").alias("file_id"), (F.col("id") + 2 * n).cast("int").alias("node_ix"), (F.col("id") * 5 + F.col("id") % 2).alias("start_byte"), (F.col("id") * 5 + F.col("id") % 2 + 1).alias("end_byte"))
    got = scope.innermost_sweep(rows, scopes.unionByName(inner))
    k = F.floor((F.col("node_ix") - 2 * n) / 2)
    at = F.col("start_byte") % 10
    want = F.when(at.between(2, 5), k + n).otherwise(k)
    assert got.count() == 2 * n and got.where(F.col("scope_ix") != want).count() == 0


@pytest.mark.parametrize("text", ["", "def f(:\n"])
def test_files_without_captures(spark, text):
    from sorrel.operators import extract

    rows = extract.captures_of("a", "python", text)
    assert len(rows) == 1 and rows[0][2] == ("root" if text == "" else "error")


def test_all_names_and_roots_count(spark):
    from sorrel.operators import navigation

    n = 10_050
    files = spark.createDataFrame([(1, "\n".join(f"é n{i} = n{i}x" for i in range(n)))], "file_id long, content string")
    names = spark.createDataFrame([(f"n{i}",) for i in range(n)], "name string")
    got = navigation.text_occurrences(files, names).collect()
    assert {r.name: (r.line, r.col, r.end_col) for r in got} == {f"n{i}": (i, 3, 4 + len(str(i))) for i in range(n)} and len(got) == n
    roots = spark.createDataFrame([(f"/r{i}",) for i in range(n)] + [("/r7/b",), ("/r7/b/",)], "root string")
    paths = spark.createDataFrame([(f"/r{i}/a",) for i in range(n)] + [("/r7/b",), ("/r7/bc",), ("/x",), (None,), ("/r8",)], "path string")
    found = {r.path: r.root for r in navigation.longest_root(paths, roots).collect()}
    assert found == {f"/r{i}/a": f"/r{i}" for i in range(n)} | {"/r7/b": "/r7/b", "/r7/bc": "/r7", "/x": None, None: None, "/r8": "/r8"}


def test_nodes_make_no_edges(spark):
    """Many uses of one name resolve by the name: counts need no pair of a use and a definition."""
    rows = [("local.definition", 4 * i, 4 * i + 1, "a") for i in range(200)] + [("local.reference", 1000 + 4 * i, 1000 + 4 * i + 1, "a") for i in range(200)] + [("local.reference", 2000, 2001, "b")]
    g = scope.build_scope_graph(captures(spark, rows, root=(0, 3000)))
    assert "edges" not in vars(g)
    r = scope.count_kinds(g.nodes).first()
    assert (r.scopes, r.defs, r.refs) == (1, 200, 200)
    assert g.edges.where("kind = 'RefToDef'").count() == 200 * 200


def test_symbols_say_what_is_top(spark):
    g = scope.build_scope_graph(captures(spark, [("local.scope", 4, 15), ("local.definition.function", 2, 3, "f"), ("local.definition.variable", 6, 7, "v")]))
    assert {(r.name, r.top) for r in scope.symbols(g.nodes).collect()} == {("f", True), ("v", False)}
