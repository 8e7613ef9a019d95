"""Scope graphs as tables: containment, closure and name resolution for all files at once.

A file's captures are rows ``(file_id, capture, capture_ix, ord, start_byte, end_byte, start_line, start_col, end_line,
end_col, text)``; ``capture`` is ``root``, ``local.scope``, ``local.import``, ``{local|hoist|global}.definition[.kind]`` or
``local.reference[.kind]``. The graph is two tables, nodes and edges, keyed by file. Every join has the file as an equi
key, so it is a hash or sort-merge join whose interval test is a residual; nothing is collected. One identifier captured
twice stays two nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = ("start_byte", "end_byte", "start_line", "start_col", "end_line", "end_col")


@dataclass
class ScopeGraph:
    """nodes: file_id, node_ix, kind, range, name, ns_idx, sym_idx, sym_name, hoist, scope_ix, root_ix. edges: file_id, src_ix, dst_ix, kind."""

    nodes: DataFrame
    ancestors: DataFrame
    make_edges: Callable[[], DataFrame]

    @cached_property
    def edges(self) -> DataFrame:
        """Made when first asked for: a name's references times its definitions, which the nodes do without."""
        return self.make_edges()


def parse_captures(captures: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Split capture names into role, reach and symbol kind; a name starting with an underscore is dropped.

    kinds: (lang, ns_idx, sym_idx, kind), a small fixed table, joined on the captures' ``lang`` if given.
    """
    part = F.split("capture", r"\.")
    head = F.get(part, F.lit(0))
    role = F.when(head == "root", "root").otherwise(F.get(part, F.lit(1)))
    out = captures.where(~F.col("capture").startswith("_"))
    out = out.withColumn("role", role).withColumn("reach", head).withColumn("sym_name", F.get(part, F.lit(2)))
    out = out.where(F.col("role").isin("root", "scope", "import", "definition", "reference"))
    if kinds is not None:
        k = F.broadcast(kinds.select(F.col("lang").alias("_kl"), F.col("kind").alias("_kk"), "ns_idx", "sym_idx"))
        out = out.drop("ns_idx", "sym_idx").join(k, (F.col("lang") == F.col("_kl")) & (F.col("sym_name") == F.col("_kk")), "left").drop("_kl", "_kk")
    for c in ("ns_idx", "sym_idx"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("int"))
    return out


def number_nodes(parsed: DataFrame) -> DataFrame:
    """node_ix by insertion: root, scopes, imports, then definitions and references by capture, each in source order."""
    phase = F.create_map(*(x for i, r in enumerate(("root", "scope", "import", "definition", "reference")) for x in (F.lit(r), F.lit(i))))
    order = Window.partitionBy("file_id").orderBy(phase[F.col("role")], F.when(F.col("role").isin("definition", "reference"), F.col("capture_ix")), "ord", "start_byte")
    return parsed.withColumn("node_ix", (F.row_number().over(order) - 1).cast("int"))


def _scopes(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.where(F.col("role").isin("root", "scope")).select(F.col("file_id").alias(f"{prefix}file"), F.col("node_ix").alias(f"{prefix}ix"), F.col("start_byte").alias(f"{prefix}s"), F.col("end_byte").alias(f"{prefix}e"))


def innermost(rows: DataFrame, scopes: DataFrame, earlier: bool = False) -> DataFrame:
    """Add scope_ix, the innermost scope (from ``_scopes``, prefix s_) that contains a row's range; rows in none are dropped.

    earlier: only scopes inserted before the row count, so that of equal ranges the later nests in the earlier.
    """
    inside = (F.col("file_id") == F.col("s_file")) & (F.col("s_s") <= F.col("start_byte")) & (F.col("s_e") >= F.col("end_byte"))
    if earlier:
        inside = inside & (F.col("s_ix") < F.col("node_ix"))
    found = rows.join(scopes, inside).groupBy("file_id", "node_ix").agg(F.max_by("s_ix", F.struct(F.col("s_s"), -F.col("s_e"), F.col("s_ix"))).alias("scope_ix"))
    return rows.join(found, ["file_id", "node_ix"])


def innermost_sweep(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Like :func:`innermost`, see :func:`swept`."""
    return rows.join(swept(rows, scopes), ["file_id", "node_ix"])


def swept(rows: DataFrame, scopes: DataFrame, keep=lambda df: df) -> DataFrame:
    """(file_id, node_ix, scope_ix) as :func:`innermost` has them, but a file is sorted once and no scope meets a row that it doesn't hold.

    Ranges of scopes must nest, as those of a syntax tree do. Then in order of place a running sum of openings less closings
    is the depth, and the innermost scope at a place is the last one that was opened at its depth. So two windows over the
    file do, whatever its number of scopes. Rows that are empty or reach beyond the scope they begin in are looked up by
    the join. keep: called on what the windows find, which is read twice, to persist it.
    """
    s = scopes.select(F.col("s_file").alias("file_id"), F.col("s_ix").alias("ix"), F.col("s_s").cast("bigint").alias("s"), F.col("s_e").cast("bigint").alias("e")).where("s < e")
    none = F.lit(None).cast("int")
    # closings come before openings and these before rows of the same place; of openings the longer scope comes first
    opened = s.select("file_id", F.col("s").alias("at"), F.lit(1).alias("turn"), (-F.col("e")).alias("far"), F.col("ix").alias("o"), F.lit(1).alias("step"), F.col("ix").alias("open"), F.col("e").alias("end"), none.alias("row"), F.lit(None).cast("bigint").alias("stop"))
    closed = s.select("file_id", F.col("e").alias("at"), F.lit(0).alias("turn"), F.lit(0).cast("bigint").alias("far"), F.col("ix").alias("o"), F.lit(-1).alias("step"), none.alias("open"), F.lit(None).cast("bigint").alias("end"), none.alias("row"), F.lit(None).cast("bigint").alias("stop"))
    asked = rows.select("file_id", F.col("start_byte").cast("bigint").alias("at"), F.lit(2).alias("turn"), F.lit(0).cast("bigint").alias("far"), F.col("node_ix").alias("o"), F.lit(0).alias("step"), none.alias("open"), F.lit(None).cast("bigint").alias("end"), F.col("node_ix").alias("row"), F.col("end_byte").cast("bigint").alias("stop"))
    order = ("at", "turn", "far", "o")
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    events = opened.unionByName(closed).unionByName(asked).withColumn("depth", F.sum("step").over(so_far("file_id")))
    last = F.last(F.when(F.col("open").isNotNull(), F.struct("open", "end")), ignorenulls=True).over(so_far("file_id", "depth"))
    odd = (F.col("stop") <= F.col("at")) | (F.col("stop") > F.col("last.end"))
    known = (F.col("depth") > 0) & ~odd
    unknown = (F.col("depth") == 0) | odd
    found = events.withColumn("last", last).where("row is not null").where(known | unknown)
    found = keep(found.select("file_id", F.col("row").alias("node_ix"), F.col("at").alias("start_byte"), F.col("stop").alias("end_byte"), F.coalesce(known, F.lit(False)).alias("known"), F.col("last.open").alias("scope_ix")))
    sure = found.where("known").select("file_id", "node_ix", "scope_ix")
    rest = found.where("not known").select("file_id", "node_ix", "start_byte", "end_byte")
    return sure.unionByName(innermost(rest, scopes).select("file_id", "node_ix", "scope_ix"))


def closure(scope_nodes: DataFrame) -> DataFrame:
    """(file_id, scope_ix, anc_ix, dist): every scope with itself at 0 and all scopes around it, the root last.

    Nesting ranges make ancestors those scopes that contain a scope and came earlier, so no recursion is needed.
    """
    own = _scopes(scope_nodes, "s_")
    anc = _scopes(scope_nodes, "a_")
    around = (F.col("s_file") == F.col("a_file")) & (F.col("a_s") <= F.col("s_s")) & (F.col("a_e") >= F.col("s_e")) & (F.col("a_ix") <= F.col("s_ix"))
    near = Window.partitionBy("s_file", "s_ix").orderBy(F.col("a_s").desc(), F.col("a_e"), F.col("a_ix").desc())
    return own.join(anc, around).select(F.col("s_file").alias("file_id"), F.col("s_ix").alias("scope_ix"), F.col("a_ix").alias("anc_ix"), (F.row_number().over(near) - 1).cast("int").alias("dist"))


def place(nodes: DataFrame, scope_nodes: DataFrame, ancestors: DataFrame, strategy: str = "sweep", keep=lambda df: df) -> DataFrame:
    """Definitions, imports and references with the scope they belong to: the innermost one, its parent if hoisted, the root if global.

    Scopes and their parents meet as numbers alone, so a row with all its columns is shuffled once. keep: see :func:`swept`.
    """
    scopes = _scopes(scope_nodes, "s_")
    roots = scope_nodes.where("role = 'root'").select(F.col("file_id").alias("r_file"), F.col("node_ix").alias("root_ix"))
    rest = nodes.where(F.col("role").isin("import", "definition", "reference"))
    local = rest.where("reach <> 'global' or role <> 'definition'")
    inner = innermost(local, scopes).select("file_id", "node_ix", "scope_ix") if strategy == "join" else swept(local, scopes, keep)
    parent = ancestors.where("dist = 1").select(F.col("file_id").alias("p_file"), F.col("scope_ix").alias("p_ix"), F.col("anc_ix").alias("parent_ix"))
    hoisted = (F.col("role") == "definition") & (F.col("reach") == "hoist")
    inner = inner.join(parent, (F.col("file_id") == F.col("p_file")) & (F.col("scope_ix") == F.col("p_ix")), "left").drop("p_file", "p_ix")
    within = local.join(inner, ["file_id", "node_ix"])
    within = within.withColumn("scope_ix", F.when(hoisted, F.coalesce("parent_ix", "scope_ix")).otherwise(F.col("scope_ix"))).drop("parent_ix")
    top = rest.where("reach = 'global' and role = 'definition'").join(roots, F.col("file_id") == F.col("r_file")).withColumn("scope_ix", F.col("root_ix")).drop("r_file", "root_ix")
    return within.unionByName(top)


def resolve(placed: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Edges (file_id, src_ix, dst_ix, kind, dist) from references to definitions and imports of their name.

    All enclosing scopes count, inner ones hide nothing, order in the text doesn't matter. Definitions also need a
    namespace in common with the reference, or none on either side.
    """
    refs = placed.where("role = 'reference'").select("file_id", F.col("node_ix").alias("src_ix"), "scope_ix", F.col("text").alias("name"), F.col("ns_idx").alias("ref_ns"))
    seen = refs.join(ancestors, ["file_id", "scope_ix"])
    targets = placed.where("role <> 'reference'").select(F.col("file_id").alias("t_file"), F.col("scope_ix").alias("t_scope"), F.col("text").alias("t_name"), F.col("node_ix").alias("dst_ix"), "role", F.col("ns_idx").alias("def_ns"))
    fits = (F.col("role") == "import") | F.col("def_ns").isNull() | F.col("ref_ns").isNull() | (F.col("def_ns") == F.col("ref_ns"))
    hit = seen.join(targets, (F.col("file_id") == F.col("t_file")) & (F.col("anc_ix") == F.col("t_scope")) & (F.col("name") == F.col("t_name")) & fits)
    kind = F.when(F.col("role") == "import", "RefToImport").otherwise("RefToDef")
    return hit.select("file_id", "src_ix", "dst_ix", kind.alias("kind"), "dist")


def resolving(placed: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(h_file, h_scope, h_name, h_ns) of the references for which :func:`resolve` has an edge, without making the edges.

    References of one name and namespace in one scope resolve alike, and a target counts once, so what is joined are
    distinct names of scopes, however often each is used.
    """
    own = (F.col("file_id").alias("h_file"), F.col("scope_ix").alias("h_scope"), F.col("text").alias("h_name"), F.col("ns_idx").alias("h_ns"))
    refs = placed.where("role = 'reference'").select(*own).distinct()
    seen = refs.join(ancestors.select("file_id", "scope_ix", "anc_ix"), (F.col("h_file") == F.col("file_id")) & (F.col("h_scope") == F.col("scope_ix"))).drop("file_id", "scope_ix")
    targets = placed.where("role <> 'reference'").select(F.col("file_id").alias("t_file"), F.col("scope_ix").alias("t_scope"), F.col("text").alias("t_name"), F.when(F.col("role") != "import", F.col("ns_idx")).alias("t_ns")).distinct()
    fits = F.col("t_ns").isNull() | F.col("h_ns").isNull() | (F.col("t_ns") == F.col("h_ns"))
    return seen.join(targets, (F.col("h_file") == F.col("t_file")) & (F.col("anc_ix") == F.col("t_scope")) & (F.col("h_name") == F.col("t_name")) & fits).select("h_file", "h_scope", "h_name", "h_ns").distinct()


def build_scope_graph(captures: DataFrame, kinds: DataFrame | None = None, strategy: str = "sweep", keep=lambda df: df) -> ScopeGraph:
    """Nodes, edges and the scopes' closure of all files. keep: called on stages read more than once, to persist them.

    strategy: how innermost scopes are found, "sweep" or, for scopes that don't nest, "join".

    Ranges outside the root are dropped, but not global definitions. References that resolve to nothing are dropped.
    """
    nodes = keep(number_nodes(parse_captures(captures, kinds)))
    root = nodes.where("role = 'root'")
    scopes = nodes.where("role = 'scope'")
    # a scope outside the root is none
    held = root.unionByName(scopes.join(root.select(F.col("file_id").alias("_rf"), F.col("start_byte").alias("_rs"), F.col("end_byte").alias("_re")), (F.col("file_id") == F.col("_rf")) & (F.col("start_byte") >= F.col("_rs")) & (F.col("end_byte") <= F.col("_re"))).drop("_rf", "_rs", "_re"))
    held = keep(held)
    ancestors = keep(closure(held))
    placed = keep(place(nodes, held, ancestors, strategy, keep))
    used = keep(resolving(placed, ancestors))
    upward = ancestors.where("dist = 1").select("file_id", F.col("scope_ix").alias("src_ix"), F.col("anc_ix").alias("dst_ix"), F.lit("ScopeToScope").alias("kind"), "dist")
    owned = placed.where("role <> 'reference'").select("file_id", F.col("node_ix").alias("src_ix"), F.col("scope_ix").alias("dst_ix"), F.when(F.col("role") == "import", "ImportToScope").otherwise("DefToScope").alias("kind"), F.lit(0).alias("dist"))
    resolves = (F.col("file_id") == F.col("h_file")) & (F.col("scope_ix") == F.col("h_scope")) & (F.col("text") == F.col("h_name")) & F.col("ns_idx").eqNullSafe(F.col("h_ns"))
    stay = placed.where("role <> 'reference'").unionByName(placed.where("role = 'reference'").join(used, resolves, "left_semi"))
    inner = held.join(ancestors.where("dist = 1").select("file_id", F.col("scope_ix").alias("node_ix"), F.col("anc_ix").alias("scope_ix")), ["file_id", "node_ix"], "left")
    all_ = stay.unionByName(inner, allowMissingColumns=True)
    roots = root.select("file_id", F.col("node_ix").alias("root_ix"))
    out = all_.join(roots, "file_id").withColumnRenamed("role", "kind").withColumn("name", F.when(F.col("kind").isin("definition", "import", "reference"), F.col("text")))
    return ScopeGraph(out, ancestors, lambda: upward.unionByName(owned).unionByName(keep(resolve(placed, ancestors))))


def definitions_of(graph: ScopeGraph) -> DataFrame:
    """Edges from references to definitions in the order they are listed: outer scopes first, earlier definitions first."""
    order = Window.partitionBy("file_id", "src_ix").orderBy(F.col("dist").desc(), F.col("dst_ix"))
    return graph.edges.where("kind = 'RefToDef'").withColumn("rank", F.row_number().over(order))


def references_of(graph: ScopeGraph) -> DataFrame:
    return graph.edges.where("kind in ('RefToDef', 'RefToImport')").select("file_id", F.col("dst_ix").alias("node_ix"), F.col("src_ix").alias("ref_ix"))


def node_at_range(nodes: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per file the first node that is no scope and contains the bytes."""
    hit = nodes.where(~F.col("kind").isin("root", "scope") & (F.col("start_byte") <= start) & (F.col("end_byte") >= end))
    return hit.groupBy("file_id").agg(F.min("node_ix").alias("node_ix"))


def node_at_position(nodes: DataFrame, line: Column, col: Column) -> DataFrame:
    """Per file the first definition or reference on one line that has the column, ends included."""
    hit = nodes.where(F.col("kind").isin("definition", "reference") & (F.col("start_line") == line) & (F.col("end_line") == line) & (F.col("start_col") <= col) & (F.col("end_col") >= col))
    return hit.groupBy("file_id").agg(F.min("node_ix").alias("node_ix"))


def value_of_definition(nodes: DataFrame) -> DataFrame:
    """(file_id, node_ix, value_ix): a definition's innermost scope if it starts on its line, else the largest that does."""
    defs = nodes.where("kind = 'definition'").select("file_id", "node_ix", F.col("start_byte").alias("d_s"), F.col("end_byte").alias("d_e"), F.col("start_line").alias("d_line"))
    scopes = nodes.where(F.col("kind").isin("root", "scope")).select(F.col("file_id").alias("s_file"), F.col("node_ix").alias("s_ix"), F.col("start_byte").alias("s_s"), F.col("end_byte").alias("s_e"), F.col("start_line").alias("s_line"))
    joined = defs.join(scopes, F.col("file_id") == F.col("s_file"), "left")
    inside, same = (F.col("s_s") <= F.col("d_s")) & (F.col("s_e") >= F.col("d_e")), F.col("s_line") == F.col("d_line")
    pick = joined.groupBy("file_id", "node_ix").agg(
        F.max(F.when(inside, F.struct(F.col("s_s"), -F.col("s_e"), F.col("s_ix"), same.alias("same")))).alias("own"),
        F.max(F.when(same, F.struct((F.col("s_e") - F.col("s_s")).alias("size"), F.col("s_ix")))).alias("line"),
    )
    return pick.select("file_id", "node_ix", F.when(F.col("own.same"), F.col("own.s_ix")).otherwise(F.col("line.s_ix")).alias("value_ix")).where("value_ix is not null")


def hoverable_ranges(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("kind").isin("root", "scope")).select("file_id", "start_byte", "end_byte")


def symbols(nodes: DataFrame) -> DataFrame:
    """Definitions of a kind, and whether they belong to the root."""
    return nodes.where("kind = 'definition' and sym_name is not null").select("file_id", "node_ix", "name", F.col("sym_name").alias("symbol"), *RANGE, top_level(nodes).alias("top"))


def top_level(nodes: DataFrame) -> Column:
    return F.col("scope_ix") == F.col("root_ix")


def count_kinds(nodes: DataFrame) -> DataFrame:
    n = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    return nodes.groupBy("file_id").agg(n("root", "scope").alias("scopes"), n("definition").alias("defs"), n("reference").alias("refs"), n("import").alias("imports"))


def debug_tree(graph: ScopeGraph) -> DataFrame:
    """(file_id, scope_ix, defs, imports, children): each scope's contents, sorted by range, with references."""
    refs = references_of(graph).groupBy("file_id", "node_ix").agg(F.sort_array(F.collect_list("ref_ix")).alias("refs"))
    own = graph.nodes.where(F.col("kind").isin("definition", "import")).join(refs, ["file_id", "node_ix"], "left")
    row = F.struct("start_byte", "end_byte", "name", "sym_name", F.coalesce("refs", F.array().cast("array<int>")).alias("refs"))
    held = own.groupBy("file_id", "scope_ix").agg(F.sort_array(F.collect_list(F.when(F.col("kind") == "definition", row))).alias("defs"), F.sort_array(F.collect_list(F.when(F.col("kind") == "import", row))).alias("imports"))
    kids = graph.edges.where("kind = 'ScopeToScope'").groupBy("file_id", F.col("dst_ix").alias("scope_ix")).agg(F.sort_array(F.collect_list("src_ix")).alias("children"))
    every = graph.nodes.where(F.col("kind").isin("root", "scope")).select("file_id", F.col("node_ix").alias("scope_ix"))
    return every.join(held, ["file_id", "scope_ix"], "left").join(kids, ["file_id", "scope_ix"], "left")




def _quoted(text: Column) -> Column:
    """A text in double quotes as the debug form of strings has it."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(out, F.lit("\t"), F.lit("\\t")), F.lit('"'))


def _context(content: Column, start: Column, end: Column) -> Column:
    """The lines of a byte range without white space around them, the range between marks."""
    data = F.encode(content, "UTF-8")
    part = lambda a, n: F.decode(F.substring(data, a + 1, n), "UTF-8")
    before, after = F.substring_index(part(F.lit(0), start), "\n", -1), F.substring_index(part(end, F.octet_length(content)), "\n", 1)
    return F.concat(F.regexp_replace(before, r"^\s+", ""), F.lit("§"), part(start, end - start), F.lit("§"), F.regexp_replace(after, r"\s+$", ""))


def debug_text(graph: ScopeGraph, files: DataFrame, keep=lambda df: df.cache()) -> DataFrame:
    """(file_id, tree): each file's scopes as nested text: definitions and imports with their lines and those of their uses.

    files: file_id, content. keep: called on what every level reads, to persist it. Contents of a scope go by range. As a scope's depth is the number of its ancestors, each one's
    own lines are made at once with their indent; then scopes are folded into the ones around them from the deepest level
    up, one aggregation for each level of the deepest file.
    """
    spark = graph.nodes.sparkSession
    scopes = graph.nodes.where(F.col("kind").isin("root", "scope")).select("file_id", F.col("node_ix").alias("ix"), "start_byte", "end_byte")
    up = graph.edges.where("kind = 'ScopeToScope'").select("file_id", F.col("src_ix").alias("ix"), F.col("dst_ix").alias("up"))
    deep = graph.ancestors.groupBy("file_id", F.col("scope_ix").alias("ix")).agg(F.max("dist").alias("depth"))
    pad = lambda n: F.expr(f"repeat('    ', {n})")
    text = files.select("file_id", F.coalesce("content", F.lit("")).alias("content"))
    uses = references_of(graph).join(graph.nodes.select("file_id", F.col("node_ix").alias("ref_ix"), F.col("start_byte").alias("a"), F.col("end_byte").alias("b")), ["file_id", "ref_ix"])
    lines = uses.join(text, "file_id").select("file_id", "node_ix", F.struct("a", "b", _context(F.col("content"), F.col("a"), F.col("b")).alias("t")).alias("use"))
    lines = lines.groupBy("file_id", "node_ix").agg(F.sort_array(F.collect_list("use")).alias("uses"))
    own = graph.nodes.where(F.col("kind").isin("definition", "import")).join(lines, ["file_id", "node_ix"], "left").join(text, "file_id")
    own = own.join(deep.withColumnRenamed("ix", "scope_ix"), ["file_id", "scope_ix"])
    context = _quoted(_context(F.col("content"), F.col("start_byte"), F.col("end_byte")))
    each = F.array_join(F.transform("uses", lambda u: F.concat(pad("depth * 2 + 4"), F.lit("`"), u["t"], F.lit("`,\n"))), "")
    used = F.when(F.size("uses") > 0, F.concat(pad("depth * 2 + 3"), F.lit("referenced in ("), F.size("uses").cast("string"), F.lit("): [\n"), each, pad("depth * 2 + 3"), F.lit("],\n"))).otherwise("")
    kind = F.when(F.col("kind") == "definition", F.concat(pad("depth * 2 + 3"), F.lit("kind: "), _quoted(F.coalesce("sym_name", F.lit("none"))), F.lit(",\n"))).otherwise("")
    block = F.concat(pad("depth * 2 + 2"), "name", F.lit(" {\n"), kind, pad("depth * 2 + 3"), F.lit("context: "), context, F.lit(",\n"), used, pad("depth * 2 + 2"), F.lit("},\n"))
    blocks = own.select("file_id", F.col("scope_ix").alias("ix"), "kind", F.struct("start_byte", "end_byte", block.alias("t")).alias("x"))
    listed = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("x")))), lambda x: x["t"]), "")
    held = blocks.groupBy("file_id", "ix").agg(listed("definition").alias("defs"), listed("import").alias("imports"))
    nodes = scopes.join(deep, ["file_id", "ix"]).join(up, ["file_id", "ix"], "left").join(held, ["file_id", "ix"], "left")

    def field(name: str, content: Column) -> Column:
        return F.concat(pad("depth * 2 + 1"), F.when(content == "", f"{name}: [],\n").otherwise(F.concat(F.lit(f"{name}: [\n"), content, pad("depth * 2 + 1"), F.lit("],\n"))))

    nodes = nodes.withColumns({"defs": F.coalesce("defs", F.lit("")), "imports": F.coalesce("imports", F.lit(""))})
    head = F.concat(pad("depth * 2"), F.lit("scope {\n"), field("definitions", F.col("defs")), F.when(F.col("imports") == "", "").otherwise(field("imports", F.col("imports"))))
    nodes = keep(nodes.select("file_id", "ix", "up", "depth", "start_byte", "end_byte", head.alias("head")))
    inner = spark.createDataFrame([], nodes.select("file_id", F.col("ix"), F.lit("").alias("kids")).schema)
    for level in range(int(nodes.agg(F.max("depth")).first()[0] or 0), -1, -1):
        here = nodes.where(F.col("depth") == level).join(inner, ["file_id", "ix"], "left")
        whole = F.concat("head", field("child scopes", F.coalesce("kids", F.lit(""))), pad("depth * 2"), F.lit("},\n"))
        done = here.select("file_id", "up", F.struct("start_byte", "end_byte", "ix", whole.alias("t")).alias("x"))
        inner = done.groupBy("file_id", F.col("up").alias("ix")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "").alias("kids"))
    return inner.select("file_id", F.regexp_replace("kids", r",\n$", "").alias("tree"))
