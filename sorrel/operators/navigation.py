"""Definitions, references, signatures and snippets over a built index of nodes and files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import function_like, snippet
from ..functions.text import lines

#: Symbol kinds by rank; any other has rank 5.
PRIORITY = {0: ("class", "struct", "enum", "union"), 1: ("typedef", "alias"), 3: ("function",), 4: ("variable",)}
WORD = "A-Za-z0-9_"
#: Names up to which all are sent to every file; more are joined with the files' words.
FEW_NAMES = 10_000


def kind_priority(kind: Column, lang: Column, strict: bool = True) -> Column:
    """A kind's rank. strict: only C++ ranks kinds and all others are equal, as known results have it."""
    out = F.lit(5)
    for rank, kinds in PRIORITY.items():
        out = F.when(kind.isin(*kinds), F.lit(rank)).otherwise(out)
    return F.when(F.lower(lang).isin("c++", "cpp"), out).otherwise(F.lit(5)) if strict else out


def goto_definition(nodes: DataFrame, files: DataFrame, names: DataFrame, strict: bool = True) -> DataFrame:
    """Definitions of each name in all files: (name, rank, rel_path, kind, range), rank 1 being the primary one.

    names: a column ``name``, exact and case-sensitive. In Rust only top-level definitions count. Order: scan order,
    rank of the kind, line, node. A C++ function whose line says class or struct ranks as such.
    """
    f = files.select("file_id", "rel_path", "lang", "scan_ord", "content")
    hit = nodes.where("kind = 'definition'").select("file_id", "node_ix", "name", "sym_name", "scope_ix", "root_ix", "start_line", "start_col", "end_line", "end_col").join(names.select("name").distinct(), "name").join(f, "file_id")
    hit = hit.where((F.lower("lang") != "rust") | (F.col("scope_ix") == F.col("root_ix")))
    text = F.get(lines(F.col("content")), F.col("start_line"))
    fix = (F.col("sym_name") == "function") & F.lower("lang").isin("c", "c++", "cpp") & (text.contains("class") | text.contains("struct"))
    fix = fix if not strict else fix & F.lower("lang").isin("c++", "cpp")
    rank = F.when(fix, F.lit(0)).otherwise(kind_priority(F.col("sym_name"), F.col("lang"), strict))
    order = Window.partitionBy("name").orderBy("scan_ord", rank, "start_line", "node_ix")
    return hit.select("name", F.row_number().over(order).alias("rank"), "file_id", "rel_path", F.col("sym_name").alias("kind"), "start_line", "start_col", "end_line", "end_col", "node_ix")


def _occurrences_in(content: str, name: str) -> list[tuple[int, int, int]]:
    out = []
    for i, line in enumerate(content.split("\n")):
        raw = line.encode()
        for m in re.finditer(rb"(?<![A-Za-z0-9_])" + re.escape(name.encode()) + rb"(?![A-Za-z0-9_])", raw):
            out.append((i, m.start(), m.end()))
    return out


def text_occurrences(files: DataFrame, names: DataFrame) -> DataFrame:
    """Whole-word places of each ASCII name: (name, file_id, line, col, end_col), 0-based, columns in bytes.

    Lines are found with SQL functions; only lines with a hit go to Python, for byte columns. Up to FEW_NAMES names are
    broadcast; of more, each is joined with the words of lines.
    """
    ok = names.select("name").distinct().where(F.col("name").rlike(rf"^[{WORD}]+$"))
    if ok.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        rows = files.select("file_id", "content").join(F.broadcast(ok), F.col("content").contains(F.col("name")))
        each = rows.select("file_id", "name", F.posexplode(F.split("content", "\n", -1)).alias("line", "text")).where(F.col("text").contains(F.col("name")))
    else:
        every = files.select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("line", "text"))
        words = every.select("*", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"[{WORD}]+"), F.lit(0)))).alias("name"))
        each = words.join(ok, "name").select("file_id", "name", "line", "text")

    @F.pandas_udf("array<struct<col:int,end_col:int>>")
    def places(text: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([[{"col": a, "end_col": b} for _, a, b in _occurrences_in(t, n)] for t, n in zip(text, name, strict=True)])

    hit = each.select("file_id", "name", "line", F.explode(places("text", "name")).alias("p"))
    return hit.select("name", "file_id", "line", "p.col", "p.end_col")


def count_occurrences(text: Column, word: str) -> Column:
    """Whole-word occurrences, without positions: SQL functions alone."""
    return F.regexp_count(text, F.lit(rf"(?<![{WORD}]){re.escape(word)}(?![{WORD}])"))


def find_references(nodes: DataFrame, files: DataFrame, names: DataFrame, most: int = 100) -> DataFrame:
    """References of each name, ``most`` at first: (name, seq, file_id, start_line, start_col, end_line, end_col).

    A file's own references count; files without any are searched as text, where definitions are found as well.
    """
    own = nodes.where("kind = 'reference'").join(names.select("name").distinct(), "name").select("name", "file_id", "start_line", "start_col", "end_line", "end_col", "node_ix")
    text = text_occurrences(files, names).select("name", "file_id", F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), "end_col", F.lit(0).alias("node_ix"))
    text = text.join(own.select("name", "file_id").distinct(), ["name", "file_id"], "left_anti")
    order = Window.partitionBy("name").orderBy("scan_ord", "node_ix", "start_line", "start_col")
    both = own.unionByName(text).join(files.select("file_id", "scan_ord"), "file_id")
    return both.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= most).drop("scan_ord", "node_ix")


def references_minus_definitions(references: DataFrame, definitions: DataFrame) -> DataFrame:
    keys = ["name", "file_id", "start_line", "start_col", "end_line", "end_col"]
    return references.join(definitions.select(*keys).distinct(), keys, "left_anti")


def signature(content: Column, line: Column) -> Column:
    """From a 0-based line: a function's lines until an opening brace, semicolon or blank line; else the line itself."""
    every = lines(content)
    ls = F.slice(every, line + 1, F.greatest(F.size(every) - line, F.lit(0)))
    first = F.get(ls, F.lit(0))
    end = F.array_position(F.transform(ls, lambda x: x.contains("{") | x.contains(";") | (F.trim(x) == "")), True)
    taken = F.slice(ls, 1, F.when(end > 0, end.cast("int")).otherwise(F.size(ls)))
    function = F.regexp_replace(F.rtrim(F.regexp_replace(F.rtrim(F.regexp_replace(F.array_join(taken, "\n"), r"(?s)\{.*", "")), ";$", "")), r"\s+\z", "")
    header = F.rtrim(F.regexp_replace(F.rtrim(F.regexp_replace(F.rtrim(first), r"\{$", "")), ";$", ""))
    return F.when(function_like(first), function).otherwise(header)


def symbol_context(locations: DataFrame, files: DataFrame, context: int = 5) -> DataFrame:
    """locations (file_id, start_line, ...) with signature and snippet."""
    joined = locations.join(files.select("file_id", "content"), "file_id")
    return joined.withColumn("signature", signature(F.col("content"), F.col("start_line"))).withColumn("snippet", snippet(F.col("content"), F.col("start_line"), context)).drop("content")


def definition_at(nodes: DataFrame, edges: DataFrame, line: int, col: int) -> DataFrame:
    """Per file: the definition at a 0-based position, or the definitions of the reference there."""
    from .scope import node_at_position

    at = node_at_position(nodes, F.lit(line), F.lit(col)).join(nodes, ["file_id", "node_ix"])
    own = at.where("kind = 'definition'").select("file_id", F.col("node_ix").alias("def_ix"), F.lit(0).alias("dist"))
    refs = at.where("kind = 'reference'").select("file_id", F.col("node_ix").alias("src_ix"))
    far = refs.join(edges.where("kind = 'RefToDef'"), ["file_id", "src_ix"]).select("file_id", F.col("dst_ix").alias("def_ix"), "dist")
    found = own.unionByName(far).withColumnRenamed("def_ix", "node_ix")
    order = Window.partitionBy("file_id").orderBy(F.col("dist").desc(), "node_ix")
    return found.join(nodes.select("file_id", "node_ix", "name", "start_line", "start_col", "end_line", "end_col"), ["file_id", "node_ix"]).withColumn("rank", F.row_number().over(order)).drop("dist")


def identifier_at(text_line: Column, col: Column) -> Column:
    """The identifier that covers a character of the line, or that ends just before it; null if none does."""
    before = F.substr(text_line, F.lit(1), col)
    left, right = F.regexp_extract(before, rf"([{WORD}]*)$", 1), F.regexp_extract(F.substr(text_line, col + 1), rf"^([{WORD}]*)", 1)
    return F.nullif(F.concat(left, right), F.lit(""))


def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The longest known root that a path lies under: (path, root). Paths are joined by all that they lie under."""
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    under = paths.select("path").distinct().select("path", F.explode_outer(F.when(F.col("path").isNotNull(), above)).alias("root"))
    found = under.join(roots.select(F.col("root").alias("_known")).distinct(), F.col("root") == F.col("_known"), "left")
    return found.groupBy("path").agg(F.max_by("_known", F.length("_known")).alias("root"))
