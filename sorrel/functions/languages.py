"""Languages by extension and id, and the symbol kinds of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension to language as the navigator has it; exact case.
NAVIGATOR = {"rs": "rust", "go": "go", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "java": "java", "c": "c", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "h": "C++", "rb": "ruby", "php": "php", "r": "r"}
#: Extension to language as context chunks have it; any case. Headers are C here.
CONTEXT = {"rs": "Rust", "py": "Python", "js": "JavaScript", "ts": "TypeScript", "go": "Go", "java": "Java", "c": "C", "h": "C", "cpp": "Cpp", "cc": "Cpp", "hpp": "Cpp", "cs": "CSharp", "rb": "Ruby", "php": "Php", "r": "R", "proto": "Proto"}
#: Languages in registry order.
REGISTRY = ("C", "Go", "JavaScript", "Python", "Rust", "TypeScript", "C#", "Java", "C++", "Ruby", "R", "PHP")
#: Symbol kinds of each language by namespace.
NAMESPACES = {
    "c": (("header", "macro", "function", "struct", "enum", "enumerator", "union", "typedef", "variable", "label"),),
    "c_sharp": (("local", "class", "struct", "enum", "typedef", "interface", "enumerator", "method", "namespace"),),
    "c++": (("header", "macro", "function", "struct", "enum", "enumerator", "union", "typedef", "variable", "label", "namespace", "class", "concept", "alias"),),
    "go": (("const", "var", "func", "module"), ("struct", "interface", "type"), ("member",), ("label",)),
    "java": (("local", "method", "package", "module", "class", "enum", "enumConstant", "record", "interface", "typedef", "label"),),
    "javascript": (("constant", "variable", "property", "function", "method", "generator", "class", "label"),),
    "php": (("constant", "function", "method", "parameter", "variable", "class", "enum", "trait", "interface", "field", "enumerator", "label", "namespace"),),
    "python": (("class", "function", "parameter", "variable"),),
    "r": (("variable",),),
    "ruby": (("variable", "constant", "class", "method", "module"),),
    "rust": (("const", "function", "variable", "struct", "enum", "union", "typedef", "interface", "field", "enumerator", "module", "label", "lifetime"),),
    "typescript": (("constant", "variable", "property", "parameter", "function", "method", "generator", "alias", "enum", "enumerator", "class", "interface", "label"),),
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def navigator_language(ext: Column) -> Column:
    return _lookup(NAVIGATOR, ext)


def context_language(ext: Column) -> Column:
    return F.coalesce(_lookup(CONTEXT, F.lower(ext)), F.lit("Unknown"))


def language_index(name: Column) -> Column:
    """The place in the registry of a language id of any case; null if unknown."""
    return F.nullif(F.array_position(F.array(*(F.lit(x.lower()) for x in REGISTRY)), F.lower(name)).cast("int"), F.lit(0)) - 1


def symbol_kinds(spark: SparkSession) -> DataFrame:
    """(lang, ns_idx, sym_idx, kind): a fixed table; a kind's id is its place in the first namespace that has it."""
    rows = [(lang, i, j, kind) for lang, spaces in NAMESPACES.items() for i, space in enumerate(spaces) for j, kind in enumerate(space)]
    return spark.createDataFrame(rows, "lang string, ns_idx int, sym_idx int, kind string")
