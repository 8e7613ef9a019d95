"""Captures from source text: scopes, definitions, imports and references of each file.

Python is read with the standard library's parser, C, Go and Rust by the rules of :mod:`operators.syntax`. Other brace
languages, Ruby and R are read by a lexer and a table of their declarations: named functions, types, variables, parameters,
imports, calls and other uses. A full grammar gives more captures; everything after this step sees captures only.
"""

from __future__ import annotations

import ast
import re
import time
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_SECONDS = 500_000, 1.0
CAPTURES = "file_id string, lang string, capture string, capture_ix int, ord int, start_byte int, start_line int, start_col int, end_byte int, end_line int, end_col int, text string, error string"
#: Errors of a file, as its only row.
UNSUPPORTED, TIMEOUT, BROKEN, QUERY, TOO_LARGE = "UnsupportedLanguage", "ParseTimeout", "LanguageMismatch", "QueryError", "FileTooLarge"


class TooSlow(Exception):
    """Reading a file takes longer than it may."""


@dataclass
class Source:
    text: str
    deadline: float = float("inf")
    data: bytes = b""
    starts: list[int] = field(default_factory=list)

    def check_time(self) -> None:
        if time.monotonic() > self.deadline:
            raise TooSlow

    def __post_init__(self) -> None:
        self.data = self.text.encode()
        self.starts = [0, *(i + 1 for i, b in enumerate(self.data) if b == 10)]

    def at(self, line: int, col: int) -> int:
        return self.starts[line] + col

    def place(self, byte: int) -> tuple[int, int]:
        lo, hi = 0, len(self.starts) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= byte else (lo, mid - 1)
        return lo, byte - self.starts[lo]


Capture = tuple[str, int, int]


class _Python(ast.NodeVisitor):
    def __init__(self, src: Source):
        self.src, self.out = src, []

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.src.at(node.lineno - 1, node.col_offset), self.src.at(node.end_lineno - 1, node.end_col_offset)

    def add(self, capture: str, start: int, end: int) -> None:
        if not len(self.out) % 4096:
            self.src.check_time()
        self.out.append((capture, start, end))

    def word(self, capture: str, name: str, after: int) -> None:
        """The first whole word ``name`` from a byte on."""
        m = re.compile(rb"(?<![\w])" + re.escape(name.encode()) + rb"(?![\w])").search(self.src.data, after)
        if m:
            self.add(capture, m.start(), m.end())

    def block(self, body: list[ast.stmt]) -> None:
        if body:
            first = body[0]
            start = min([self.span(first)[0], *(self.span(d)[0] - 1 for d in getattr(first, "decorator_list", []))])
            self.add("local.scope", start, self.span(body[-1])[1])
        for x in body:
            self.visit(x)

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        for d in node.decorator_list:
            self.visit(d)
        start, end = self.span(node)
        self.add("local.scope", start, end)
        self.word("hoist.definition.function", node.name, start + 4)
        self.parameters(node.args)
        if node.returns:
            self.visit(node.returns)
        self.block(node.body)

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def parameters(self, a: ast.arguments) -> None:
        for p in [*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg]:
            if p is not None:
                start = self.span(p)[0]
                self.add("local.definition.parameter", start, start + len(p.arg.encode()))
                if p.annotation:
                    self.visit(p.annotation)
        for d in [*a.defaults, *a.kw_defaults]:
            if d is not None:
                self.visit(d)

    def visit_Lambda(self, node: ast.Lambda) -> None:
        self.add("local.scope", *self.span(node))
        self.parameters(node.args)
        self.visit(node.body)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for d in [*node.decorator_list, *node.bases, *(k.value for k in node.keywords)]:
            self.visit(d)
        self.word("local.definition.class", node.name, self.span(node)[0] + 6)
        self.block(node.body)

    def comprehension(self, node: ast.AST) -> None:
        self.add("local.scope", *self.span(node))
        self.generic_visit(node)

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = comprehension

    def scoped(self, node: ast.stmt) -> None:
        self.add("local.scope", *self.span(node))
        self.statement(node)

    visit_For = visit_AsyncFor = visit_With = visit_AsyncWith = scoped

    def statement(self, node: ast.AST) -> None:
        """Bodies are blocks; all else of the node is visited in order."""
        for name, value in ast.iter_fields(node):
            if name in ("body", "orelse", "finalbody") and isinstance(value, list):
                self.block([x for x in value if isinstance(x, ast.stmt)])
            elif isinstance(value, list):
                for x in value:
                    if isinstance(x, ast.AST):
                        self.visit(x)
            elif isinstance(value, ast.AST):
                self.visit(value)

    visit_If = visit_While = visit_Try = statement

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        if node.name:
            self.word("local.definition.variable", node.name, self.span(node.type)[1] if node.type else self.span(node)[0])
        self.statement(node)

    def visit_Global(self, node: ast.Global) -> None:
        for n in node.names:
            self.word("local.definition.variable", n, self.span(node)[0] + 6)

    visit_Nonlocal = visit_Global

    def imported(self, node: ast.Import | ast.ImportFrom) -> None:
        for a in node.names:
            start, end = self.span(a)
            if a.name == "*":
                continue
            if a.asname:
                self.add("local.import", end - len(a.asname.encode()), end)
            else:
                self.add("local.import", start, start + len(a.name.split(".")[0].encode()))

    visit_Import = visit_ImportFrom = imported

    def visit_Name(self, node: ast.Name) -> None:
        stored = isinstance(node.ctx, ast.Store)
        self.add("local.definition.variable" if stored else "local.reference", *self.span(node))

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        if isinstance(node.target, ast.Name):
            self.add("local.reference", *self.span(node.target))
        else:
            self.visit(node.target)
        self.visit(node.value)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.visit(node.value)
        if isinstance(node.value, ast.Name) and node.value.id == "self":
            end = self.span(node)[1]
            self.add("local.reference", end - len(node.attr.encode()), end)


def python_captures(src: Source) -> list[Capture]:
    v = _Python(src)
    for x in ast.parse(src.data).body:
        v.visit(x)
    return v.out


@dataclass(frozen=True)
class Grammar:
    """What the lexer knows of a language: keyword to capture, words that are no names, comments, imports."""

    declares: dict[str, str]
    words: frozenset[str]
    line_comment: str = "//"
    imports: tuple[str, ...] = ()
    functions: tuple[str, ...] = ()
    bare_functions: bool = False
    assigns: tuple[str, ...] = ()


def _words(s: str) -> frozenset[str]:
    return frozenset(s.split())


_C_WORDS = "if else for while do switch case default break continue return goto sizeof static const extern inline volatile register unsigned signed void int char short long float double bool struct union enum typedef"
# Declaring keywords with the capture of the name that follows, and reserved words.
GRAMMARS = {
    "rust": Grammar({"fn": "hoist.definition.function", "struct": "hoist.definition.struct", "enum": "hoist.definition.enum", "union": "hoist.definition.union", "trait": "hoist.definition.interface", "type": "hoist.definition.typedef", "mod": "local.definition.module", "const": "local.definition.const", "static": "local.definition.const", "let": "local.definition.variable"}, _words("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while u8 u16 u32 u64 usize i8 i16 i32 i64 isize f32 f64 bool char str"), imports=("use",), functions=("fn",)),
    "go": Grammar({"func": "hoist.definition.func", "type": "hoist.definition.type", "var": "local.definition.var", "const": "local.definition.const"}, _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false string int error bool byte rune float64 int64"), imports=("import",), functions=("func",), assigns=(":=",)),
    "javascript": Grammar({"function": "hoist.definition.function", "class": "local.definition.class", "const": "local.definition.constant", "let": "local.definition.variable", "var": "local.definition.variable"}, _words("async await break case catch class const continue debugger default delete do else export extends false finally for from function if import in instanceof let new null of return static super switch this throw true try typeof undefined var void while with yield"), imports=("import",), functions=("function",)),
    "typescript": Grammar({"function": "hoist.definition.function", "class": "local.definition.class", "interface": "local.definition.interface", "enum": "local.definition.enum", "type": "local.definition.alias", "const": "local.definition.constant", "let": "local.definition.variable", "var": "local.definition.variable"}, _words("abstract any as async await boolean break case catch class const continue declare default do else enum export extends false finally for from function if implements import in instanceof interface let new null number of private protected public readonly return static string super switch this throw true try type typeof undefined var void while yield"), imports=("import",), functions=("function",)),
    "java": Grammar({"class": "hoist.definition.class", "interface": "hoist.definition.interface", "enum": "hoist.definition.enum", "record": "hoist.definition.record", "package": "local.definition.package"}, _words("abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for if implements import instanceof int interface long native new null package private protected public record return short static super switch synchronized this throw throws transient true try var void volatile while"), imports=("import",), bare_functions=True),
    "c_sharp": Grammar({"class": "hoist.definition.class", "interface": "hoist.definition.interface", "enum": "local.definition.enum", "struct": "hoist.definition.struct", "record": "hoist.definition.class", "namespace": "hoist.definition.namespace", "var": "local.definition.local"}, _words("abstract as base bool break byte case catch char class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly record ref return sealed short sizeof static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using var virtual void volatile while"), imports=("using",), bare_functions=True),
    "c": Grammar({"struct": "local.definition.struct", "union": "local.definition.union", "enum": "local.definition.enum"}, _words(_C_WORDS), bare_functions=True),
    "c++": Grammar({"struct": "local.definition.struct", "union": "local.definition.union", "enum": "local.definition.enum", "class": "hoist.definition.class", "namespace": "hoist.definition.namespace", "concept": "hoist.definition.concept", "auto": "local.definition.variable"}, _words(_C_WORDS + " auto catch class constexpr const_cast delete explicit false friend mutable namespace new noexcept nullptr operator override private protected public static_cast template this throw true try typename using virtual"), imports=("using",), bare_functions=True),
    "php": Grammar({"function": "hoist.definition.function", "class": "local.definition.class", "interface": "local.definition.interface", "trait": "local.definition.trait", "enum": "local.definition.enum", "const": "local.definition.constant", "namespace": "local.definition.namespace"}, _words("abstract and array as break case catch class const continue declare default do echo else elseif enum extends false final finally fn for foreach function global if implements include instanceof interface isset list match namespace new null or print private protected public readonly require return static switch throw trait true try unset use var while yield php"), imports=("use",), functions=("function",), assigns=("=",)),
    "ruby": Grammar({"def": "hoist.definition.method", "class": "hoist.definition.class", "module": "hoist.definition.module"}, _words("alias and begin break case class def defined do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield"), line_comment="#", functions=("def",), assigns=("=",)),
    "r": Grammar({}, _words("if else repeat while function for in next break TRUE FALSE NULL NA Inf NaN c"), line_comment="#", functions=("function",), assigns=("<-", "=")),
}
ALIASES = {"tsx": "typescript", "cpp": "c++", "csharp": "c_sharp", "c#": "c_sharp"}

_TOKEN = {
    comment: re.compile(rf"""(?P<skip>{re.escape(comment)}[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+'|`(?:\\.|[^`\\])*`)|(?P<name>\$?[A-Za-z_]\w*)|(?P<mark>:=|<-|=>|==|[{{}}()\[\];,=.])|(?P<other>[^\s\w])""", re.S)
    for comment in ("//", "#")
}


def lexed_captures(src: Source, g: Grammar) -> list[Capture]:
    """Captures by keyword and bracket. A declaring keyword's next name is defined; a function's keyword opens a scope that
    ends with its body, in which the names of its parameter list are defined; braces are scopes (in Ruby, words to end).
    In an import statement names are imported. Other names are references, but not after a dot."""
    text, out = src.text, []
    bytes_before = None if text.isascii() else [0, *accumulate(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in text)]
    byte_at = (lambda i: i) if bytes_before is None else bytes_before.__getitem__
    toks = [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN[g.line_comment].finditer(text) if m.lastgroup != "skip"]
    ruby = g.line_comment == "#" and "def" in g.declares
    has_body = _bodies(toks)
    opens: list[tuple[str, int, int | None]] = []  # kind, start, start of the function that owns the body
    pending: str | None = None
    fn_start: int | None = None
    params, importing = 0, False
    for i, (kind, word, a, b) in enumerate(toks):
        if not i % 4096:
            src.check_time()
        after = toks[i + 1][1] if i + 1 < len(toks) else ""
        before = toks[i - 1][1] if i else ""
        new_line = not i or "\n" in text[toks[i - 1][3] : a]
        if importing and new_line and not any(x[0] == "import" for x in opens):
            importing = False
        if kind == "name":
            bare = word.lstrip("$")
            if bare in g.imports and (new_line or before in (";", "}", "{", "pub")):
                importing = True
                continue
            if word in g.functions and before != ".":
                fn_start = a
            if word in g.declares and before != ".":
                pending = g.declares[word]
            if ruby:
                first = new_line or before == ";"
                if word in ("def", "class", "module", "begin", "case", "do") or (first and word in ("if", "unless", "while", "until")):
                    opens.append((word, a, None))
                elif word == "end" and opens:
                    _, start, _ = opens.pop()
                    out.append(("local.scope", byte_at(start), byte_at(b)))
            if bare in g.words:
                continue
            start = byte_at(b) - len(bare.encode())
            span = (start, byte_at(b))
            if importing:
                if after not in (".", "::", ":") and not (after == "as"):
                    out.append(("local.import", *span))
            elif pending:
                if pending.endswith(("variable", "constant")) and after == "," and "fn" not in g.declares:
                    out.append((pending, *span))
                    continue
                out.append((pending, *span))
                if pending.endswith((".function", ".method", ".func")) and fn_start is None:
                    fn_start = a
                pending = None
            elif params and before in ("(", ",", "mut", "&") and (after in (",", ")", ":", "=") or "func" in g.declares):
                out.append(("local.definition.parameter" if "parameter" in str(g.declares) else "local.definition.variable", *span))
            elif g.bare_functions and after == "(" and has_body[i + 1] and before not in (".", "new", "return", "=", "("):
                out.append(("hoist.definition.function" if "class" not in g.declares or "namespace" in g.declares and "var" not in g.declares else "hoist.definition.method", *span))
                fn_start = a
            elif after in g.assigns and before != ".":
                out.append(("local.definition.variable" if "func" not in g.declares else "local.definition.var", *span))
            elif before != ".":
                out.append(("local.reference", *span))
        elif word == "(" and importing:
            opens.append(("import", a, None))
        elif word == ")" and importing:
            if opens and opens[-1][0] == "import":
                opens.pop()
            importing = False
        elif word == "(":
            if fn_start is not None and params == 0 and not importing:
                params = 1
            elif params:
                params += 1
        elif word == ")":
            params = max(0, params - 1)
        elif word == "{":
            if importing:
                opens.append(("import", a, None))
            else:
                opens.append(("{", a, fn_start))
                fn_start, pending = None, None
        elif word == "}":
            if opens:
                what, start, owner = opens.pop()
                if what == "{":
                    out.append(("local.scope", byte_at(start), byte_at(b)))
                    if owner is not None:
                        out.append(("local.scope", byte_at(owner), byte_at(b)))
        elif word == ";":
            importing, pending, fn_start = False, None, None
    return out


def _bodies(toks: list[tuple[str, str, int, int]]) -> list[bool]:
    """For each token whether it is a parenthesis that closes right before an opening brace; one pass with a stack."""
    out, opens = [False] * len(toks), []
    for i, (_, word, _, _) in enumerate(toks):
        if word == "(":
            opens.append(i)
        elif word == ")" and opens:
            out[opens.pop()] = i + 1 < len(toks) and toks[i + 1][1] == "{"
    return out


ORDER = ("local.scope", "hoist.definition", "local.definition", "global.definition", "local.import", "local.reference")


def captures_of(file_id: str, lang: str | None, text: str | None) -> list[tuple]:
    """A file's capture rows with its root, or one row with an error."""

    def failed(error: str) -> list[tuple]:
        return [(file_id, lang, "error", 0, 0, 0, 0, 0, 0, 0, 0, None, error)]

    text = text or ""
    name = ALIASES.get((lang or "").lower(), (lang or "").lower())
    if len(text.encode()) > MAX_BYTES:
        return failed(TOO_LARGE)
    if name != "python" and name not in GRAMMARS:
        return failed(UNSUPPORTED)
    src = Source(text, time.monotonic() + MAX_SECONDS)
    try:
        found = python_captures(src) if name == "python" else lexed_captures(src, GRAMMARS[name])
        src.check_time()
    except TooSlow:
        return failed(TIMEOUT)
    except (SyntaxError, ValueError, RecursionError):
        return failed(BROKEN)
    except LookupError:  # a grammar that doesn't fit its own tokens
        return failed(QUERY)
    names: dict[str, int] = {}
    for c in sorted({c for c, _, _ in found}, key=lambda c: ([i for i, p in enumerate(ORDER) if c.startswith(p)] or [9], c)):
        names[c] = len(names)
    rows = []
    # scopes come outer first, as a tree walk meets them
    for i, (capture, a, b) in enumerate([("root", 0, len(src.data)), *sorted(found, key=lambda x: (names[x[0]], x[1], -x[2]))]):
        (la, ca), (lb, cb) = src.place(a), src.place(b)
        named = src.data[a:b].decode() if "scope" not in capture and capture != "root" else None
        rows.append((file_id, lang, capture, names.get(capture, -1), i, a, la, ca, b, lb, cb, named, None))
    return rows


def extract(files: DataFrame) -> DataFrame:
    """Captures of files (file_id, lang, content); a file that fails gives one row with its error.

    C, Go and Rust go by the rules of :mod:`operators.syntax`, what is too large and all other languages one Arrow batch at
    a time by the readers here. Rows reach half a megabyte, so batches should be small
    (``spark.sql.execution.arrow.maxRecordsPerBatch`` of 64).
    """
    from . import syntax

    columns = [c.split()[0] for c in CAPTURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for f, g, t in zip(pdf["file_id"], pdf["lang"], pdf["content"], strict=True) for r in captures_of(f, g, t)]
            yield pd.DataFrame(rows, columns=columns)

    files = files.select("file_id", "lang", "content")
    by_rules = F.coalesce(F.lower("lang").isin(*syntax.NAMES) & (F.octet_length(F.coalesce("content", F.lit(""))) <= MAX_BYTES), F.lit(False))
    return files.where(~by_rules).mapInPandas(run, CAPTURES).unionByName(syntax.pattern_captures(files.where(by_rules)))
