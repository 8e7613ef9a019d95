"""Text blocks for results, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines, trim_all

MARK = "§"
# Messages.
NO_IDENTIFIER = "❌ No identifier detected.\n\nPlease ask in a format like: `Where is SomeName defined?`"
NO_ROOT = "⚠️ Unable to resolve repo_root: needs to be run in a git repository directory (cwd should trace back to `.git`)."
NOT_FOUND = "❌ Definition not found (current MVP only scans top-level definitions)."

NOT_UNDER_ROOT = "❌ File is not under repo_root: {}\nrepo_root: {}"


def strip_line_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*[0-9]+\s?", "")


def plain_line(c: Column) -> Column:
    """A snippet's line without its number and marks, trimmed."""
    return trim_all(F.replace(strip_line_number(c), F.lit(MARK), F.lit("")))


def function_like(c: Column) -> Column:
    s = F.regexp_replace(F.ltrim(c), r"^pub(?: |\([^)]*\))\s*", "")
    for word in ("async", "unsafe", "const", "extern"):
        s = F.regexp_replace(s, rf"^{word}\s*", "")
    return s.startswith("fn ")


def symbol_kind(signature: Column) -> Column:
    s = F.ltrim(F.regexp_extract(signature, r"^([^\n]*)", 1))
    head = lambda word: s.rlike(rf"^(pub )?{word} ")
    return (
        F.when(head("struct"), F.lit("struct")).when(head("enum"), F.lit("enum")).when(head("trait"), F.lit("trait")).when(head("type"), F.lit("type alias"))
        .when(function_like(s), F.lit("function")).when(head("mod"), F.lit("module"))
    )


def signature_label(kind: Column) -> Column:
    return F.when(kind == "function", F.lit("Function signature")).when(kind.isin("struct", "enum", "trait", "type alias", "module"), F.lit("Definition header")).otherwise(F.lit("Definition line"))


def _signature_line(snippet_lines: Column, first: Column) -> Column:
    """The 1-based line that is the signature's first line, or begins with it; 0 if none."""
    plain = F.transform(snippet_lines, plain_line)
    exact = F.coalesce(F.array_position(plain, first), F.lit(0))
    begins = F.coalesce(F.array_position(F.transform(plain, lambda x: x.startswith(first)), True), F.lit(0))
    return F.when(exact > 0, exact).otherwise(begins).cast("int")


def _run_above(snippet_lines: Column, at: Column, test) -> Column:
    """How many lines straight above line ``at`` pass the test."""
    above = F.reverse(F.slice(snippet_lines, 1, F.greatest(at - 1, F.lit(0))))
    return F.aggregate(above, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & test(x)).cast("int")).alias("n"), (a["on"] & test(x)).alias("on")), lambda a: a["n"])


def doc_comment(snippet: Column, signature: Column) -> Column:
    """The /// lines straight above the signature. Lines that carry a number are no such lines."""
    ls, first = lines(snippet), trim_all(F.regexp_extract(signature, r"^([^\n]*)", 1))
    at = _signature_line(ls, first)
    n = _run_above(ls, at, lambda x: F.ltrim(x).startswith("///"))
    doc = F.transform(F.slice(ls, F.greatest(at - n, F.lit(1)), n), lambda x: F.ltrim(F.regexp_replace(F.ltrim(x), "^///", "")))
    return F.when((at > 0) & (n > 0), F.array_join(doc, "\n")).otherwise(F.lit(""))


def trim_to_definition(snippet: Column, signature: Column) -> Column:
    """The snippet from the signature on, with doc lines and attributes straight above it."""
    ls, first = lines(snippet), trim_all(F.regexp_extract(F.coalesce(signature, F.lit("")), r"^([^\n]*)", 1))
    at = _signature_line(ls, first)
    head = lambda x: F.ltrim(strip_line_number(x)).rlike(r"^(///|#\[)")
    start = at - _run_above(ls, at, head)
    return F.when((first == "") | (at == 0), snippet).otherwise(F.array_join(F.slice(ls, F.greatest(start, F.lit(1)), F.greatest(F.size(ls) - start + 1, F.lit(0))), "\n"))


def highlight(c: Column, color: bool = True) -> Column:
    """Marks as reverse video on and off, closed at the end if uneven; or taken away."""
    if not color:
        return F.replace(c, F.lit(MARK), F.lit(""))
    parts = F.split(c, MARK, -1)
    on, off = F.lit("\x1b[7m"), F.lit("\x1b[0m")
    joined = F.array_join(F.transform(parts, lambda x, i: F.concat(F.when(i == 0, F.lit("")).when(i % 2 == 1, on).otherwise(off), x)), "")
    return F.concat(joined, F.when(F.size(parts) % 2 == 0, off).otherwise(F.lit("")))


def snippet(content: Column, line: Column, context: int | Column = 3, numbers: bool = True, mark_line: Column | None = None, mark_from: Column | None = None, mark_to: Column | None = None) -> Column:
    """Lines around a 0-based line, numbered from 1 in four columns or as many as a number needs; the marked range, in characters, between marks."""
    from .text import raw_lines

    ls = raw_lines(content)
    around = F.lit(context) if isinstance(context, int) else context
    focus = F.least(line, F.size(ls) - 1)
    first = F.greatest(focus - around, F.lit(0))
    part = F.slice(ls, first + 1, F.least(focus + around, F.size(ls) - 1) - first + 1)

    def show(x: Column, i: Column) -> Column:
        if mark_line is not None:
            hit = (first + i == mark_line) & (mark_to > mark_from)
            mid = F.concat(F.substr(x, F.lit(1), mark_from), F.lit(MARK), F.substr(x, mark_from + 1, mark_to - mark_from), F.lit(MARK), F.substr(x, mark_to + 1))
            x = F.when(hit, mid).otherwise(x)
        number = (first + i + 1).cast("string")
        return F.concat(F.lpad(number, F.greatest(F.length(number), F.lit(4)), " "), F.lit(" "), x) if numbers else x

    return F.array_join(F.transform(part, show), "\n")


def found_header(names: Column) -> Column:
    n = F.size(names)
    found = F.when(n == 0, F.lit("[No identifier detected]\n")).when(n == 1, F.concat(F.lit("[Found identifier: "), F.get(names, F.lit(0)), F.lit("]\n"))).otherwise(F.concat(F.lit("[Found identifiers: "), F.array_join(names, ", "), F.lit("]\n")))
    return F.concat(F.lit("🤔 Thinking...\n"), found, F.when(n > 0, F.lit("[Searching with ScopeGraph...]\n\n")).otherwise(F.lit("\n")))


def result_block(name: Column, path: Column, line: Column, signature: Column, text: Column, others: Column, references: Column, explain: bool = False, color: bool = False) -> Column:
    """A found symbol: place, signature, kind and documentation if explained, snippet, five other places, ten references.

    others, references: arrays of struct(path, line), lines 0-based.
    """
    place = lambda x: F.concat(F.lit("- "), x["path"], F.lit(":"), (x["line"] + 1).cast("string"), F.lit("\n"))
    listed = lambda title, xs, n: F.when(F.size(xs) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(F.transform(F.slice(xs, 1, n), place), ""))).otherwise(F.lit(""))
    kind, at = symbol_kind(signature), F.concat(path, F.lit(":"), (line + 1).cast("string"), F.lit("\n"))
    head = F.when(signature.isNotNull(), F.concat(signature_label(kind), F.lit(" (approximate): "), signature, F.lit("\n"))).otherwise(F.lit(""))
    if explain:
        doc = doc_comment(text, signature)
        more = F.concat(F.when(kind.isNotNull(), F.concat(F.lit("Type determined: "), kind, F.lit("\n"))).otherwise(F.lit("")), F.when(doc != "", F.concat(F.lit("Documentation comments (excerpt):\n"), doc, F.lit("\n"))).otherwise(F.lit("")))
        head = F.when(signature.isNotNull(), F.concat(head, more)).otherwise(head)
        text = trim_to_definition(text, signature)
    return F.concat(F.lit("✅ Found in "), at, name, F.lit(" defined at "), at, head, F.lit("\nCode snippet:\n"), highlight(text, color), F.lit("\n"), listed("Other candidate definitions", others, 5), listed("Referenced by", references, 10))


def sessions_list(sessions: Column, current: Column) -> Column:
    """sessions: array of struct(id, title, message_count) in order."""
    row = lambda s: F.concat(F.lit(" "), s["id"], F.lit(" - "), F.coalesce(s["title"], F.lit("(untitled)")), F.lit(" ("), s["message_count"].cast("string"), F.lit(" messages)"), F.when(s["id"] == current, F.lit(" [current]")).otherwise(F.lit("")), F.lit("\n"))
    return F.concat(F.lit("Active sessions:\n"), F.when(F.size(sessions) == 0, F.lit(" (none)\n")).otherwise(F.array_join(F.transform(sessions, row), "")))
