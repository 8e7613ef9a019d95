"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for trimming and splitting.
WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def byte_tokens(c: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(c) / 4).cast("long")


def char_tokens(c: Column, steps: Column | None = None) -> Column:
    """A quarter of the characters, rounded up, and 30 for each step of a plan."""
    n = F.ceil(F.char_length(c) / 4).cast("long")
    return n if steps is None else n + steps.cast("long") * 30


def too_long(c: Column, most: int = 32_000) -> Column:
    return F.char_length(c) > most


def lines(c: Column) -> Column:
    """Lines without their ends; an end of the text after a line break makes no line, and empty text has none."""
    body = F.regexp_replace(c, r"\n\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", "")))


def raw_lines(c: Column) -> Column:
    """Lines between line breaks, one more than there are breaks; a carriage return at a line's end is dropped."""
    return F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))


def identifiers_dedup(c: Column) -> Column:
    """Distinct identifiers by first place."""
    return F.array_distinct(identifiers(c))


def best_identifier(c: Column) -> Column:
    """The first identifier with an underscore, else the longest (the last of equals); null without any."""
    names = identifiers(c)
    longest = F.aggregate(names, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) >= F.length(a)), x).otherwise(a))
    return F.coalesce(F.get(F.filter(names, lambda x: x.contains("_")), F.lit(0)), longest)


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("bigint"))


def file_position(c: Column) -> Column:
    """struct(path, line, col), 0-based, of the first word that reads path:line or path:line:col; null without any."""

    def parse(word: Column) -> Column:
        three = word.rlike(r"(?s)^.*:[^:]*:[^:]*$")
        path = F.when(three, F.regexp_extract(word, r"(?s)^(.*):[^:]*:[^:]*$", 1)).otherwise(F.regexp_extract(word, r"(?s)^([^:]*):[^:]*$", 1))
        last = F.regexp_extract(word, r"(?s)([^:]*)$", 1)
        line = _number(F.when(three, F.regexp_extract(word, r"(?s)([^:]*):[^:]*$", 1)).otherwise(last))
        col = F.coalesce(F.when(three, _number(last)), F.lit(1).cast("bigint"))
        return F.when(word.contains(":") & (line > 0) & (col > 0), F.struct(path.alias("path"), (line - 1).alias("line"), (col - 1).alias("col")))

    words = F.transform(F.split(trim_all(c), rf"{WS}+"), lambda w: parse(F.regexp_replace(w, r"""^[(),;"']+|[(),;"']+\z""", "")))
    return F.get(F.filter(words, lambda x: x.isNotNull()), F.lit(0))


def replace_lines(content: Column, first: Column, last: Column, new: Column) -> Column:
    """The content with the 1-based inclusive line range replaced; a final line break stays. Null if out of range."""
    old = lines(content)
    ok = (first >= 1) & (first <= last) & (last <= F.size(old))
    rest = F.size(old) - last
    head = F.when(ok, F.slice(old, 1, first - 1))
    tail = F.when(ok & (rest > 0), F.slice(old, last + 1, rest)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(F.concat(head, F.array(new), tail), "\n"), F.when(content.endswith("\n"), F.lit("\n")).otherwise(F.lit("")))


def read_prefix(binary: Column, most: int = 65_536) -> Column:
    """The first bytes of a file as text, invalid bytes replaced."""
    return F.make_valid_utf8(F.substring(binary, 1, most).cast("string"))


def resolve_path(path: Column, repo_root: Column, cwd: Column) -> Column:
    """Absolute paths as they are, others below the repository root, else the working folder, else as they are."""
    return F.when(path.startswith("/"), path).otherwise(F.coalesce(F.concat(repo_root, F.lit("/"), path), F.concat(cwd, F.lit("/"), path), path))


def truncate_output(c: Column, most: int = 500) -> Column:
    """At most ``most`` bytes, cut before a character that would be split, and then three dots."""
    cut = F.make_valid_utf8(F.substring(F.encode(c, "utf-8"), 1, most).cast("string"))
    return F.when(F.octet_length(c) > most, F.concat(F.regexp_replace(cut, "�+$", ""), F.lit("..."))).otherwise(c)


def extract_json(c: Column) -> Column:
    """What a fenced block holds, without a line that says json, or else the whole text; trimmed."""
    s = trim_all(c)
    block = F.regexp_extract(s, r"(?s)^.*?```(.*)```[^`]*", 1)
    fenced = s.rlike(r"(?s)```.*```")
    return F.when(fenced, trim_all(F.regexp_replace(F.regexp_replace(block, rf"^{WS}+", ""), rf"^(?:{WS}*(?:json|JSON){WS}*(?:\n|\z))+", ""))).otherwise(s)
