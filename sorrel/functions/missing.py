"""Symbols that an answer says it lacks. The scan for them walks text with state, so it is a pandas UDF over Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases before and after a missing symbol, and words that are not one.
BEFORE = ("don't see", "doesn't show", "missing", "not shown", "need to see", "where is", "can't find")
AFTER = (" is not defined", " is undefined", " not found")
FILLERS = (
    "the", "any", "an", "a", "its", "this", "that", "of", "for", "in", "to", "implementation", "definition", "reference", "function", "method",
    "struct", "class", "module", "variable", "field", "property", "type",
)
STOP_WORDS = (
    "i", "the", "a", "an", "it", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above", "below", "between", "under", "and", "but", "or", "yet", "so", "if", "because",
    "although", "though", "while", "where", "when", "that", "which", "who", "whom", "whose", "what", "whatever", "whoever",
)
TYPE_WORDS = (
    "function", "fn", "method", "struct", "class", "enum", "trait", "impl", "module", "mod", "variable", "var", "let", "const", "static", "type",
    "field", "property", "argument", "arg", "parameter", "param", "the",
)


def first_identifier(text: str) -> tuple[str, int] | None:
    """The first word of letters, digits and underscores and its place; none if it is a stop word or one lower-case letter."""
    at = next((i for i, c in enumerate(text) if c.isalpha() or c == "_"), None)
    if at is None:
        return None
    end = next((i for i in range(at, len(text)) if not (text[i].isalnum() or text[i] == "_")), len(text))
    word = text[at:end]
    if word.lower() in STOP_WORDS or (len(word.encode()) < 2 and not word[0].isupper()):
        return None
    return word, at


def symbol_after(text: str) -> str | None:
    rest = text.lstrip()
    while rest:
        end = next((i for i, c in enumerate(rest) if not c.isalpha()), len(rest))
        if rest[:end].lower() not in FILLERS:
            break
        rest = rest[end:].lstrip()
    found = first_identifier(rest)
    return found[0] if found else None


def symbol_before(text: str) -> str | None:
    """The last candidate that is no type word. After a stop word the search goes on one character later, so a stop
    word's own tail may become a candidate."""
    out, i = None, 0
    while i < len(text):
        found = first_identifier(text[i:])
        if found is None:
            i += 1
            continue
        if found[0].lower() not in TYPE_WORDS:
            out = found[0]
        i += found[1] + len(found[0])
    return out


def missing_in(text: str | None) -> list[str]:
    out: list[str] = []
    text = text or ""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for p in BEFORE:
        if (at := low.find(p)) >= 0 and (s := symbol_after(text[at + len(p) :])):
            out.append(s)
    for p in AFTER:
        if (at := low.find(p)) >= 0 and (s := symbol_before(text[:at])):
            out.append(s)
    return list(dict.fromkeys(out))


def _missing(texts: pd.Series) -> pd.Series:
    return texts.map(missing_in)


def missing_symbols(c: Column) -> Column:
    """Missing symbols by pattern, distinct. Texts without any phrase never reach Python."""
    low = F.lower(c)
    there = F.lit(False)
    for p in (*BEFORE, *AFTER):
        there = there | low.contains(p)
    return F.when(there, F.pandas_udf(_missing, "array<string>")(F.when(there, c))).otherwise(F.array().cast("array<string>"))
