"""Brace languages as a table of tokens in a bracket tree, and captures from it by rules that are data.

A row is a token with its place in the tree: the bracket group it lies in, the item (statement, field, declaration) of that
group, and what stands before it in the item, after it, and before its group. The words before it are a short text of one
character for each, closed groups as a pair of brackets, so that a rule can ask for a declaration's form by a regular
expression. Rules are conditions on these columns, equal to a value, one of some, or matching a pattern. They are compiled
to one projection, so all languages and files take one pass over the tokens and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an item that a token's ``lead`` shows at most, the nearest ones.
LEAD = 200
PLACES = ("start", "end", "item_start", "item_end", "close_end", "prev_start")
_TEXTS = ("lang", "code", "text", "lead", "follow", "prev", "next", "after", "open", "owner", "owner_prev")
TOKENS = ", ".join([
    "file_id string, ix int, group int, item int",
    *(f"{c} string" for c in _TEXTS),
    *(f"{p}_{x} int" for p in PLACES for x in ("byte", "line", "col")),
])


@dataclass(frozen=True)
class Lexicon:
    """A language's words by the character that stands for them in a lead, and where its items end.

    after_block: leads that go on after a closing brace. newlines: line ends end an item unless these precede them. labels:
    leads that a colon ends.
    """

    codes: dict[str, tuple[str, ...]]
    after_block: str = "."
    newlines: tuple[str, ...] | None = None
    labels: str = r"^$"
    directives: bool = False
    words: dict[str, str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "words", {w: code for code, words in self.codes.items() for w in words})


# Reserved words by their part in a statement.
LEXICONS = {
    "c": Lexicon(
        {
            "T": ("auto", "bool", "char", "const", "double", "extern", "float", "inline", "int", "long", "register", "restrict", "short", "signed", "size_t", "static", "unsigned", "void", "volatile"),
            "S": ("struct", "union"),
            "E": ("enum",),
            "y": ("typedef",),
            "K": ("break", "continue", "do", "else", "for", "if", "return", "sizeof", "switch", "while"),
            "g": ("goto",),
            "c": ("case", "default"),
        },
        after_block=r"=|^y|^[TN*]*[SE]N?\{\}$",
        labels=r"^(?:c[^?]*|N)$",
        directives=True,
    ),
    "go": Lexicon(
        {
            "F": ("func",),
            "Y": ("type",),
            "V": ("var",),
            "C": ("const",),
            "I": ("import",),
            "P": ("package",),
            "s": ("struct",),
            "i": ("interface",),
            "m": ("chan", "map"),
            "K": ("defer", "else", "for", "go", "if", "range", "select", "switch"),
            "R": ("return",),
            "b": ("break", "continue", "goto"),
            "c": ("case", "default"),
        },
        newlines=("(", "[", "{", ",", ";", ".", "=", ":=", "+", "-", "*", "/", "&&", "||", ":"),
        labels=r"^(?:c.*|N)$",
    ),
    "rust": Lexicon(
        {
            "F": ("fn",),
            "S": ("struct", "union"),
            "E": ("enum",),
            "t": ("trait",),
            "i": ("impl",),
            "m": ("mod",),
            "y": ("type",),
            "C": ("const", "static"),
            "l": ("let",),
            "u": ("use",),
            "q": ("async", "extern", "mut", "pub", "ref", "unsafe"),
            "a": ("as",),
            "w": ("dyn", "where"),
            "K": ("break", "continue", "else", "for", "if", "in", "loop", "match", "move", "return", "while"),
            "Z": ("Self",),
            "O": ("self",),
            "T": ("bool", "char", "crate", "f32", "f64", "i128", "i16", "i32", "i64", "i8", "isize", "str", "super", "u128", "u16", "u32", "u64", "u8", "usize"),
        },
        after_block=r"^q*l|^[^K{}F]*=",
    ),
}
_MARKS = {":=": "A", "->": "r", "=>": "f", "::": "d", "...": "e", "++": "p", "--": "p"}
# what begins with a letter or is always one mark comes first, as most tokens are such
_SPLIT = re.compile(
    r"""(?P<name>[^\W\d]\w*!?(?=[({\[])|[^\W\d]\w*)|(?P<one>[(){}\[\];,])|(?P<skip>//[^\n]*|/\*.*?\*/|\\\n)|(?P<directive>(?<![^\n])[ \t]*\#[^\n]*(?<!\\)(?:\n(?<=\\\n)[^\n]*)*)"""
    r"""|(?P<text>"(?:\\.|[^"\\])*"|`[^`]*`|'(?:\\[^\n]{1,8}|[^'\\\n])')|(?P<life>'[A-Za-z_]\w*)|(?P<number>\d(?:\w|\.(?=\d))*)|(?P<mark>:=|->|=>|::|\.\.\.|\+\+|--|[=!<>+\-*/%&|^]=|&&|\|\||<<|>>|[^\w\s])""",
    re.S,
)
_DIRECTIVE = re.compile(r"""[ \t]*(\#[ \t]*(?:include|define))[ \t]+(<[^>\n]*>|"[^"\n]*"|\w+)""")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def _split(text: str, lexicon: Lexicon) -> list[tuple[str, str, int, int]]:
    """(code, text, start, end) of each token, in characters."""
    out = []
    words = lexicon.words
    for m in _SPLIT.finditer(text):
        what, word = m.lastgroup, m[0]
        a, b = m.span()
        if what == "name":
            if word[-1] == "!":
                word, b = word[:-1], b - 1
            out.append((words.get(word, "N"), word, a, b))
        elif what == "one":
            out.append((word, word, a, b))
        elif what == "skip":
            continue
        elif what == "directive" and lexicon.directives:
            if d := _DIRECTIVE.match(word):
                out.append(("#", d[1].replace(" ", "").replace("\t", ""), a + d.start(1), a + d.end(1)))
                out.append(("H" if d[2][0] in '<"' else "N", d[2], a + d.start(2), a + d.end(2)))
        elif what == "directive":
            a += len(word) - len(word.lstrip())
            out.append(("o", "#", a, a + 1))
        elif what in ("text", "number"):
            out.append(("L", word, a, b))
        elif what == "life":
            out.append(("l" if "t" not in lexicon.codes else "'", word, a, b))
        else:
            out.append((_MARKS.get(word, word if len(word) == 1 else "o"), word, a, b))
    return out


def tree_of(text: str, lexicon: Lexicon, wanted: tuple[frozenset[str], frozenset[str]] | None = None) -> list[tuple]:
    """The tokens of a text with their places in the bracket tree, as in TOKENS from ix on but places in characters.

    wanted: codes and texts; of the tokens that have neither of them no row is made. They keep their part in the tree.
    """
    toks = _split(text, lexicon)
    codes = "".join(t[0] for t in toks)
    newline = [0, *accumulate(text.count("\n", a[3], b[2]) for a, b in zip(toks, toks[1:], strict=False))] if toks else []
    close: dict[int, int] = {}
    item_end: dict[int, int] = {}
    rows, goes_on, labels = [], re.compile(lexicon.after_block), re.compile(lexicon.labels)
    # a frame: its opener, the lead of its present item, the item's first token, the section that is open
    stack = [[-1, "", None, None]]

    def end_item(frame: list, last: int) -> None:
        if frame[2] is not None:
            item_end[frame[2]] = last
        frame[1], frame[2] = "", None

    for i, (code, word, _, _) in enumerate(toks):
        frame, fresh = stack[-1], i > 0 and newline[i] > newline[i - 1]
        lined = lexicon.newlines is not None and toks[i - 1][1] not in lexicon.newlines and toks[i - 1][0] not in "VCYIKR"
        if fresh and frame[2] is not None and (lined or frame[1].startswith("#")) or code == "#":
            end_item(frame, i - 1)
        if word in _CLOSE and len(stack) > 1:
            end_item(frame, i - 1)
            if frame[3] is not None:
                close[frame[3]] = i - 1
            stack.pop()
            opener, frame = frame[0], stack[-1]
            close[opener] = i
            rows.append((i, frame[0], frame[2] if frame[2] is not None else i, code, word, frame[1]))
            frame[1] = (frame[1] + word)[-LEAD:]
            over = lexicon.newlines is None and (i + 1 == len(toks) or toks[i + 1][1] != "else")
            if word == "}" and over and not goes_on.search(frame[1]):
                end_item(frame, i)
            continue
        if word in _CLOSE:  # one that closes nothing
            end_item(frame, i - 1)
            rows.append((i, frame[0], i, code, word, ""))
            continue
        if frame[2] is None:
            frame[2] = i
        if code == "c":
            if frame[3] is not None:
                close[frame[3]] = i - 1
            frame[3] = i
        rows.append((i, frame[0], frame[2], code, word, frame[1]))
        if word == ":" and labels.search(frame[1]) or word == ";":
            end_item(frame, i)
        else:
            frame[1] = (frame[1] + code)[-LEAD:]
        if word in _OPEN:
            stack.append([i, "", None, None])
    for frame in stack:
        end_item(frame, len(toks) - 1)
    if wanted is not None:
        kept_codes, kept_texts = wanted
        kept = [r for r in rows if r[3] in kept_codes or r[4] in kept_texts]
    else:
        kept = rows
    n, out = len(toks), []
    for i, group, item, code, word, lead in kept:
        _, _, start, end = toks[i]
        before = toks[i - 1] if i else None
        last = close.get(i, i)
        opener, owner = (toks[group][1], rows[group][5]) if group >= 0 else ("", "")
        out.append((
            i, group, item, code, word, lead, codes[i + 1 : i + 9], before[1] if before else "", toks[i + 1][1] if i + 1 < n else "",
            toks[last + 1][1] if word in _OPEN and last + 1 < n else "", opener, owner, toks[group - 1][1] if group > 0 else "",
            start, end, toks[item][2], toks[item_end.get(item, i)][3], toks[last][3], before[2] if before else start,
        ))
    return out


#: Rows of an Arrow batch of tokens.
BATCH_TOKENS = 8192


def tokens(files: DataFrame, wanted: dict[str, tuple[frozenset[str], frozenset[str]]] | None = None) -> DataFrame:
    """The token table of files (file_id, lang, content) in languages that have a lexicon; see the module.

    wanted: for each language the codes and the texts of tokens that are asked for, see :func:`tree_of`.
    """
    schema = TOKENS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        held: list[tuple] = []
        size = 0
        for b in batches:
            for file_id, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = tree_of(text or "", LEXICONS[lang], wanted and wanted[lang])
                where = _places(text, rows) if rows else None
                for at in range(0, len(rows), BATCH_TOKENS):
                    held.append((file_id, lang, rows[at : at + BATCH_TOKENS], where[:, :, at : at + BATCH_TOKENS]))
                    size += len(held[-1][2])
                    if size >= BATCH_TOKENS:
                        yield _batch(held, names)
                        held, size = [], 0
        if held:
            yield _batch(held, names)

    return files.where(F.lower("lang").isin(*LEXICONS)).select("file_id", F.lower("lang"), "content").mapInArrow(read, schema)


def _places(text: str, rows: list[tuple]) -> np.ndarray:
    """Byte, line and column of each place of rows: an array of places, these three, rows."""
    at = np.array([r[13:] for r in rows], np.int32).T
    starts = np.array([0, *(m.end() for m in re.finditer("\n", text))], np.int32)
    line = np.searchsorted(starts, at, "right").astype(np.int32) - 1
    if not text.isascii():
        sizes = np.array([0, *accumulate(len(c.encode()) for c in text)], np.int32)
        at, starts = sizes[at], sizes[starts]
    return np.stack([at, line, at - starts[line]], 1)


def _batch(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Parts of files (file_id, lang, rows, places) as one batch."""
    cols = list(zip(*(r for _, _, rows, _ in held for r in rows), strict=True))
    places = np.concatenate([p for *_, p in held], 2)
    of_file = lambda k: pa.array([x for part in held for x in [part[k]] * len(part[2])], pa.string())
    head = [of_file(0), *(pa.array(c, pa.int32()) for c in cols[:3]), of_file(1)]
    return pa.RecordBatch.from_arrays([*head, *(pa.array(c, pa.string()) for c in cols[3:13]), *(pa.array(x) for p in places for x in p)], names)


@dataclass(frozen=True)
class Rule:
    """A capture for tokens on which all conditions hold; ``begin`` and ``end`` name the places of its range.

    A condition is a column and what it must equal, be one of (a tuple) or match (a compiled pattern); with ``not_`` before
    the column's name it must not.
    """

    capture: str
    where: dict[str, object]
    begin: str = "start"
    end: str = "end"


def condition(name: str, wanted: object) -> Column:
    c = F.col(name.removeprefix("not_"))
    if isinstance(wanted, re.Pattern):
        out = c.rlike(wanted.pattern)
    else:
        out = c.isin(*wanted) if isinstance(wanted, tuple) else c == F.lit(wanted)
    return ~out if name.startswith("not_") else out


def matches(rule: Rule) -> Column:
    # values first, as they are cheaper than patterns and most tokens fail them
    return reduce(Column.__and__, (condition(*x) for x in sorted(rule.where.items(), key=lambda x: isinstance(x[1], re.Pattern))))


def _r(pattern: str) -> re.Pattern:
    return re.compile(pattern)


_TYPE = r"(?:T|[SE]N(?:\{\})?|[SE]\{\}|N)"
_C_FUNCTION = _r(rf"^{_TYPE}+\**$")
_C_LIST = _r(rf"^y?{_TYPE}+\**N$")
_GO_LIST = _r(r"F(?:\(\)N|N)?(?:\[\])?$")
_RUST_TYPE = r"(?:[^<>]|<[^<>]*>)"
_RUST_LIST = _r(rf"FN(?:<{_RUST_TYPE}*>)?$")
_RUST_FIELDS = _r(r"SN(?:<.*>)?$|EN(?:<.*>)?\{?N$")
#: Names are captured by the first rule that holds, of which a capture None means none; scopes by every one.
NAMES = {
    "c": (
        Rule("local.definition.header", {"code": "H"}),
        Rule("local.definition.macro", {"code": "N", "prev": "#define"}),
        Rule("local.definition.struct", {"code": "N", "prev": "struct", "next": "{"}),
        Rule("local.definition.union", {"code": "N", "prev": "union", "next": "{"}),
        Rule("local.definition.enum", {"code": "N", "prev": "enum", "next": "{"}),
        Rule("local.reference", {"code": "N", "prev": ("struct", "union", "enum")}),
        Rule("local.definition.enumerator", {"code": "N", "open": "{", "owner": _r("EN?$"), "lead": _r("(?:^|,)$")}),
        Rule("local.definition.label", {"code": "N", "next": ":", "lead": "", "open": "{", "not_owner": _r("SN?$")}),
        Rule("local.definition.typedef", {"code": "N", "lead": _r(r"^y.*[}TN*]$"), "next": (";", ",", "[")}),
        Rule("hoist.definition.function", {"code": "N", "lead": _C_FUNCTION, "next": "(", "not_open": ("(", "[")}),
        Rule("local.definition.variable", {"code": "N", "open": "(", "owner": _C_LIST, "lead": _r(rf"(?:^|,){_TYPE}+\**$"), "next": (",", ")", "[")}),
        Rule("local.definition.variable", {"code": "N", "lead": _r(rf"^(?:{_TYPE}(?=[TNSE*]|$))+\**(?:.*,\**)?$"), "next": ("=", ";", ",", "["), "not_open": ("(", "["), "not_owner": _r("[SE]N?$")}),
        Rule("local.definition.variable", {"code": "N", "open": "(", "owner_prev": "for", "lead": _r(rf"^{_TYPE}+\**(?:.*,\**)?$"), "next": ("=", ";", ",")}),
        Rule("local.definition.variable", {"code": "N", "lead": _C_FUNCTION, "next": "[", "open": "{", "owner": _r("SN?$")}),
        Rule(None, {"code": "N", "lead": _r(rf"^{_TYPE}+\**(?:.*,\**)?$"), "open": "{", "owner": _r("SN?$")}),
        Rule(None, {"code": "N", "prev": (".", "->")}),
        Rule("local.reference", {"code": "N"}),
    ),
    "go": (
        Rule("local.import", {"code": "N", "prev": "import", "follow": _r("^L")}),
        Rule("local.import", {"code": "N", "open": "(", "owner": "I", "follow": _r("^L")}),
        Rule(None, {"code": "N", "prev": ("package", ".")}),
        Rule("hoist.definition.func", {"code": "N", "lead": _r(r"^F(?:\(\))?$"), "next": ("(", "[")}),
        Rule("hoist.definition.struct", {"code": "N", "prev": "type", "next": "struct"}),
        Rule("hoist.definition.interface", {"code": "N", "prev": "type", "next": "interface"}),
        Rule("local.definition.type", {"code": "N", "prev": "type", "next": "="}),
        Rule("hoist.definition.type", {"code": "N", "prev": "type"}),
        Rule("hoist.definition.struct", {"code": "N", "open": "(", "owner": "Y", "lead": "", "next": "struct"}),
        Rule("hoist.definition.interface", {"code": "N", "open": "(", "owner": "Y", "lead": "", "next": "interface"}),
        Rule("hoist.definition.type", {"code": "N", "open": "(", "owner": "Y", "lead": ""}),
        Rule("local.definition.const", {"code": "N", "lead": _r("^C(?:N,)*$")}),
        Rule("local.definition.const", {"code": "N", "open": "(", "owner": "C", "lead": _r("^(?:N,)*$")}),
        Rule("local.definition.var", {"code": "N", "lead": _r("^V(?:N,)*$")}),
        Rule("local.definition.var", {"code": "N", "open": "(", "owner": "V", "lead": _r("^(?:N,)*$")}),
        Rule("local.definition.var", {"code": "N", "open": "(", "owner": _GO_LIST, "lead": _r("(?:^|,)$"), "follow": _r(r"^(?:,N)*[N*\[mFsie]")}),
        Rule("local.definition.var", {"code": "N", "lead": _r("^[Kc]*(?:N,)*$"), "follow": _r("^(?:,N)*A")}),
        Rule("local.definition.label", {"code": "N", "lead": "", "next": ":", "follow": _r("^:[KbRN{]"), "not_owner": _r(r"[N\]}]$")}),
        Rule("local.definition.member", {"code": "N", "open": "{", "owner_prev": "struct", "lead": _r("^(?:N,)*$"), "follow": _r(r"^(?:,N)*[N*\[mFsi(]")}),
        Rule("local.definition.func", {"code": "N", "open": "{", "owner_prev": "interface", "lead": "", "next": "("}),
        Rule("local.reference.label", {"code": "N", "prev": ("break", "continue", "goto")}),
        Rule("local.reference.module", {"code": "N", "next": ".", "lead": _r(r"^[VC](?:N,)*N[*\[\]]*$|^YN[*\[\]m]*$|^F.*\(\)[*\[\]]*$")}),
        Rule("local.reference.module", {"code": "N", "next": ".", "open": "(", "owner": _GO_LIST, "lead": _r(r"(?:^|,)Ne?[*\[\]m]*$")}),
        Rule("local.reference.type", {"code": "N", "lead": _r(r"^[VC](?:N,)*N[*\[\]m]*$|^YN[*\[\]m]*$|F.*\(\)[*\[\]m]*$")}),
        Rule("local.reference.type", {"code": "N", "open": "(", "owner": "Y", "lead": _r(r"^N[*\[\]m]*$")}),
        Rule("local.reference.type", {"code": "N", "open": "(", "owner": _GO_LIST, "lead": _r(r"(?:^|,)Ne?[*\[\]m]*$")}),
        Rule("local.reference.var", {"code": "N", "open": "(", "owner": _r(r"F.*\(\)$"), "lead": _r("(?:^|,)$"), "follow": _r(r"^(?:,N)*[N*\[mFsi]")}),
        Rule("local.reference.type", {"code": "N", "open": "(", "owner": _r(r"F.*\(\)$")}),
        Rule("local.reference.type", {"code": "N", "open": "{", "owner_prev": "struct"}),
        Rule("local.reference.type", {"code": "N", "prev": "]"}),
        Rule("local.reference.type", {"code": "N", "next": "{", "lead": _r(r"^[^K]*[A=,R&:o]$")}),
        Rule("local.reference.type", {"code": "N", "next": "{", "open": ("(", "["), "lead": ""}),
        Rule("local.reference", {"code": "N", "next": "."}),
        Rule("local.reference.var", {"code": "N"}),
    ),
    "rust": (
        Rule("local.import", {"code": "N", "lead": _r("^q*u"), "next": (";", ",")}),
        Rule("local.import", {"code": "N", "open": "{", "owner": _r("^q*u"), "not_next": ("::", "as")}),
        Rule("hoist.definition.function", {"code": "N", "prev": "fn"}),
        Rule("hoist.definition.struct", {"code": "N", "prev": "struct"}),
        Rule("hoist.definition.union", {"code": "N", "prev": "union"}),
        Rule("hoist.definition.enum", {"code": "N", "prev": "enum"}),
        Rule("hoist.definition.interface", {"code": "N", "prev": "trait"}),
        Rule("hoist.definition.typedef", {"code": "N", "prev": "type"}),
        Rule("local.definition.module", {"code": "N", "prev": "mod"}),
        Rule("local.definition.const", {"code": "N", "lead": _r("^q*Cq*$")}),
        Rule("local.definition.typedef", {"code": "N", "lead": _r(rf"^q*(?:[FSEty]N|i)<(?:{_RUST_TYPE}*,)?$")}),
        Rule("local.definition.lifetime", {"code": "'", "lead": _r(rf"^q*(?:[FSEty]N|i)<(?:{_RUST_TYPE}*,)?$")}),
        Rule("local.definition.label", {"code": "'", "next": ":", "lead": _r("^$|=$")}),
        Rule("local.reference", {"code": "'"}),
        Rule("local.definition.variable", {"code": "N", "open": "(", "owner": _RUST_LIST, "lead": _r("(?:^|,)q*$"), "next": ":"}),
        Rule("local.definition.variable", {"text": "self", "open": "(", "owner": _RUST_LIST}),
        Rule("local.definition.variable", {"code": "N", "lead": _r("l[q&]*$"), "not_next": ("(", "{", "::")}),
        Rule("local.definition.variable", {"code": "N", "open": ("(", "["), "owner": _r("l[q&]*(?:Nd)*N?$"), "lead": _r("(?:^|,)[q&]*$"), "not_next": ("(", "{", "::")}),
        Rule("local.definition.variable", {"code": "N", "open": "{", "owner": _r("l[q&]*(?:Nd)*N$"), "lead": _r("(?:^|,)(?:N:)?[q&]*$"), "next": (",", "}")}),
        Rule("local.definition.variable", {"code": "N", "prev": "for", "next": "in"}),
        Rule("local.definition.variable", {"code": "N", "lead": _r(r"(?:^|[=(,K])\|(?:[^|]*,)?[q&]*$"), "next": ("|", ":", ",")}),
        Rule("local.definition.field", {"code": "N", "open": "{", "owner": _RUST_FIELDS, "lead": _r(rf"(?:^|,)(?:q(?:\(\))?)*$"), "next": ":"}),
        Rule("local.definition.enumerator", {"code": "N", "open": "{", "owner": _r(r"EN(?:<.*>)?$"), "lead": _r("(?:^|,)$")}),
        Rule(None, {"code": "N", "open": "{", "lead": _r("(?:^|,)$"), "next": ":"}),
        Rule(None, {"code": "N", "lead": _r("l[q&]*(?:Nd)*$"), "next": ("(", "{")}),
        # a call of a function of the type itself, or of a method of this object
        Rule("local.reference", {"code": "N", "lead": _r("Zd$"), "next": "("}),
        Rule("local.reference", {"code": "N", "lead": _r(r"O\.$"), "next": "("}),
        Rule(None, {"code": "N", "prev": (".", "::")}),
        Rule("local.reference", {"code": "N"}),
    ),
}
SCOPES = {
    "c": (
        Rule("local.scope", {"text": "{", "lead": _r(rf"^{_TYPE}+\**N\(\)$")}, "item_start", "close_end"),
        Rule("local.scope", {"text": "{", "not_lead": _r(r"EN?$|=")}, "start", "close_end"),
        Rule("local.scope", {"text": "(", "lead": _C_LIST, "not_open": ("(", "["), "not_after": "{"}, "prev_start", "close_end"),
        Rule("local.scope", {"text": "for"}, "start", "item_end"),
        Rule("local.scope", {"text": ("case", "default")}, "start", "close_end"),
    ),
    "go": (
        Rule("local.scope", {"text": "func"}, "start", "item_end"),
        Rule("local.scope", {"text": "type"}, "start", "item_end"),
        Rule("local.scope", {"text": "{", "lead": _r("[KF]|^$|:$")}, "start", "close_end"),
        Rule("local.scope", {"text": "{", "prev": "struct"}, "start", "close_end"),
    ),
    "rust": (
        Rule("local.scope", {"text": ("fn", "impl", "struct", "enum", "union", "trait", "type"), "lead": _r("^q*$")}, "item_start", "item_end"),
        Rule("local.scope", {"text": "if", "follow": _r("^l")}, "start", "item_end"),
        Rule("local.scope", {"text": ("for", "while", "loop"), "lead": _r("^$|[=:f]$")}, "start", "item_end"),
        Rule("local.scope", {"text": "{", "lead": _r(r"^q*[Fimt]|^K|^$|[K=)f]$|K[^{}]*$"), "not_owner": _r("^q*u")}, "start", "close_end"),
    ),
}


def asked_for(rules: Iterable[Rule]) -> tuple[frozenset[str], frozenset[str]]:
    """Codes and texts of the tokens that rules can hold on; each rule asks for a token's code or its text."""
    found: tuple[set[str], set[str]] = (set(), set())
    for r in rules:
        k, value = (0, r.where["code"]) if "code" in r.where else (1, r.where["text"])
        found[k].update(value if isinstance(value, tuple) else (value,))
    return frozenset(found[0]), frozenset(found[1])


def pattern_captures(files: DataFrame) -> DataFrame:
    """Captures of files (file_id, lang, content) by NAMES and SCOPES, with the roots; columns as :mod:`operators.extract` has them.

    Only tokens that a rule can hold on leave the readers.
    """
    from .extract import CAPTURES

    order = {c: i for i, c in enumerate(dict.fromkeys(["local.scope", *sorted({r.capture for rules in NAMES.values() for r in rules if r.capture})]))}
    place = lambda at, name: [F.col(f"{at}_{x}").alias(f"{name}_{x}") for x in ("byte", "line", "col")]

    def made(rule: Rule, k: int, capture: Column) -> Column:
        number = F.when(F.lit(rule.begin) == "item_start", F.col("item")).when(F.lit(rule.begin) == "prev_start", F.col("ix") - 1).otherwise(F.col("ix"))
        named = F.lit(None).cast("string") if rule.capture == "local.scope" else F.col("text")
        return F.struct(capture.alias("capture"), (number * 8 + k).alias("ord"), *place(rule.begin, "start"), *place(rule.end, "end"), named.alias("text"))

    def first(rules: tuple[Rule, ...]) -> Column:
        return reduce(lambda out, r: out.when(matches(r), F.lit(r.capture)), rules, F.when(F.lit(False), F.lit(None).cast("string")))

    # one array holds all that a token gives: its rules stand in the plan once, and in no generated method, which would be
    # one of so many that it is never compiled
    of_name = reduce(lambda out, x: out.when(F.col("lang") == x[0], first(x[1])), NAMES.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    named = F.transform(F.array(of_name), lambda capture: F.when(capture.isNotNull(), made(Rule("name", {}), 0, capture)))
    scopes = reduce(
        lambda out, x: out.when(F.col("lang") == x[0], F.array(*(F.when(matches(r), made(r, k, F.lit("local.scope"))) for k, r in enumerate(x[1])))), SCOPES.items(), F.when(F.lit(False), F.array())
    )
    # a name's token is no scope's: scopes begin at reserved words and brackets
    codes, texts = asked_for(r for rules in NAMES.values() for r in rules)
    given = F.when(F.col("code").isin(*codes) | F.col("text").isin(*texts), named).otherwise(scopes)
    rows = tokens(files, {lang: asked_for([*NAMES[lang], *SCOPES[lang]]) for lang in NAMES})
    found = rows.select("file_id", "lang", F.explode(F.array_compact(given)).alias("c")).select("file_id", "lang", "c.*")
    number = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    text = F.coalesce("content", F.lit(""))
    last = F.substring_index(text, "\n", -1)
    zero = F.lit(0)
    roots = files.where(F.lower("lang").isin(*NAMES)).select("file_id", F.lower("lang").alias("lang"), F.lit("root").alias("capture"), F.lit(-1).alias("capture_ix"), zero.alias("ord"), zero.alias("start_byte"), zero.alias("start_line"), zero.alias("start_col"), F.octet_length(text).alias("end_byte"), (F.size(F.split(text, "\n", -1)) - 1).alias("end_line"), F.octet_length(last).alias("end_col"), F.lit(None).cast("string").alias("text"))
    rows = roots.unionByName(found.withColumn("capture_ix", number[F.col("capture")]))
    return rows.withColumn("error", F.lit(None).cast("string")).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in CAPTURES.split(", ")))
