"""Captures of C, Go and Rust by rules over the token tree, and scope graphs as nested text."""

import re
import textwrap

import pytest
from pyspark.sql import functions as F

from sorrel.functions.languages import symbol_kinds
from sorrel.operators import extract, scope, syntax
from sorrel.operators.stages import checkpointed

C = """\
#include <math.h>
#include "own.h"
#define SIDE 4
#define TWICE(v) v * 2

typedef struct node {
    struct node *next;
    item held[SIDE];
} node;
enum shade { DARK = 1, PALE };
union either { int i; float f; };
int area(int w, int *h);

static int area(int w, int *h) {
    int sum = w * *h, count = 0, grid[SIDE];
    node *first = make((enum shade) DARK);
    for (int i = 0; i < w; i++) {
        sum += TWICE(first->held);
    }
    switch (sum) {
    case PALE:
        goto done;
    default:
        count++;
    }
done:
    return w ? sum : count;
}
"""
GO = """\
package shop

import (
    "fmt"
    money "example.org/money"
)

const (
    small = iota
    large
)
var limit, floor int = 9, 1

type Price money.Amount
type Cart struct {
    Items []Item
    owner, buyer string
}
type Seller interface {
    Sell(c Cart) bool
}

func (c *Cart) Total(rates map[string]Rate, more ...Price) (sum Price, err error) {
    sum, ok := 0, true
next:
    for _, it := range c.Items {
        if p, found := rates[it.Name]; found {
            sum += p
            continue next
        }
    }
    show := func(x int) { fmt.Println(x) }
    show(large)
    return Cart{owner: ok}, nil
}
"""
RUST = """\
use std::collections::{HashMap, BTreeMap as Sorted};
pub struct Shelf<T> { pub books: Vec<T>, size: usize }
enum Genre { Prose, Verse(u8) }
type Key = u64;
const LIMIT: usize = 10;
trait Lend<'a> { fn lend(&'a self); }
impl<'a, T: Clone> Lend<'a> for Shelf<T> {
    fn lend(&'a self) {
        let (left, mut right) = (LIMIT, self.size);
        let map = HashMap::new();
        if let Some(one) = left {
            one + right;
        } else {
            self.close(map);
        }
        'outer: for book in self.books { break 'outer; }
        let count = |n: usize, m| n + m;
        Self::done(count);
    }
}
fn build(size: Key) -> Genre { Shelf { books: size, size }; Genre::Prose }
"""


def captured(src, lang):
    """(capture, text) of all names by the rules, in plain Python, in order of place."""

    def holds(rule, row):
        for name, wanted in rule.where.items():
            value = row[name.removeprefix("not_")]
            ok = bool(re.search(wanted.pattern, value)) if isinstance(wanted, re.Pattern) else value in wanted if isinstance(wanted, tuple) else value == wanted
            if ok == name.startswith("not_"):
                return False
        return True

    columns = ["ix", "group", "item", "code", "text", "lead", "follow", "prev", "next", "after", "open", "owner", "owner_prev", *syntax.PLACES]
    out = []
    for t in syntax.tree_of(src, syntax.LEXICONS[lang]):
        row = dict(zip(columns, t, strict=True))
        first = next((r.capture for r in syntax.NAMES[lang] if holds(r, row)), None)
        if first:
            out.append((first, row["text"], row["start"]))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    files = spark.createDataFrame([("c", "c", C), ("go", "go", GO), ("rust", "Rust", RUST), ("e", "c", ""), ("n", "go", None), ("py", "python", "a = 1\n"), ("big", "c", "int a;" * 100_000)], "file_id string, lang string, content string")
    return files, checkpointed(extract.extract(files))


def test_compiled_rules_equal_plain_ones(rows):
    _, found = rows
    for lang, src in (("c", C), ("go", GO), ("rust", RUST)):
        mine = found.where((F.col("file_id") == lang) & F.col("capture_ix").isNotNull() & ~F.col("capture").isin("root", "local.scope"))
        got = sorted((r.start_byte, r.end_byte, r.capture, r.text) for r in mine.collect())
        assert got == sorted((a, a + len(t), c, t) for c, t, a in captured(src, lang))
    assert [r.error for r in found.where("file_id = 'big'").collect()] == [extract.TOO_LARGE]
    assert [r.capture for r in found.where("file_id in ('e', 'n')").collect()] == ["root", "root"]
    assert found.where("file_id = 'py' and capture like '%definition%'").count() == 1


def definitions(src, lang):
    out = {}
    for capture, text, _ in captured(src, lang):
        if ".definition." in capture:
            out.setdefault(capture.split(".")[2], []).append(text)
    return out


def test_definitions_of_each_kind():
    assert definitions(C, "c") == {
        "header": ["<math.h>", '"own.h"'], "macro": ["SIDE", "TWICE"], "struct": ["node"], "typedef": ["node"], "enum": ["shade"], "enumerator": ["DARK", "PALE"], "union": ["either"],
        "function": ["area", "area"], "variable": ["held", "w", "h", "w", "h", "sum", "count", "grid", "first", "i"], "label": ["done"],
    }
    assert definitions(GO, "go") == {
        "const": ["small", "large"], "var": ["limit", "floor", "c", "rates", "more", "sum", "ok", "_", "it", "p", "found", "show", "x"], "type": ["Price"], "struct": ["Cart"],
        "interface": ["Seller"], "member": ["Items", "owner", "buyer"], "func": ["Sell", "Total"], "label": ["next"],
    }
    assert definitions(RUST, "rust") == {
        "struct": ["Shelf"], "typedef": ["T", "Key", "T"], "field": ["books", "size"], "enum": ["Genre"], "enumerator": ["Prose", "Verse"], "const": ["LIMIT"], "interface": ["Lend"],
        "lifetime": ["'a", "'a"], "function": ["lend", "lend", "build"], "variable": ["self", "self", "left", "right", "map", "one", "book", "count", "n", "m", "size"], "label": ["'outer"],
    }


def test_imports_references_and_what_is_none():
    names = lambda src, lang, capture: [t for c, t, _ in captured(src, lang) if c == capture]
    assert names(GO, "go", "local.import") == ["money"] and names(GO, "go", "local.reference.label") == ["next"]
    assert names(GO, "go", "local.reference.module") == ["money"] and {"Item", "Cart", "Rate", "Price"} <= set(names(GO, "go", "local.reference.type"))
    assert names(RUST, "rust", "local.import") == ["HashMap", "Sorted"]
    assert {"sum", "err", "found"} <= set(names(GO, "go", "local.reference.var")) and "Some" not in names(RUST, "rust", "local.reference")
    refs = names(RUST, "rust", "local.reference")
    assert "done" in refs and "close" in refs and "new" not in refs and refs.count("'a") == 3  # calls of the type itself and of this object count
    assert "next" not in names(C, "c", "local.reference") and names(C, "c", "local.reference").count("held") == 0


def test_scopes_of_c_as_text(spark, rows):
    files, _ = rows
    src = "enum kind { ONE };\nint twice(int n);\nint twice(int n) {\n    for (int i = 0; i < n; i++) n += ONE;\n    return n;\n}\n"
    files = spark.createDataFrame([("a", "c", src), ("b", "c", "int a;")], "file_id string, lang string, content string")
    graph = scope.build_scope_graph(checkpointed(extract.extract(files)), symbol_kinds(spark), keep=checkpointed)
    got = {r.file_id: r.tree for r in scope.debug_text(graph, files, checkpointed).collect()}
    assert got["b"] == 'scope {\n    definitions: [\n        a {\n            kind: "variable",\n            context: "int §a§;",\n        },\n    ],\n    child scopes: [],\n}'
    assert got["a"] == textwrap.dedent('''\
        scope {
            definitions: [
                kind {
                    kind: "enum",
                    context: "enum §kind§ { ONE };",
                },
                ONE {
                    kind: "enumerator",
                    context: "enum kind { §ONE§ };",
                    referenced in (1): [
                        `for (int i = 0; i < n; i++) n += §ONE§;`,
                    ],
                },
                twice {
                    kind: "function",
                    context: "int §twice§(int n);",
                },
                twice {
                    kind: "function",
                    context: "int §twice§(int n) {",
                },
            ],
            child scopes: [
                scope {
                    definitions: [
                        n {
                            kind: "variable",
                            context: "int twice(int §n§);",
                        },
                    ],
                    child scopes: [],
                },
                scope {
                    definitions: [
                        n {
                            kind: "variable",
                            context: "int twice(int §n§) {",
                            referenced in (3): [
                                `for (int i = 0; i < §n§; i++) n += ONE;`,
                                `for (int i = 0; i < n; i++) §n§ += ONE;`,
                                `return §n§;`,
                            ],
                        },
                    ],
                    child scopes: [
                        scope {
                            definitions: [],
                            child scopes: [
                                scope {
                                    definitions: [
                                        i {
                                            kind: "variable",
                                            context: "for (int §i§ = 0; i < n; i++) n += ONE;",
                                            referenced in (2): [
                                                `for (int i = 0; §i§ < n; i++) n += ONE;`,
                                                `for (int i = 0; i < n; §i§++) n += ONE;`,
                                            ],
                                        },
                                    ],
                                    child scopes: [],
                                },
                            ],
                        },
                    ],
                },
            ],
        }''')


def test_places_and_odd_texts():
    src = "/* é */ int größe = 1;\n// \"open\nchar *s = \"a\\\"{\"; int after;\n#if X\nint z;\n#endif\n}}} int last;"
    found = captured(src, "c")
    assert [t for c, t, _ in found if "variable" in c] == ["größe", "s", "after", "z", "last"]
    for lang in syntax.LEXICONS:
        for text in ("", "}", "({[", "'", '"', "a" * 5000, "f(" * 3000, "a, " * 5000):
            assert len(syntax.tree_of(text, syntax.LEXICONS[lang])) >= 0


def test_only_tokens_that_rules_can_hold_on_are_made():
    for lang, src in (("c", C), ("go", GO), ("rust", RUST)):
        lexicon = syntax.LEXICONS[lang]
        names, scopes = syntax.asked_for(syntax.NAMES[lang]), syntax.asked_for(syntax.SCOPES[lang])
        wanted = syntax.asked_for([*syntax.NAMES[lang], *syntax.SCOPES[lang]])
        every = syntax.tree_of(src, lexicon)
        some = syntax.tree_of(src, lexicon, wanted)
        assert some == [t for t in every if t[3] in wanted[0] or t[4] in wanted[1]] and len(some) < len(every)
        # a token that names can hold on is none of a scope
        assert not scopes[0] and not {lexicon.words.get(t, t) for t in scopes[1]} & names[0] and not scopes[1] & names[1]


def test_places_of_files_that_share_a_batch(spark):
    texts = {"a": "/* é */ int größe = 1;\nint b;\n", "b": "int c;\n" * 3000, "c": "", "d": "\n\nint last;"}
    found = syntax.pattern_captures(spark.createDataFrame([(k, "c", t) for k, t in texts.items()], "file_id string, lang string, content string").coalesce(1))
    got = found.where("capture = 'local.definition.variable'").collect()
    assert len(got) == 3003
    for r in got:
        data = texts[r.file_id].encode()
        assert data[r.start_byte : r.end_byte].decode() == r.text and data[: r.start_byte].count(b"\n") == r.start_line == r.end_line
        assert r.start_byte - (data.rfind(b"\n", 0, r.start_byte) + 1) == r.start_col and r.end_col - r.start_col == r.end_byte - r.start_byte
