"""Personal data by fixed formats and by bootstrapped contexts, in DataFrame and SQL functions alone."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, quoted, text_of

#: Kinds in the order in which spans that start together are listed; the last has no base format and is found by context.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

# Possessive forms of the formats: they match the same spans, and Java neither backtracks nor recurses in them. A local
# part may start only where its run of characters starts or where the last match ended; later starts fail alike.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried at all.
GUARDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: Runs of words with a digit or an at sign, which may be identifiers of any format.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+"
# Published formats of credentials, which are secrets wherever they stand.
SURE_SECRET = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_(?:live|test)_[0-9A-Za-z]{24,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})$"
#: Hexadecimal strings as long as usual keys and digests: seeds of secrets, but secrets only where the context says so.
LIKELY_SECRET = r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"
#: Array elements whose running sum is made at once.
CHUNK = 64


def running(lengths: Column) -> Column:
    """For each element of an array of ints the sum of those before it; by chunks, as arrays grow by copying."""
    none = F.array().cast("array<int>")

    def sums(xs: Column, start: Column) -> Column:
        step = lambda a, x: F.struct((a["p"] + x).alias("p"), F.concat(a["o"], F.array(a["p"])).alias("o"))
        return F.aggregate(xs, F.struct(start.alias("p"), none.alias("o")), step, lambda a: a["o"])

    n = F.ceil(F.size(lengths) / CHUNK).cast("int")
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(lengths, i * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<int>>"))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(chunks, sums(totals, F.lit(0)), sums))


#: A character of no meaning that is put around matches, and what it is read as if a text has it.
MARK, READ_AS = "\ue000", "\ue001"


def cut(text: Column, pattern: str, guard: str) -> Column:
    """A text cut at a pattern's matches, in one pass: the text before, a match, the text after it, a match, and so on."""
    there = text.contains(guard) if guard == "@" else text.rlike(guard)
    marked = F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}")
    return F.when(there, F.split(marked, MARK, -1)).otherwise(F.array(F.lit("")))


def placed(parts: Column, starts: Column) -> Column:
    """Matches as array<struct<s,v,g,h>>: start in code points, the match, the text since the last one and up to the next.

    parts: from :func:`cut`; starts: the running sum of their lengths.
    """
    at = lambda i, d: F.get(parts, 2 * i + d)
    n = F.floor(F.size(parts) / 2).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(starts, 2 * i + 1).alias("s"), at(i, 1).alias("v"), at(i, 0).alias("g"), at(i, 2).alias("h")))
    return F.when(n > 0, each).otherwise(F.array().cast("array<struct<s:int,v:string,g:string,h:string>>"))


def _octet(part: Column) -> Column:
    return F.coalesce(F.regexp_replace(part, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False))


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), _octet)
    if kind == "card":
        digits = F.regexp_replace(v, "[ -]", "")
        return F.char_length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(F.regexp_replace(v, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _refuted(v: Column) -> Column:
    """Whether a text has a format's outer form and fails its test: not an identifier of any kind, whatever its context says."""
    found = lambda kind: F.regexp_extract_all(v, F.lit(PATTERNS[kind]), F.lit(0))
    long = F.exists(found("card"), lambda x: F.char_length(F.regexp_replace(x, "[ -]", "")).between(14, 19))
    return long | (F.size(found("ip")) > 0) | (F.size(found("phone")) > 0)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _word(w: Column) -> Column:
    """A word in lower case without what isn't letter or digit around it; all of it if there is neither."""
    low = F.lower(w)
    bare = F.regexp_replace(low, r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", "")
    return F.when(bare == "", low).otherwise(bare)


def shape(v: Column) -> Column:
    """Runs of digits as 0, of letters as a, of both as x, all else as it is; and the logarithm of the length."""
    out = F.regexp_replace(v, r"(?<![A-Za-z0-9])[0-9]++(?![A-Za-z])", "0")
    out = F.regexp_replace(out, r"(?<![A-Za-z0-9])[A-Za-z]++(?![0-9])", "a")
    return F.concat(F.regexp_replace(out, "[A-Za-z0-9]{2,}+", "x"), F.lit("~"), F.floor(F.log2(F.greatest(F.char_length(v), F.lit(1)))).cast("string"))


def _last_words(gap: Column) -> Column:
    """The last two words of a text, or fewer, whole, with white space between and after them.

    A short end of the text is tried first, as a search through all of a long text costs more; it counts if the two words
    in it are whole.
    """
    words = r"(?<!\S)((?:\S++\s++)?\S++)\s*+$"
    near = F.regexp_extract(F.substring_index(gap, " ", -5), r"\s(\S++\s++\S++)\s*+$", 1)
    return F.when(near != "", near).otherwise(F.regexp_extract(gap, words, 1))


def _patterns(far: Column, left: Column, right: Column, v: Column) -> Column:
    """The lexical patterns a candidate stands in: two words before, one before, one after, and the one before with what follows or the shape."""
    made = F.array(
        F.when((far != "") & (left != ""), F.concat(F.lit("2< "), far, F.lit(" "), left)),
        F.when(left != "", F.concat(F.lit("1< "), left)),
        F.when(right != "", F.concat(F.lit("1> "), right)),
        F.when((left != "") & (right != ""), F.concat(F.lit("1<> "), left, F.lit(" "), right)),
        F.when(left != "", F.concat(F.lit("1<s "), left, F.lit(" "), shape(v))),
    )
    return F.array_compact(made)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _id, _h (a hash of the text), _base array<struct<s,k,e>> and _cands array<struct<s,e,v,k,sure,ps>>.

    s, e: code points, end exclusive. k: the kind's place in KINDS that a candidate's own text has by format, -1 if it fails
    the test of a format whose form it has, else null.
    sure: whether that format alone makes it a span that is not a base one. ps: its patterns.
    """
    rows = docs.select(quoted(id_col).alias("_id"), text_of(text_col).alias("_t"))
    rows = rows.withColumn("_m", F.translate("_t", MARK, READ_AS))
    # columns of their own, as an expression that is used again within a lambda would be computed again
    names = (*BASE, "candidate")
    rows = rows.withColumns({f"_p_{n}": cut(F.col("_m"), PATTERNS.get(n, CANDIDATE), GUARDS.get(n, "[0-9@]")) for n in names})
    rows = rows.withColumns({f"_s_{n}": running(F.transform(f"_p_{n}", F.char_length)) for n in names})

    def of_kind(i: int, kind: str) -> Column:
        ok = F.filter(placed(F.col(f"_p_{kind}"), F.col(f"_s_{kind}")), lambda x: _valid(kind, x["v"]))
        return F.transform(ok, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), (x["s"] + F.char_length(x["v"])).alias("e")))

    rows = rows.withColumn("_base", F.concat(*(of_kind(i, kind) for i, kind in enumerate(BASE))))

    def kind_of(v: Column) -> Column:
        out = F.when(v.rlike(SURE_SECRET) | v.rlike(LIKELY_SECRET), F.lit(4))
        for i, kind in reversed(list(enumerate(BASE))):
            out = F.when(F.exists(F.regexp_extract_all(v, F.lit(PATTERNS[kind]), F.lit(0)), partial(_valid, kind)), F.lit(i)).otherwise(out)
        return F.when(out.isNull() & _refuted(v), F.lit(-1)).otherwise(out)

    # step by step, so that each is computed once
    def bare(x: Column) -> Column:
        head = F.regexp_replace(x["v"], r"^[^\p{L}\p{N}+]++", "")
        return F.struct((x["s"] + F.char_length(x["v"]) - F.char_length(head)).alias("s"), F.regexp_replace(head, r"[^\p{L}\p{N}]++$", "").alias("v"), _last_words(x["g"]).alias("g"), F.regexp_extract(x["h"], r"^\s*+(\S++)", 1).alias("h"))

    def worded(x: Column) -> Column:
        far, near = F.regexp_extract(x["g"], r"^(\S++)\s++\S", 1), F.regexp_extract(x["g"], r"(?<!\S)(\S++)\s*+$", 1)
        return F.struct(x["s"].alias("s"), (x["s"] + F.char_length(x["v"])).alias("e"), x["v"].alias("v"), _word(far).alias("far"), _word(near).alias("left"), _word(x["h"]).alias("right"))

    def judged(x: Column) -> Column:
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v"), kind_of(x["v"]).alias("k"), x["v"].rlike(SURE_SECRET).alias("sure"), _patterns(x["far"], x["left"], x["right"], x["v"]).alias("ps"))

    cands = F.filter(F.transform(placed(F.col("_p_candidate"), F.col("_s_candidate")), bare), lambda x: x["v"] != "")
    return rows.select("_id", F.xxhash64("_t").alias("_h"), "_base", F.transform(F.transform(cands, worded), judged).alias("_cands"))


def bootstrap(candidates: DataFrame, least: float = 0.8, support: int = 3, doubt: float = 0.5) -> DataFrame:
    """Patterns that find identifiers: rows (_p, _k, _score), written. candidates: rows (v, k, ps) as in :func:`scan`.

    The graph joins each pattern with the distinct instances it is seen with. Seeds, instances with a kind by format,
    have confidence 1 in it and speak against every other kind; refuted ones (-1) speak against all. What a pattern's other instances are is open: they speak
    against it with weight ``doubt``, less as far as they have been found. A pattern's score in a kind is the share of
    its instances' confidence in all that speaks for and against; it counts if it reaches ``least`` and ``support``
    instances are seeds or found. An instance without a format takes the best score among its patterns that count, and so
    speaks for its other patterns from then on. Scores only grow; turns go on, each a written table, until no further
    instance is found.
    """
    with Scratch() as keep:
        edges = candidates.where("v <> ''").select("v", "k", F.explode("ps").alias("_p")).groupBy("_p", F.col("v").alias("_v")).agg(F.min("k").alias("_seed"))
        edges = keep(edges, "pii-edges")
        counts = edges.groupBy("_p", "_seed").agg(F.count(F.lit(1)).alias("_n"))
        total = keep(counts.groupBy(F.col("_p").alias("_tp")).agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col("_seed").isNull(), F.col("_n")).otherwise(0)).alias("_open")), "pii-patterns")
        seeds = keep(counts.where("_seed >= 0").select("_p", F.col("_seed").alias("_k"), F.col("_n").cast("double").alias("_mass"), F.lit(0.0).alias("_gained"), F.col("_n").alias("_known")), "pii-seeds")
        unseen = edges.where("_seed is null").select("_p", "_v")

        def scored(mass: DataFrame) -> DataFrame:
            against = F.col("_n") - F.col("_open") - (F.col("_mass") - F.col("_gained")) + doubt * (F.col("_open") - F.col("_gained"))
            out = mass.join(total, F.col("_p") == F.col("_tp")).select("_p", "_k", "_known", (F.col("_mass") / (F.col("_mass") + against)).alias("_score"))
            return out.where((F.col("_score") >= least) & (F.col("_known") >= support)).select(F.col("_p").alias("_sp"), "_k", "_score")

        good, known = scored(seeds), 0
        while True:
            found = unseen.join(good, F.col("_p") == F.col("_sp")).groupBy(F.col("_v").alias("_iv"), "_k").agg(F.max("_score").alias("_conf"))
            found = keep(found, "pii-instances")
            n = found.count()
            if n == known:
                return materialize(good.select(F.col("_sp").alias("_p"), "_k", "_score"), "pii-good")
            known = n
            gained = unseen.join(found, F.col("_v") == F.col("_iv")).select("_p", "_k", F.col("_conf").alias("_mass"), F.col("_conf").alias("_gained"), F.lit(1).cast("long").alias("_known"))
            sums = seeds.unionByName(gained).groupBy("_p", "_k").agg(*(F.sum(c).alias(c) for c in ("_mass", "_gained", "_known")))
            good = scored(keep(sums, "pii-mass"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    Base spans are the leftmost non-overlapping matches per kind that pass their kind's test; the counts and base_sha256
    describe them alone. :func:`bootstrap` learns from the words around them and around likely secrets, all over the
    corpus, which patterns stand at identifiers of a kind; other candidates in such a pattern are spans of that kind, and
    so are credentials of a published format. Found spans that overlap no base span join these in ``spans``, sorted by
    start, then kind; n_spans counts all. A candidate in patterns of several kinds takes that of the best score, the first
    listed on a tie.

    Null counts as empty, which has no spans. Repeated rows are one result each, and their contexts count once as all
    equal (pattern, instance) pairs do. Rows that share an id but not their text are held apart. Other columns are
    ignored; an empty table gives an empty result.
    """
    with Scratch() as keep:
        scanned = materialize(scan(docs, id_col, text_col), "pii-scan")
        cands = scanned.where("size(_cands) > 0").select("_id", "_h", F.explode("_cands").alias("x")).select("_id", "_h", "x.*")
        good = bootstrap(cands.select("v", "k", "ps"))
        keep.tables.append(good)
        open_ = cands.where("k is null or k = 4")
        hits = open_.select("_id", "_h", "s", "e", F.explode("ps").alias("_ep")).join(good, F.col("_ep") == F.col("_p")).select("_id", "_h", "s", "e", "_k", "_score")
        sure = open_.where("sure").select("_id", "_h", "s", "e", F.lit(4).alias("_k"), F.lit(1.0).alias("_score"))
        best = hits.unionByName(sure).groupBy("_id", "_h", "s", "e").agg(F.max(F.struct("_score", (-F.col("_k")).alias("o"))).alias("_best"))
        # as many spans as the text itself has room for
        extra = best.groupBy(F.col("_id").alias("_xid"), F.col("_h").alias("_xh")).agg(F.collect_list(F.struct("s", (-F.col("_best.o")).alias("k"), "e")).alias("_extra"))
        extra = materialize(extra, "pii-extra")
    joined = scanned.select("_id", "_h", "_base").join(extra, F.col("_id").eqNullSafe(F.col("_xid")) & (F.col("_h") == F.col("_xh")), "left")
    free = F.filter("_extra", lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    spans = F.concat("_base", F.coalesce(free, F.array().cast("array<struct<s:int,k:int,e:int>>")))

    def count(i: int) -> Column:
        return F.size(F.filter("_base", lambda x: x["k"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    out = joined.select("_id", "_base", spans.alias("_spans"))
    return out.select(F.col("_id").alias(id_col), *map(count, range(len(BASE))), F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"), F.size("_spans").cast("long").alias("n_spans"))
