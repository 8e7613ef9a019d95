"""Near duplicates by ProbMinHash, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Presence, Scratch, batch_rows, discard, materialize, quoted, text_of, without_ids
from .shingles import chunks, mix, shingle_sets

#: Bands and rows of a signature: texts at a similarity of 0.8 share no band once in forty thousand times.
BANDS, ROWS = 20, 4
#: Members of a bucket up to which pairs of those in different components are listed; in larger ones only links are.
SMALL_BUCKET = 64
#: Members of a large bucket that are compared in memory with each other or with as many others.
BLOCK = 256
#: Rows of an Arrow batch here, as two sets of a very long text's shingles can be in a row.
PAIR_ROWS = 64
#: Slots that ids are hashed to in a large bucket, each with its own lead.
LEADS = 8
#: Bytes of a shingle's hash in a packed set.
HASH_BYTES = 6


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash: for each text and component the element that arrives first, and when.

    Each element is a Poisson process whose rate is its weight; each arrival goes to one component. All elements of all
    texts take their next arrivals together, and an element stops once it comes later than the last of its text's
    components, as all its further arrivals would. Texts with few elements need many of each, so later turns take more
    arrivals at once. Two texts agree in a component with their probability Jaccard.
    """
    best = np.full(n_texts * size, np.inf)
    winner = np.zeros(n_texts * size, np.uint64)
    time = np.zeros(len(text))
    turn = taken = 0
    while len(text):
        many = 1 if turn < 4 else min(1 << (turn - 3), 64)
        steps = np.arange(taken + 1, taken + many + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        turn, taken = turn + 1, taken + many
        h = mix(element[:, None] + steps)
        times = time[:, None] - np.cumsum(np.log(((h >> np.uint64(11)).astype(float) + 1) * 2.0**-53), axis=1) / weight[:, None]
        cell = (text[:, None] * size + (mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(size)).astype(np.int64)).ravel()
        who, when = np.repeat(element, many), times.ravel()
        sooner = np.flatnonzero(when < best[cell])
        order = sooner[np.lexsort((who[sooner], when[sooner]))[::-1]]
        best[cell[order]] = when[order]  # of several for one cell the last, which is the soonest, stays
        winner[cell[order]] = who[order]
        time = times[:, -1]
        alive = time < best.reshape(n_texts, size).max(axis=1)[text]
        text, element, weight, time = text[alive], element[alive], weight[alive], time[alive]
    return winner.reshape(n_texts, size), best.reshape(n_texts, size)


def band_keys(winner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(winner), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys ^ winner[:, r::rows][:, :bands]) + np.uint64(r + 1)
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)).view(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The exact value that signatures estimate; with weights of one, the Jaccard similarity. a, b: distinct and sorted."""
    if not len(a) or not len(b):
        return 0.0
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if (wa == 1).all() and (wb == 1).all():
        return len(both) / (len(a) + len(b) - len(both))
    only_a, only_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y, ratio = x[order], y[order], (x / y)[order]
    lower = np.searchsorted(ratio, ratio, side="left")  # elements before have a smaller ratio
    y_below, x_below = np.r_[0.0, np.cumsum(y)][lower], np.r_[0.0, np.cumsum(x)][lower]
    return float((1 / ((only_a + x.sum() - x_below) / x + (only_b + y_below) / y)).sum())


def similar(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of the sets or the probability Jaccard of their weights reaches ``least``."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) or probability_jaccard(a, wa, b, wb) >= least


def sketch(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(_id, _sha, _bands array<bigint>, _sig binary) for every row. texts: _id, _sha, _text in lower case.

    _sig: one byte for each component, of the element that won it. If a shingle repeats, bands and components of the
    signature with all weights one follow those of the weighted signature; else the two signatures are the same. A text
    without words has neither.
    """
    schema = T.StructType([*texts.select("_id", "_sha").schema.fields, T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                text, element, weight = shingle_sets(data, offsets, size)
                there, dense = np.unique(text, return_inverse=True)
                winner, owner = np.empty((0, bands * rows), np.uint64), there
                if len(there):
                    winner, _ = signatures(dense, element, weight.astype(float), len(there), bands * rows)
                again = np.unique(dense[weight > 1])
                if len(again):
                    some = np.isin(dense, again)
                    plain, _ = signatures(np.searchsorted(again, dense[some]), element[some], np.ones(some.sum()), len(again), bands * rows)
                    winner, owner = np.concatenate([winner, plain]), np.r_[there, there[again]]
                # a text's two signatures one after the other
                order = np.argsort(owner, kind="stable")
                ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=b - a))]
                lists = pa.ListArray.from_arrays(pa.array(ends * bands, pa.int32()), pa.array(band_keys(winner, bands, rows)[order].ravel()))
                bytes_of = (mix(winner) >> np.uint64(56)).astype(np.uint8)[order]
                sig = pa.array([bytes_of[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists, sig], schema.names)

    return texts.select("_id", "_sha", "_text").mapInArrow(run, schema)


def pack_set(element: np.ndarray, weight: np.ndarray) -> bytes:
    """A set of shingles: a byte that says if weights follow, the hashes, then the weights unless all are one."""
    body = element.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
    return b"\0" + body if (weight == 1).all() else b"\1" + body + weight.astype("<u4").tobytes()


def unpack_set(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(packed) - 1) // (HASH_BYTES + 4 * packed[0])
    element = np.zeros((n, 8), np.uint8)
    element[:, :HASH_BYTES] = np.frombuffer(packed, np.uint8, n * HASH_BYTES, 1).reshape(n, HASH_BYTES)
    weight = np.frombuffer(packed, "<u4", n, 1 + n * HASH_BYTES).astype(np.int64) if packed[0] else np.ones(n, np.int64)
    return element.view("<u8").ravel(), weight


def packed_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(_id, _set) for the texts whose id is in the column _id of wanted, a materialized frame."""
    seen = Presence(wanted.select(F.xxhash64("_id").alias("_h")).distinct(), "_h")
    some = seen.flag(texts.select("_id", "_text"), F.xxhash64("_id"), "_w").where("_w").select("_id", "_text")
    schema = T.StructType([texts.schema["_id"], T.StructField("_set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                text, element, weight = shingle_sets(data, offsets, size)
                cut = np.searchsorted(text, np.arange(b - a + 1))
                sets = [pack_set(element[x:y], weight[x:y]) for x, y in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], schema.names)

    return some.mapInArrow(run, schema)


def verify(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (_a, _b) whose texts are :func:`similar`. Each text's packed set of shingles travels, no text. pairs: materialized."""
    ends = pairs.select(F.explode(F.array("_a", "_b")).alias("_id"))
    sets = packed_sets(texts, ends, size)
    left, right = (sets.select(F.col("_id").alias(f"_i{x}"), F.col("_set").alias(f"_s{x}")) for x in "ab")
    joined = pairs.join(right, F.col("_b") == F.col("_ib")).join(left, F.col("_a") == F.col("_ia")).select("_a", "_b", "_sa", "_sb")
    schema = T.StructType([pairs.schema[c] for c in ("_a", "_b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(*unpack_set(x.as_py()), *unpack_set(y.as_py()), least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["_a", "_b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(_id, _root) for every end of a link (_a, _b): the smallest id of its connected component. links: materialized.

    Every turn, each node takes the smallest label among its own and its neighbours', then that label's own label.
    Labels are written out each turn; a turn without change ends it. The result is written; all else is deleted.
    """
    with Scratch() as keep:
        both = keep(links.select("_a", "_b").unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct(), "edges")
        labels = materialize(both.groupBy(F.col("_a").alias("_id")).agg(F.least(F.first("_a"), F.min("_b")).alias("_root")), "labels")
        while True:
            near = both.join(labels, F.col("_b") == F.col("_id")).groupBy(F.col("_a").alias("_na")).agg(F.min("_root").alias("_near"))
            met = labels.join(near, F.col("_id") == F.col("_na")).select("_id", "_root", F.least("_root", "_near").alias("_met"))
            jump = labels.select(F.col("_id").alias("_ji"), F.col("_root").alias("_jr"))
            new = met.join(jump, F.col("_met") == F.col("_ji"), "left").select("_id", F.least("_met", F.coalesce("_jr", "_met")).alias("_root"), F.col("_root").alias("_old"))
            new, old = materialize(new, "labels"), labels
            discard(old)
            labels = new
            if new.where(F.col("_old") != F.col("_root")).isEmpty():
                return new


def _buckets(reps: DataFrame, keep: Scratch) -> DataFrame:
    """Members of buckets that several ids are in: (_bucket, _id, _n, _lo), _n rows and _lo the least id of the bucket. reps: _id, _bands.

    One aggregation finds such buckets and is all that buckets of two need; rows of larger ones are then found by a
    bitmap and joined.
    """
    each = reps.select("_id", F.explode(F.array_distinct("_bands")).alias("_bucket"))
    found = each.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).where(F.col("_lo") != F.col("_hi"))
    found = keep(found, "buckets")
    two = found.where("_n = 2").select("_bucket", F.explode(F.array("_lo", "_hi")).alias("_id"), "_n", "_lo")
    more = found.where("_n > 2").select(F.col("_bucket").alias("_mb"), "_n", "_lo")
    seen = Presence(more, "_mb")
    if seen.empty:
        return keep(two, "members")
    rest = seen.flag(each, F.col("_bucket"), "_w").where("_w").join(more, F.col("_bucket") == F.col("_mb")).select("_bucket", "_id", "_n", "_lo").distinct()
    return keep(two.unionByName(rest), "members")


def _stars(members: DataFrame) -> DataFrame:
    """One pair (_a, _b) for each id _b that is not its bucket's lead: with the lead that it shares most buckets with.

    A bucket's lead is its least id; in a large one the least id of the slot that an id is hashed to is one for it, too.
    """
    slot = F.pmod(F.xxhash64("_id"), F.lit(LEADS))
    large = members.where(F.col("_n") > SMALL_BUCKET).withColumn("_slot", slot)
    leads = large.groupBy(F.col("_bucket").alias("_lb"), F.col("_slot").alias("_ls")).agg(F.min("_id").alias("_lead"))
    own = large.join(leads, (F.col("_bucket") == F.col("_lb")) & (F.col("_slot") == F.col("_ls"))).select(F.col("_lead").alias("_a"), F.col("_id").alias("_b"))
    every = members.select(F.col("_lo").alias("_a"), F.col("_id").alias("_b")).unionByName(own)
    shared = every.where(F.col("_a") != F.col("_b")).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_shared"))
    return shared.groupBy("_b").agg(F.max_by("_a", F.struct("_shared", "_a")).alias("_a")).select("_a", "_b")


def _mixed(members: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Members of small and of large buckets with more than one component. members: (_bucket, _id, _root).

    Both results are tasks (_task, _bucket, _u, _id, _root). A bucket of up to BLOCK members is one task. A larger one is cut
    into blocks _u of about that many members: a component that is as large has blocks of its own, smaller ones share blocks.
    Two blocks make a task, and so does a shared block alone; blocks of one component don't meet. So every two members in
    different components meet.
    """
    parts = members.groupBy("_bucket", "_root").agg(F.count(F.lit(1)).alias("_c"))
    shared = F.when(F.col("_c") < BLOCK, F.col("_c")).otherwise(0)
    mixed = parts.groupBy(F.col("_bucket").alias("_mb")).agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.sum("_c").alias("_members"), F.sum(shared).alias("_shared")).where(F.col("_lo") != F.col("_hi"))
    mixed = keep(mixed.select("_mb", "_members", "_shared"), "mixed")
    most = max(BLOCK, SMALL_BUCKET)
    whole, cut = mixed.where(F.col("_members") <= most), mixed.where(F.col("_members") > most)
    tasks = members.join(whole, F.col("_bucket") == F.col("_mb")).select(F.col("_bucket").alias("_task"), "_bucket", F.lit(0).cast("long").alias("_u"), "_id", "_root", "_members")
    tasks = keep(tasks, "tasks")
    small, large = (tasks.where(x).drop("_members") for x in (F.col("_members") <= SMALL_BUCKET, F.col("_members") > SMALL_BUCKET))
    if cut.isEmpty():
        return small, None if large.isEmpty() else large
    own = F.when(F.col("_c") >= BLOCK, F.col("_root"))
    info = parts.join(cut, F.col("_bucket") == F.col("_mb")).select("_mb", F.col("_root").alias("_mr"), own.alias("_g"), F.ceil(F.when(own.isNotNull(), F.col("_c")).otherwise(F.col("_shared")) / BLOCK).alias("_of"))
    info = keep(info, "block-counts")
    blocks = info.select("_mb", "_g", "_of").distinct().select("_mb", "_g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)).alias("_k")).select("_mb", "_g", F.xxhash64("_g", "_k").alias("_u"))
    other = blocks.withColumnsRenamed({"_mb": "_ob", "_g": "_og", "_u": "_ou"})
    meet = blocks.join(other, (F.col("_mb") == F.col("_ob")) & (F.col("_u") <= F.col("_ou"))).where((F.col("_g").isNull() & F.col("_og").isNull()) | ~F.col("_g").eqNullSafe(F.col("_og")))
    meet = meet.select(F.col("_mb").alias("_tb"), F.xxhash64("_mb", "_u", "_ou").alias("_task"), F.explode(F.array_distinct(F.array("_u", "_ou"))).alias("_tu"))
    k = F.pmod(F.xxhash64(F.when(F.col("_g").isNull(), F.xxhash64("_root")).otherwise(F.xxhash64("_id"))), F.col("_of"))
    placed = members.join(info, (F.col("_bucket") == F.col("_mb")) & (F.col("_root") == F.col("_mr"))).select("_bucket", "_id", "_root", F.xxhash64("_g", k).alias("_u"))
    several = placed.join(meet, (F.col("_bucket") == F.col("_tb")) & (F.col("_u") == F.col("_tu"))).select("_task", "_bucket", "_u", "_id", "_root")
    return small, keep(large.unionByName(several), "large-tasks")


def _candidates(rows: list[tuple], least: float, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two ends of a task's pairs: in different components, and signatures, weighted or plain, allow for a
    similarity of ``least``.

    Four standard deviations below what that similarity makes components agree, so such a pair is lost once in thirty
    thousand times. A pair belongs to the least bucket that both are in, so no other one has it. rows: (_task, _bucket,
    _u, _id, _root, _bands, _sig, ...) of one task.
    """
    numbers: dict = {}
    root = np.array([numbers.setdefault(r[4], len(numbers)) for r in rows])
    block, place = np.array([r[2] for r in rows]), np.arange(len(rows))
    both = any(len(r[5]) > bands for r in rows)
    keys = np.array([r[5] if len(r[5]) > bands or not both else r[5] * 2 for r in rows]).reshape(len(rows), -1, bands)
    sig = np.frombuffer(b"".join(r[6] if len(r[5]) > bands or not both else r[6] * 2 for r in rows), np.uint8).reshape(len(rows), keys.shape[1], -1)
    two, m = bool((block != block[0]).any()), sig.shape[2]
    need = m * least - 4 * np.sqrt(m * least * (1 - least))
    at, to = [], []
    for a in range(0, len(rows), 64):
        strip = slice(a, a + 64)
        same = np.max([(sig[strip, None, k] == sig[None, :, k]).sum(axis=2) for k in range(sig.shape[1])], axis=0)
        ok = (same >= need) & (place[strip, None] < place) & (root[strip, None] != root)
        if two:
            ok &= block[strip, None] != block
        i, j = np.nonzero(ok)
        mine, other = keys[a + i][:, :, None], keys[j][:, None]
        own = np.where(mine == other, other, np.iinfo(np.int64).max).min(axis=(1, 2, 3)) == rows[0][1]
        at.append(a + i[own])
        to.append(j[own])
    return np.concatenate(at), np.concatenate(to)


def _linked(rows: list[tuple], least: float, bands: int) -> Iterator[tuple]:
    """Links that join all components of a task that are :func:`similar` somewhere. rows end in (elements, weights)."""
    at, to = _candidates(rows, least, bands)
    if not len(at):
        return
    root = {r[4]: r[4] for r in rows}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    sizes = np.array([len(r[-2]) for r in rows])
    starts = np.cumsum(sizes) - sizes
    distinct, code = np.unique(np.concatenate([r[-2] for r in rows]), return_inverse=True)
    codes, there = np.split(code, starts[1:]), np.zeros(len(distinct), bool)
    once = [bool((r[-1] == 1).all()) for r in rows]
    for i in np.unique(at).tolist():
        there[codes[i]] = True
        for j in to[at == i].tolist():
            x, y = find(rows[i][4]), find(rows[j][4])
            if x != y:
                both = int(there[codes[j]].sum())
                if both >= least * (sizes[i] + sizes[j] - both) or (not (once[i] and once[j]) and probability_jaccard(*rows[i][-2:], *rows[j][-2:]) >= least):
                    root[x] = y
                    yield min(rows[i][3], rows[j][3]), max(rows[i][3], rows[j][3])
        there[codes[i]] = False


def _compared(tasks: DataFrame, sketches: DataFrame, least: float, bands: int, sets: DataFrame | None = None) -> DataFrame:
    """Per task, the pairs (_a, _b) of :func:`_candidates` or, with packed sets (_id, _set), the links of :func:`_linked`."""
    signed = sketches.select(F.col("_id").alias("_si"), "_bands", "_sig")
    if sets is not None:
        signed = signed.join(sets.withColumnRenamed("_id", "_wi"), F.col("_si") == F.col("_wi"))
    cols = ["_task", "_bucket", "_u", "_id", "_root", "_bands", "_sig", *([] if sets is None else ["_set"])]
    signed = tasks.join(signed, F.col("_id") == F.col("_si")).select(*cols)
    schema = T.StructType([T.StructField(c, tasks.schema["_id"].dataType) for c in ("_a", "_b")])

    def pairs(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) > 1 and len(cols) == 8:
            yield from _linked([(*r[:7], *unpack_set(r[7])) for r in rows], least, bands)
        elif len(rows) > 1:
            for i, j in zip(*_candidates(rows, least, bands), strict=True):
                yield min(rows[i][3], rows[j][3]), max(rows[i][3], rows[j][3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], members_type) for k in (0, 1)], ["_a", "_b"])

        held: list[tuple] = []
        for b in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True) if b.num_rows else ():
                if held and held[0][0] != row[0]:
                    found += pairs(held)
                    held = []
                held.append(row)
            yield batch(found)
        yield batch(list(pairs(held)))

    members_type = to_arrow_type(tasks.schema["_id"].dataType)
    return signed.repartition("_task").sortWithinPartitions("_task").mapInArrow(run, schema)


def near_duplicate_classes(docs: DataFrame, least: float = 0.8, size: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_cid, _class, _links), written, for the ids whose class has another member or that a text equals; see :func:`near_duplicates`."""
    base = docs.select(quoted(id_col).alias("_id"), text_of(text_col).alias("_text")).where(F.col("_id").isNotNull())
    texts = base.select("_id", F.unhex(F.sha2("_text", 256)).alias("_sha"), F.lower("_text").alias("_text"))
    with Scratch() as keep, batch_rows(docs.sparkSession, PAIR_ROWS):
        sketches = keep(sketch(texts, size, bands, rows), "sketches")
        # equal texts count as one, so that no group of them meets in one task below
        equal = sketches.groupBy(F.col("_sha").alias("_es")).agg(F.min("_id").alias("_rep"), F.max("_id").alias("_z")).where(F.col("_rep") != F.col("_z"))
        equal = keep(equal.select("_es", "_rep"), "equal")
        flagged = Presence(equal.select(F.xxhash64("_es").alias("_h")), "_h").flag(sketches.select("_id", "_sha", "_bands"), F.xxhash64("_sha"), "_w")
        first = flagged.where("_w").join(equal, F.col("_sha") == F.col("_es"), "left").where(F.col("_rep").isNull() | (F.col("_rep") == F.col("_id")))
        members = _buckets(flagged.where("not _w").select("_id", "_bands").unionByName(first.select("_id", "_bands")), keep)
        tried = keep(_stars(members), "stars")
        links = keep(verify(tried, texts, size, least), "links")
        roots = components(links)
        keep.tables.append(roots)

        # members of one bucket that are still apart: compare them all, except what was compared
        linked = roots.select(F.col("_id").alias("_ri"), "_root")
        apart = members.join(linked, F.col("_id") == F.col("_ri"), "left").select("_bucket", "_id", F.coalesce("_root", "_id").alias("_root"))
        small, large = _mixed(apart, keep)
        seen = tried.withColumnsRenamed({"_a": "_sa", "_b": "_sb"})
        more = _compared(small, sketches, least, bands).distinct().join(seen, (F.col("_a") == F.col("_sa")) & (F.col("_b") == F.col("_sb")), "left_anti")
        found = verify(keep(more, "new-pairs"), texts, size, least)
        if large is not None:
            found = found.unionByName(_compared(large, sketches, least, bands, packed_sets(texts, large, size)))
        found = keep(found.distinct(), "more-links")
        if not found.isEmpty():
            # the first round's components stand for their links
            ends = found.unionByName(roots.where(F.col("_id") != F.col("_root")).select(F.col("_root").alias("_a"), F.col("_id").alias("_b")))
            roots = components(keep(ends, "all-links"))
            keep.tables.append(roots)

        degree = links.unionByName(found).select(F.explode(F.array("_a", "_b")).alias("_li")).groupBy("_li").agg(F.count(F.lit(1)).alias("_links"))
        none = F.lit(0).cast("long")
        reps = roots.select(F.col("_id").alias("_ri"), "_root").join(degree, F.col("_ri") == F.col("_li"), "left").select("_ri", "_root", F.coalesce("_links", none).alias("_links"))
        of_equal = equal.join(reps, F.col("_rep") == F.col("_ri"), "left").select("_es", F.coalesce("_root", "_rep").alias("_class"), F.coalesce("_links", none).alias("_links"))
        copies = sketches.select(F.col("_id").alias("_cid"), "_sha").join(of_equal, F.col("_sha") == F.col("_es")).select("_cid", "_class", "_links")
        both = copies.unionByName(reps.select(F.col("_ri").alias("_cid"), F.col("_root").alias("_class"), "_links"))
        # an id with several texts has several rows
        return materialize(both.groupBy("_cid").agg(F.min("_class").alias("_class"), F.max("_links").alias("_links")), "classes")


def near_duplicates(docs: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id (the smallest id of its class), kept (it is that one), links.

    Two texts are linked if the Jaccard similarity of their shingles of ``size`` words or the probability Jaccard, which
    weights each by how often it occurs, is at least ``least``; with no shingle repeated they are the same. Classes are the
    connected components. Words are lower-cased runs of letters and digits; a text with fewer than ``size`` words is one
    shingle. links: how many other texts this one was verified against and found linked to; members of one class need not
    all be compared, so this is at least one for a class of different texts, not all links there are.

    Each text is sketched where it is read: its digest, ProbMinHash signature and, if a shingle repeats, a second
    signature with all weights one, so that either similarity leads to a shared band. Equal texts are joined by digest;
    distinct ones that share a band meet in a bucket. First each text is verified against one lead, the one it shares
    most buckets with; then all members of a bucket that are still in different components are compared by their
    signatures and, if these allow for a link, exactly. Large buckets are compared block by block with their sets of
    shingles, which makes links only, no rows for pairs. There is no cap on a bucket; the time for a large bucket that
    stays in many components grows with the square of its size. A pair at the threshold is missed once in about forty
    thousand times by the bands and once in thirty thousand by the filter, a closer one more rarely.

    Texts without words are alike only if equal. Null counts as empty. Rows that repeat an id are one document; a row
    with a null id is its own class with a null class_id and is kept. Other columns are ignored; an empty table gives an
    empty result.
    """
    classes = near_duplicate_classes(docs, least, size, id_col=id_col, text_col=text_col)
    joined = docs.select(quoted(id_col).alias("_id")).join(classes, F.col("_id") == F.col("_cid"), "left")
    class_id, links = F.coalesce("_class", "_id"), F.coalesce("_links", F.lit(0).cast("long"))
    return joined.select(F.col("_id").alias(id_col), class_id.alias("class_id"), class_id.eqNullSafe(F.col("_id")).alias("kept"), links.alias("links"))


def drop_near_duplicates(docs: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that :func:`near_duplicates` keeps, with all their columns."""
    classes = near_duplicate_classes(docs, least, size, id_col=id_col, text_col=text_col)
    return without_ids(docs, classes.where(F.col("_cid") != F.col("_class")).select(F.col("_cid").alias(id_col)), id_col)
