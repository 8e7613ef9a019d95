"""Exact top-k by Hamming distance with incremental multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, quoted

BITS = 64
#: Codes that share a key of the index on average; a key with more than twice as many is cut into parts.
GROUP = 4096
#: Queries that meet one part of a key in one task, at most about that many.
QUERY_BLOCK = 16_384
#: Distances that are computed at once.
CELLS = 1 << 20


def sign_code(vector: Column) -> Column:
    """64 bits, bit i set if the component i modulo 64 is above zero (of several the last counts); a null component is not."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


@dataclass(frozen=True)
class Layout:
    """How codes are cut: segments of widths that differ by one bit at most, of which the ``high`` first bits are the key."""

    segments: int
    high: int

    @classmethod
    def of(cls, n: int, group: int = GROUP) -> Layout:
        """Segments of about as many bits as the number of codes has, and keys that about ``group`` codes share."""
        segments = min(8, max(1, round(BITS / max(1.0, math.log2(max(2, n))))))
        return cls(segments, min(BITS // segments, max(0, math.ceil(math.log2(max(1, n) / group)))))

    def width(self, s: int) -> int:
        return BITS // self.segments + (s < BITS % self.segments)

    def shift(self, s: int) -> int:
        return sum(self.width(i) for i in range(s))

    def low(self, s: int) -> int:
        return self.width(s) - self.high

    def key(self, code: Column, s: int) -> Column:
        """A number for the segment and its high bits."""
        high = F.shiftrightunsigned(code, self.shift(s) + self.low(s)).bitwiseAND(F.lit((1 << self.high) - 1)) if self.high else F.lit(0)
        return (F.lit(s << self.high) + high).cast("long")

    def visits(self, first: int, last: int) -> list[int]:
        """What to change in a key's high bits for segment distances ``first`` to ``last``, each as mask * 128 * 128 + least * 128 + most.

        least, most: the distances that then remain for the low bits.
        """
        out = []
        for i in range(min(last, self.high) + 1):
            for places in combinations(range(self.high), i):
                mask = sum(1 << p for p in places)
                out.append((mask << 14) | (max(0, first - i) << 7) | (last - i))
        return out


def _answer(layout: Layout, want: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of one partition's queries, which follow the codes of their part; a part's codes are held, its queries are not.

    Rows (part, key, side, code, ids, least, most, bound), by part and key, codes first. Rows out: query code, id, distance, for the
    ``want`` nearest ids of each query among codes whose segment has a distance between least and most in its low bits.
    """
    part, codes, ids, mask, shift = None, [], [], np.uint64(0), np.uint64(0)
    ready: np.ndarray | None = None
    for b in batches:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        parts, keys, side = (b.column(i).to_numpy() for i in range(3))
        code = b.column(3).to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (keys[1:] != keys[:-1]) | (side[1:] != side[:-1])][: len(parts)])
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(parts)], strict=True):
            if (parts[x], keys[x]) != part:
                part, codes, ids, ready = (parts[x], keys[x]), [], [], None
                s = int(keys[x]) >> layout.high
                mask, shift = np.uint64((1 << layout.low(s)) - 1), np.uint64(layout.shift(s))
            if side[x] == 0:
                codes.append(code[x:y])
                ids += b.column(4).slice(x, y - x).to_pylist()
                ready = None
                continue
            if not codes:
                continue
            if ready is None:
                ready, counts = np.concatenate(codes), np.fromiter(map(len, ids), np.int64)
                flat, ends = np.concatenate([np.asarray(i, np.int64) for i in ids]), np.r_[0, np.cumsum(counts)]
                low = (ready >> shift) & mask
            least, most, bound = (b.column(i).to_numpy()[x:y] for i in (5, 6, 7))
            q, strip = code[x:y], max(1, CELLS // len(ready))
            for at in range(0, len(q), strip):
                z = slice(at, at + strip)
                near = np.bitwise_count(low[None] ^ ((q[z] >> shift) & mask)[:, None])
                i, j = np.nonzero((near >= least[z, None]) & (near <= most[z, None]))
                far = np.bitwise_count(q[z][i] ^ ready[j])
                ok = far <= bound[z][i]
                i, j, far = i[ok], j[ok], far[ok].astype(np.int64)
                n = counts[j]
                row = np.repeat(i, n)
                who = flat[np.repeat(ends[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                far = np.repeat(far, n)
                order = np.lexsort((who, far, row))
                row, who, far = row[order], who[order], far[order]
                starts = np.searchsorted(row, np.arange(len(q[z])))
                best = np.arange(len(row)) - starts[row] < want
                out.append((q[z][row[best]], who[best], far[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), *map(pa.array, cols[1:])], ["_q", "_n", "_d"])


def search_top_k(queries: DataFrame, codes: DataFrame, k: int = 10, group: int = GROUP) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each query the k codes of least (distance, id), its own id left out.

    queries, codes: materialized rows (_id bigint, _code bigint); queries are among codes.

    Equal codes are one, with their k + 1 least ids, which is all that any answer can need. A distinct code is filed under
    each of its segments' keys. A query goes to the keys within its present segment radius and gets the codes whose segment
    is that far; any code not met by then is further than ``segments * (radius + 1) - 1``. Queries whose kth distance is so
    covered are done, the others go on with the next radius. Each round is a written table. Keys with many codes are cut
    into parts and so are a key's many queries, so no key meets in one task. An empty table gives an empty result.
    """
    spark = codes.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    with Scratch() as keep:
        # the row number's limit is applied before the shuffle, so a code that is very common stays small
        order = Window.partitionBy("_code").orderBy("_id")
        few = codes.select("_code", "_id").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
        distinct = keep(few.groupBy("_code").agg(F.sort_array(F.collect_list("_id")).alias("_ids")), "distinct-codes")
        counted = distinct.agg(F.count(F.lit(1)), F.sum(F.size("_ids"))).first()
        n, there = counted[0], min(k + 1, counted[1] or 0)
        layout = Layout.of(n, group)
        filed = distinct.select(F.explode(F.array(*(layout.key(F.col("_code"), s) for s in range(layout.segments)))).alias("_key"), "_code", "_ids")
        sizes = keep(filed.groupBy("_key").agg(some(F.count(F.lit(1)), 2 * group).alias("_parts")), "key-sizes")
        found = keep(queries.select(F.col("_code").alias("_q")).distinct().select("_q", F.array().cast("array<struct<d:bigint,n:bigint>>").alias("_best"), F.lit(False).alias("_done")), "found")
        last, widest = 0, layout.width(0)
        while last <= widest:
            first, last = (0, 1) if last == 0 else (last, last)
            bound = F.when(F.size("_best") == there, F.get("_best", F.lit(there - 1))["d"]).otherwise(F.lit(BITS))
            open_ = found.where("not _done").select("_q", bound.cast("long").alias("_bound"))
            step = F.explode(F.lit(layout.visits(first, min(last, widest))).cast("array<bigint>")).alias("_step")
            asked = open_.select("_q", "_bound", F.explode(F.array(*(layout.key(F.col("_q"), s) for s in range(layout.segments)))).alias("_key")).select("_q", "_bound", "_key", step)
            asked = asked.select("_q", "_bound", F.col("_key").bitwiseXOR(F.shiftright("_step", 14)).alias("_key"), F.shiftright("_step", 7).bitwiseAND(F.lit(127)).alias("_least"), F.col("_step").bitwiseAND(F.lit(127)).alias("_most"))
            turns = asked.groupBy("_key").agg(some(F.count(F.lit(1)), QUERY_BLOCK).alias("_turns"))
            plan = keep(sizes.join(turns, "_key").select(F.col("_key").alias("_pk"), "_parts", "_turns"), "key-plan")
            part = lambda p, t: F.xxhash64("_key", p, t).alias("_part")
            one, every = (lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")), (lambda of: F.sequence(F.lit(0), F.col(of) - 1))
            none = F.lit(0).cast("long")
            a = filed.join(plan, F.col("_key") == F.col("_pk")).select("_key", "_code", "_ids", one("_code", "_parts").alias("_p"), F.explode(every("_turns")).alias("_t"))
            a = a.select(part("_p", "_t"), "_key", none.alias("_side"), "_code", "_ids", none.alias("_least"), none.alias("_most"), none.alias("_bound"))
            b = asked.join(plan, F.col("_key") == F.col("_pk")).select("*", F.explode(every("_parts")).alias("_p"))
            b = b.select(part("_p", one("_q", "_turns")), "_key", F.lit(1).cast("long").alias("_side"), F.col("_q").alias("_code"), F.array().cast("array<bigint>").alias("_ids"), "_least", "_most", "_bound")
            rows = a.unionByName(b).repartition(n_tasks, "_part").sortWithinPartitions("_part", "_key", "_side")
            met = rows.mapInArrow(lambda batches, layout=layout: _answer(layout, k + 1, batches), "_q bigint, _n bigint, _d bigint")
            # a code is met under each of its segments that are that near
            near = Window.partitionBy("_q").orderBy("_d", "_n")
            met = met.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= layout.segments * (k + 1)).groupBy(F.col("_q").alias("_mq")).agg(F.collect_set(F.struct(F.col("_d").alias("d"), F.col("_n").alias("n"))).alias("_met"))
            now = F.slice(F.array_sort(F.array_union("_best", F.coalesce("_met", F.col("_best")))), 1, max(1, there))
            covered = (F.size("_best") == there) & (F.get("_best", F.lit(max(0, there - 1)))["d"] < layout.segments * (last + 1))
            joined = found.join(met, F.col("_q") == F.col("_mq"), "left").select("_q", now.alias("_best"), "_done").withColumn("_done", F.col("_done") | F.coalesce(covered, F.lit(False)))
            found = keep(joined, "found")
            last += 1
            if found.where("not _done").isEmpty():
                break
        answers = queries.select(F.col("_id").alias("query_id"), "_code").join(found, F.col("_code") == F.col("_q"))
        others = F.slice(F.filter("_best", lambda x: x["n"] != F.col("query_id")), 1, k)
        out = answers.select("query_id", F.posexplode(others).alias("_r", "_x"))
        return materialize(out.select("query_id", (F.col("_r") + 1).alias("rank"), F.col("_x.n").alias("neighbor_id"), F.col("_x.d").alias("distance")), "nearest")


def nearest_codes(vectors: DataFrame, k: int = 10, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """:func:`search_top_k` over sign codes of all vectors; queries are the rows whose id is divisible by ``every``.

    A null id or vector has no code and takes no part; a null component and zero count as not positive. Rows that repeat
    an id are one vector, the one of the largest code. Equal distances are ordered by id. A query with fewer than k other
    vectors gets all of them; an empty table gives an empty result. Other columns are ignored.
    """
    coded = vectors.select(quoted(id_col).cast("long").alias("_id"), sign_code(quoted(vector_col)).alias("_code")).where("_id is not null and _code is not null")
    with Scratch() as keep:
        coded = keep(coded.groupBy("_id").agg(F.max("_code").alias("_code")), "codes")
        return search_top_k(coded.where(F.col("_id") % every == 0), coded, k)
