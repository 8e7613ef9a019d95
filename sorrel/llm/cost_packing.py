"""Packing tokenized documents into sequences of balanced attention cost without padding."""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Presence, materialize, quoted, slices, text_of
from .tokenizer import TokenizerFile, encoder

#: Pieces that one task assigns together, on average; the tasks are as many as this needs, whatever the input.
GROUP_PIECES = 8192
#: Sequences of one group have numbers from its own stretch of this length.
STRETCH = 1 << 32


@dataclass(frozen=True)
class Cost:
    """What a piece costs that attends to itself alone: ``linear`` for each token and ``quadratic`` for each pair.

    By default the unit is one token's matrix work in a layer of width 2048: 24 d^2 operations for it and 4 d for each
    pair of tokens, which makes a pair 1 / (6 d).
    """

    linear: float = 1.0
    quadratic: float = 1 / (6 * 2048)

    def of(self, length: int) -> float:
        return self.linear * length + self.quadratic * length * length


def capacities(tokens: int, capacity: int) -> list[int]:
    """Sequences that ``tokens`` fill to the last place: full ones, and for what is over one for each power of two in it."""
    full, over = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in reversed(range(over.bit_length())) if over >> b & 1]


def assign(lengths: list[int], capacity: int, cost: Cost) -> Iterator[tuple[int, int, int, int, int]]:
    """Yield (item, start in it, length, sequence, offset) for items of 1 to ``capacity`` tokens.

    In descending length each item goes to the sequence of least cost that has room for it. One that fits nowhere whole
    fills the largest room left, and its rest waits for its place in the order. As the sequences have as many places as
    there are tokens, all get full.
    """
    rooms = capacities(sum(lengths), capacity)
    filled, costs = [0] * len(rooms), [0.0] * len(rooms)
    ready = [(0.0, s) for s in range(len(rooms))]
    heapq.heapify(ready)
    #: Sequences with too little room for the present length, by their room; and items by length.
    parked: dict[int, list[int]] = defaultdict(list)
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, n in enumerate(lengths):
        waiting[n].append((item, 0))
    for n in range(capacity, 0, -1):
        for s in parked.pop(n, ()):
            heapq.heappush(ready, (costs[s], s))
        for item, start in waiting.pop(n, ()):
            while ready and rooms[ready[0][1]] - filled[ready[0][1]] < n:
                s = heapq.heappop(ready)[1]
                if rooms[s] > filled[s]:
                    parked[rooms[s] - filled[s]].append(s)
            if ready:
                s, part = ready[0][1], n
            else:
                part = next(r for r in range(n - 1, 0, -1) if parked[r])
                s = parked[part].pop()
                waiting[n - part].append((item, start + part))
            yield item, start, part, s, filled[s]
            filled[s] += part
            costs[s] += cost.of(part)
            if part == n:
                heapq.heapreplace(ready, (costs[s], s))


def token_rows(docs: DataFrame, tokenizer: TokenizerFile, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Documents cut at multiples of ``capacity`` into pieces: _part, _row (the row's place in its task), _id, _from, _length, _tokens, _crc, _ids."""
    shipped = tokenizer.ship(docs.sparkSession)
    schema = T.StructType([
        T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_from", T.LongType()),
        T.StructField("_length", T.IntegerType()), T.StructField("_tokens", T.LongType()), T.StructField("_crc", T.LongType()), T.StructField("_ids", T.BinaryType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, first = encoder(shipped), TaskContext.get().partitionId(), 0
        for b in slices(batches):
            row, start, length, tokens, crc, raw = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False)
                for at in range(0, len(ids), capacity):
                    data = ids[at : at + capacity].tobytes()
                    row.append(i)
                    start.append(at)
                    length.append(len(data) // 4)
                    tokens.append(len(ids))
                    crc.append(zlib.crc32(data))
                    raw.append(data)
            cols = [
                pa.array([part] * len(row), pa.int32()), pa.array(np.array(row, np.int64) + first), b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                pa.array(length, pa.int32()), pa.array(tokens, pa.int64()), pa.array(crc, pa.int64()), pa.array(raw, pa.binary()),
            ]
            first += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.select(quoted(id_col), text_of(text_col)).mapInArrow(cut, schema)


def balanced_packing(docs: DataFrame, tokenizer: TokenizerFile, capacity: int = 2048, end_id: int = 1, cost: Cost | None = None, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost, and ids if asked for.

    A document is its ids and then ``end_id``; a null or empty text is the end id alone. start counts its ids before the
    piece, offset the places before it in its sequence; cost is the piece's own, so a sequence costs the sum of its
    pieces. ids are little-endian unsigned 32-bit.

    Documents are tokenized once into pieces of at most ``capacity``, which are written. Pieces without their ids are dealt
    at random into groups of about GROUP_PIECES, by the place of a row in its file and not by its id, so rows that repeat
    do not meet in one group. Each group assigns its pieces in descending cost to the sequence of least cost that has
    room. A group has just as many places as tokens: full sequences, and powers of two for the rest, which need no
    padding. Thus the last pieces fill what is left and some of them are cut once more; only for those the ids are read
    again, by a join that rows of other pieces skip.

    A full piece costs more than any mixture, so costs of sequences are even as far as documents are shorter than
    ``capacity``. Rows that repeat an id, and null ids, are packed each; ties go by place; other columns are ignored; an
    empty table gives an empty result.
    """
    cost = cost or Cost()
    id_type = docs.schema[id_col].dataType
    rows = materialize(token_rows(docs, tokenizer, capacity, end_id, id_col, text_col), "token-rows")
    groups = max(1, -(-rows.count() // GROUP_PIECES))
    narrow = rows.select(F.pmod(F.xxhash64("_part", "_row", "_from"), F.lit(groups)).alias("_group"), "_part", "_row", "_id", "_from", "_length", "_tokens", "_crc")
    schema = T.StructType([
        T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_id", id_type), T.StructField("_from", T.LongType()), T.StructField("_tokens", T.LongType()), T.StructField("_crc", T.LongType()),
        T.StructField("_skip", T.IntegerType()), T.StructField("_n", T.IntegerType()), T.StructField("_sequence", T.LongType()), T.StructField("_offset", T.LongType()), T.StructField("_cost", T.DoubleType()),
    ])

    def place(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("_part", "ascending"), ("_row", "ascending"), ("_from", "ascending")])  # rows come in any order
        lengths = t.column("_length").to_numpy()
        placed = np.array(list(assign(lengths.tolist(), capacity, cost)), np.int64).reshape(-1, 5)
        item, skip, n, sequence, offset = placed.T
        own = t.select(["_part", "_row", "_id", "_from", "_tokens", "_crc"]).take(pa.array(item))
        whole = n == lengths[item]
        crc = pa.array(own.column("_crc").to_numpy(), pa.int64(), mask=~whole)
        costs = cost.linear * n + cost.quadratic * n * n
        more = [pa.array(skip.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(sequence + key[0].as_py() * STRETCH), pa.array(offset), pa.array(costs.astype(np.float64))]
        return pa.table([*own.columns[:5], crc, *more], schema.names)

    places = materialize(narrow.groupBy("_group").applyInArrow(place, schema), "places")
    start, out = F.col("_from") + F.col("_skip"), ["_id", "_start", "_n", "_crc", "_tokens", "_sequence", "_offset", "_cost"]
    again = F.lit(True) if keep_ids else F.col("_crc").isNull()
    cut = places.where(again)
    whole = places.where(~again).withColumn("_start", start).select(*out)
    key = ["_part", "_row", "_from"]
    of = rows.select(*key, "_ids")
    if not keep_ids:
        keys = cut.select(F.xxhash64(*key).alias("_h")).distinct()
        of = Presence(keys, "_h").flag(of, F.xxhash64(*key), "_maybe").where("_maybe").drop("_maybe")
    found = cut.withColumn("_start", start).drop("_crc").join(of, key).select("_id", "_start", F.col("_n").cast("long"), F.substring("_ids", F.col("_skip") * 4 + 1, F.col("_n") * 4).alias("_ids"), "_tokens", "_sequence", "_offset", "_cost")
    found = found.withColumn("_crc", F.crc32("_ids"))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
    if keep_ids:
        return found.select(*out, "_ids").toDF(*names, "ids")
    return whole.withColumn("_n", F.col("_n").cast("long")).unionByName(found.select(*out)).toDF(*names)
