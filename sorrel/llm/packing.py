"""Packing tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, quoted, slices, text_of
from .packing_plan import Slot, plan
from .tokenizer import TokenizerFile, encoder

#: Items of one length that share a bucket when they are numbered; a bucket is sorted in one task.
BUCKET_ITEMS = 20_000
LEAST_BUCKETS = 256
#: Rows of a plan, of seven numbers each, up to which it is broadcast (6 MB).
BROADCAST_ROWS = 100_000


def pieces(docs: DataFrame, tokenizer: TokenizerFile, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Tokenized pieces: id, piece, start, length, ids_crc32, if asked for ids (little-endian unsigned 32-bit), and ``carry``, columns of docs.

    A document is its ids and then ``end_id``. Longer ones than ``capacity`` are cut into pieces of that length, of
    which the first may be shorter. A null or empty text is the end id alone.
    """
    shipped = tokenizer.ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if keep_ids else []), *(docs.schema[c] for c in carry)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shipped)
        for b in slices(batches):
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False)
                first = len(ids) % capacity or capacity
                for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at : first if k == 0 else at + capacity].tobytes()
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        raw.append(part)
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            more = [b.column(2 + k).take(pa.array(row, pa.int64())) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(raw, pa.binary())] if keep_ids else []), *more], schema.names)

    return docs.select(quoted(id_col), text_of(text_col), *map(quoted, carry)).mapInArrow(cut, schema)


def _places(slots: list[Slot], histogram: dict[int, int]) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(length, width) for each length, and slots by the stretches of ``width`` ranks that they reach into.

    A length has as many stretches as slots, so each slot is listed about twice and a rank meets about two slots.
    """
    per = Counter(s.length for s in slots)
    width = {n: -(-histogram[n] // per[n]) for n in per}
    rows = []
    for s in slots:
        end = s.first + s.times * s.copies
        for stretch in range(s.first // width[s.length], (end - 1) // width[s.length] + 1):
            rows.append((s.length, stretch, s.first, end, s.times, s.sequence, s.offset))
    return sorted(width.items()), rows


def pack(items: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Give each piece a sequence_id and an offset so that few sequences of ``capacity`` hold all; all columns stay.

    items: materialized rows with ``length`` between 1 and capacity, ``piece`` and an id; its plan is read twice.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver. Its configuration linear program is
    solved by multiplicative weights with knapsack pricing and rounded; the plan says which ranks of a length go to which
    sequences. Its size depends on the number of lengths and rounds, not on the number of pieces: some 6,000 slots for 2048
    lengths at any count. Up to BROADCAST_ROWS rows of it are broadcast, more are joined like any table. Pieces are
    numbered within their length by hashed buckets, so one length that holds most of the rows is numbered by many tasks. A
    piece without a place is an error. Ties are numbered in any order; an empty table gives an empty result.
    """
    spark = items.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, _, _ = plan(histogram, capacity)
    widths, rows = _places(slots, histogram)
    buckets = max(LEAST_BUCKETS, -(-max(histogram.values(), default=0) // BUCKET_ITEMS))
    bucket, rank, width = fresh(items, "_bucket", "_rank", "_width")
    keyed = items.withColumn(bucket, F.pmod(F.xxhash64(quoted(id_col), "piece"), F.lit(buckets)))
    sizes = keyed.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("_n"))
    of_length = F.broadcast(spark.createDataFrame(widths, "_wl bigint, _w bigint"))
    running = F.sum("_n").over(Window.partitionBy("length").orderBy(bucket)) - F.col("_n")
    names = fresh(keyed, "_bl", "_bb", "_before", "_bw")
    before = sizes.withColumn("_before", running).join(of_length, F.col("length") == F.col("_wl")).select("length", bucket, "_before", "_w").toDF(*names)
    bl, bb, earlier, bw = map(F.col, names)
    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy("length", bucket).orderBy(quoted(id_col), "piece")) - 1)
    ranked = ranked.join(before, (F.col("length") == bl) & (F.col(bucket) == bb))
    ranked = ranked.select(*map(quoted, items.columns), (earlier + F.col(rank)).alias(rank), bw.alias(width))
    names = fresh(ranked, "_pl", "_stretch", "_first", "_end", "_times", "_sequence", "_at")
    table = spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))
    table = F.broadcast(table.coalesce(1)) if len(rows) <= BROADCAST_ROWS else table
    pl, stretch, first, end, times, sequence, at = map(F.col, names)
    r = F.col(rank)
    here = (F.col("length") == pl) & (F.floor(r / F.col(width)) == stretch) & (r >= first) & (r < end)
    placed = ranked.join(table, here, "left")
    lost = F.raise_error(F.lit("a piece has no place in the plan")).cast("long")
    return placed.select(
        *map(quoted, items.columns),
        F.when(sequence.isNull(), lost).otherwise(sequence + (r - first) % times).alias("sequence_id"),
        (at + F.floor((r - first) / times) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: TokenizerFile, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Tokenize, cut and pack: the columns of :func:`pieces` with sequence_id and offset.

    A null text counts as empty; rows that repeat an id are packed each, as are null ids; other columns than ``carry`` are
    ignored. An empty table gives an empty result.
    """
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id, keep_ids, id_col, text_col, carry), "pieces"), capacity, id_col)
