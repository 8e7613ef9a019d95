"""Ranked lexical search over a bit-sliced index of term impacts."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice, zip_longest

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, quoted, slices, text_of

#: Fixed value: a term is a maximal run of characters other than ASCII controls, space and punctuation.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A segment of the index ends at so many documents, or terms with repeats.
SEGMENT_DOCUMENTS = 16_384
SEGMENT_TERMS = 8_000_000
#: Items that one pass over the index answers; their terms are sent to all tasks.
BLOCK_ITEMS = 512
#: Terms up to which a list of wanted terms is sent to the tasks that read the texts (a few MB); beyond it all terms are indexed.
SENT_TERMS = 200_000


def _folded() -> bytes:
    """A byte's replacement: A-Z in lower case, other ASCII that ends a term as a space. Bytes of longer characters stay."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(out)


FOLD = _folded()


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats, in order."""
    return text.translate(FOLD).split()


def postings(docs: DataFrame, wanted: frozenset[bytes] | None, id_col: str, text_col: str) -> DataFrame:
    """Segments of documents: for each one row without term (ids, lengths in terms), and one row for each term that occurs.

    Columns: segment, term, n (documents that hold it), places (of these in the segment), counts, ids, lengths.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType()),
        T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("lengths", T.BinaryType()),
    ])

    def written(segment: int, ids: list[pa.Array], lengths: list[int], places: dict[bytes, array], counts: dict[bytes, array]) -> Iterator[pa.RecordBatch]:
        all_ids = pa.concat_arrays(ids)
        one = pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([None], pa.string()), pa.array([len(all_ids)], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), one, pa.array([np.array(lengths, "<i8").tobytes()], pa.binary())], schema.names)
        left = iter(places)
        while some := list(islice(left, 4096)):
            k = len(some)
            cols = [pa.array([segment] * k, pa.int64()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([len(places[t]) for t in some], pa.int64()), pa.array([places[t].tobytes() for t in some], pa.binary()), pa.array([counts[t].tobytes() for t in some], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(k, one.type), pa.nulls(k, pa.binary())], schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, number = shipped.value, TaskContext.get().partitionId() << 32
        ids, lengths, places, counts, total = [], [], {}, {}, 0
        for b in slices(batches):
            for text in b.column(1).cast(pa.binary()).to_pylist():
                found = terms(text)
                at = len(lengths)
                lengths.append(len(found))
                total += len(found)
                for term, n in Counter(found if keep is None else filter(keep.__contains__, found)).items():
                    if term not in places:
                        places[term], counts[term] = array("H"), array("I")
                    places[term].append(at)
                    counts[term].append(n)
            ids.append(b.column(0))
            if len(lengths) + 128 > SEGMENT_DOCUMENTS or total > SEGMENT_TERMS:
                yield from written(number, ids, lengths, places, counts)
                ids, lengths, places, counts, total, number = [], [], {}, {}, 0, number + 1
        if lengths:
            yield from written(number, ids, lengths, places, counts)

    return docs.select(quoted(id_col), text_of(text_col)).mapInArrow(read, schema)


def sliced(numbers: np.ndarray) -> tuple[int, bytes]:
    """Bits of the largest number, and one packed row of bits for each of them, the lowest first."""
    bits = int(numbers.max(initial=0)).bit_length()
    rows = (numbers >> np.arange(bits, dtype=np.int64)[:, None]) & 1
    return bits, np.packbits(rows.astype(np.uint8), axis=1, bitorder="little").tobytes()


class ImpactIndex:
    """Bit-sliced impacts of terms: ``segments`` (segment, ids, lengths), ``slices`` (segment, term, bits, places, impacts).

    A term's impact on a document is w * ((1000000000*tf) div (1000*tf + 20*m)) in 64-bit integers, where
    w = floor(1000*ln((2N+2)/(2 df+1))), m = 100 - 50 + (50 n N) div L, n is the document's terms with repeats, N the
    number of documents with a term and L the sum of n. impacts holds, for each bit from the lowest on, one bit for every
    document of the segment that holds the term; places says which these are. So a term costs 16 bits and one for each
    bit of its largest impact, a document.

    Documents are read once into segments, inside the tasks that scan them, and nothing of a text is shuffled. What is
    counted over the whole table is N and L, two numbers, and the documents of each term, one row for each term and segment.
    """

    def __init__(self, segments: DataFrame, slices_: DataFrame):
        self.segments, self.slices = segments, slices_

    @classmethod
    def build(cls, docs: DataFrame, only: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> ImpactIndex:
        """Index every row of docs, for all terms or those in the column term of ``only``; all other counts are of whole texts.

        Null and empty texts have no terms and are in no result. A list of up to SENT_TERMS terms is sent to the readers;
        a longer one is joined afterwards.
        """
        wanted = None
        if only is not None:
            only = only.select("term").distinct()
            few = only.limit(SENT_TERMS + 1).collect()
            wanted = frozenset(r.term.encode() for r in few) if len(few) <= SENT_TERMS else None
        rows = materialize(postings(docs, wanted, id_col, text_col), "postings")
        segments, held = rows.where("term is null").select("segment", "ids", "lengths"), rows.where("term is not null").select("segment", "term", "n", "places", "counts")
        if only is not None and wanted is None:
            held = held.join(only, "term", "left_semi")

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["n", "l"])

        total = segments.select("lengths").mapInArrow(tally, "n bigint, l bigint").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
        count, length = int(total.n or 0), int(total.l or 0)
        weight = F.floor(1000 * F.log((2.0 * count + 2) / (2.0 * F.col("df") + 1))).cast("long")
        weights = held.groupBy("term").agg(F.sum("n").alias("df")).select(F.col("term").alias("_term"), weight.alias("w"))
        weighed = held.join(weights, F.col("term") == F.col("_term")).select("segment", "term", "w", "places", "counts")
        schema = "segment bigint, term string, bits int, places binary, impacts binary"

        def slice_up(key: tuple, of_terms: pa.Table, of_docs: pa.Table) -> pa.Table:
            out = {k: [] for k in ("bits", "impacts")}
            n = np.frombuffer(of_docs.column("lengths")[0].as_py(), "<i8") if of_docs.num_rows else np.empty(0, np.int64)
            m = 50 + (50 * n * count) // max(length, 1)
            for w, places, counts in zip(of_terms.column("w").to_pylist(), of_terms.column("places").to_pylist(), of_terms.column("counts").to_pylist(), strict=True):
                tf = np.frombuffer(counts, "<u4").astype(np.int64)
                bits, data = sliced(w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[np.frombuffer(places, "<u2")])))
                out["bits"].append(bits)
                out["impacts"].append(data)
            return pa.table([of_terms.column("segment"), of_terms.column("term"), pa.array(out["bits"], pa.int32()), of_terms.column("places"), pa.array(out["impacts"], pa.binary())], ["segment", "term", "bits", "places", "impacts"])

        index = weighed.groupBy("segment").cogroup(segments.select(F.col("segment").alias("_segment"), "lengths").groupBy("_segment")).applyInArrow(slice_up, schema)
        return cls(segments, materialize(index, "impact-index"))

    def search(self, items: DataFrame, k: int = 50, item_col: str = "item_id", id_col: str = "doc_id") -> DataFrame:
        """The k documents of highest score for each item, or all above 0 if fewer: item, rank from 1, id, score.

        items: an item and ``terms``, an array, in each row. A score is the sum of the impacts of the item's terms, once
        each; equal scores go by ascending id, null ids last. Items are taken in blocks of BLOCK_ITEMS, each of which is
        one pass over the slices of its terms. In a segment the slices of an item's terms are added bit by bit with
        carries, all documents at once, and the best are found from the highest slice down; only those, at most k of a
        segment, are sorted with those of others.
        """
        item_type = items.schema[item_col].dataType
        found, left = [], items.select(quoted(item_col), "terms").toLocalIterator()
        while block := list(islice(left, BLOCK_ITEMS)):
            found.append(self._block([(r[0], sorted(set(r[1]))) for r in block], k, item_type))
        schema = f"_item {item_type.simpleString()}, _id {self.segments.schema['ids'].dataType.elementType.simpleString()}, _score bigint"
        spark = items.sparkSession
        rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
        rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("_score"), F.asc_nulls_last("_id")))
        best = rows.withColumn("_rank", rank).where(F.col("_rank") <= k)
        return best.select(F.col("_item").alias(item_col), F.col("_rank").alias("rank"), F.col("_id").alias(id_col), F.col("_score").alias("score"))

    def _block(self, block: list[tuple], k: int, item_type: T.DataType) -> DataFrame:
        spark = self.slices.sparkSession
        needed = sorted({t for _, own in block for t in own})
        here = self.slices.join(F.broadcast(spark.createDataFrame([(t,) for t in needed], "_needed string")), F.col("term") == F.col("_needed"), "left_semi")
        sent = spark.sparkContext.broadcast(block)
        schema = T.StructType([T.StructField("_item", item_type), T.StructField("_id", self.segments.schema["ids"].dataType.elementType), T.StructField("_score", T.LongType())])

        def answer(key: tuple, of_terms: pa.Table, of_docs: pa.Table) -> pa.Table:
            from pyspark.sql.pandas.types import to_arrow_type

            ids = of_docs.column("ids").combine_chunks().flatten() if of_docs.num_rows else pa.array([], to_arrow_type(schema["_id"].dataType))
            known = {t: opened(p, b, x, len(ids)) for t, b, p, x in zip(*(of_terms.column(c).to_pylist() for c in ("term", "bits", "places", "impacts")), strict=True)}
            of_item, at, scores = [], [], []
            for item, own in sent.value:
                total = reduce(add, (known[t] for t in own if t in known), [])
                best, points = top(total, k, lambda tied, n: lowest(ids, tied, n))
                of_item += [item] * len(best)
                at += best
                scores += points
            return pa.table([pa.array(of_item, to_arrow_type(item_type)), ids.take(pa.array(at, pa.int64())), pa.array(scores, pa.int64())], schema.names)

        return here.groupBy("segment").cogroup(self.segments.select(F.col("segment").alias("_segment"), "ids").groupBy("_segment")).applyInArrow(answer, schema)


def members(bitmap: int) -> np.ndarray:
    """The places of a bitmap's bits, ascending."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap.to_bytes(-(-bitmap.bit_length() // 8), "little"), np.uint8), bitorder="little"))


def opened(places: bytes, bits: int, impacts: bytes, size: int) -> list[int]:
    """A term's slices as bitmaps over all documents of its segment, the lowest bit first."""
    if not bits:
        return []
    at = np.frombuffer(places, "<u2")
    packed = np.frombuffer(impacts, np.uint8).reshape(bits, -1)
    wide = np.zeros((bits, size), np.uint8)
    wide[:, at] = np.unpackbits(packed, axis=1, count=len(at), bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(wide, axis=1, bitorder="little")]


def add(a: list[int], b: list[int]) -> list[int]:
    """The sums of two bit-sliced columns of numbers: per slice the sum bit and the carry of all rows at once."""
    out, carry = [], 0
    for x, y in zip_longest(a, b, fillvalue=0):
        half = x ^ y
        out.append(half ^ carry)
        carry = (x & y) | (carry & half)
    return [*out, carry] if carry else out


def top(total: list[int], k: int, choose) -> tuple[list[int], list[int]]:
    """Places and sums of the k largest sums above 0. choose(places, n) picks n of places whose sums are equal.

    From the highest slice down, ``sure`` are rows that are certainly among the k, ``tied`` those that agree so far with
    the k-th.
    """
    sure, tied = 0, reduce(int.__or__, total, 0)
    for s in reversed(total):
        more = sure | (tied & s)
        n = more.bit_count()
        if n > k:
            tied &= s
        else:
            sure, tied = more, tied & ~s
            if n == k:
                tied = 0
                break
    best = members(sure)
    if tied:
        ties = members(tied)
        best = np.concatenate((best, choose(ties, k - len(best)) if len(ties) > k - len(best) else ties)).astype(np.int64)
    sums = np.zeros(len(best), np.int64)
    for bit, s in enumerate(total):
        row = np.unpackbits(np.frombuffer(s.to_bytes(-(-s.bit_length() // 8), "little"), np.uint8), bitorder="little")
        sums += np.where(best < len(row), row[np.minimum(best, max(len(row) - 1, 0))] if len(row) else 0, 0).astype(np.int64) << bit
    return best.tolist(), sums.tolist()


def lowest(ids: pa.Array, at: np.ndarray, n: int) -> np.ndarray:
    """The n of the places ``at`` whose ids are lowest, null ids last."""
    import pyarrow.compute as pc

    return at[pc.sort_indices(ids.take(pa.array(at))).to_numpy()[:n]]


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each item with its distinct terms; rows that repeat an item are one with the terms of all."""
    low = F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found: Column = F.regexp_extract_all(low, F.lit(TERM_PATTERN), F.lit(0))
    return items.select(quoted(item_col), F.explode(found).alias("_term")).groupBy(quoted(item_col)).agg(F.collect_set("_term").alias("terms"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rank all documents for each item by :class:`ImpactIndex`, built for the items' terms: item, rank, id, score.

    Every row of docs is indexed, so rows that repeat count and are ranked each; other columns are ignored. Items without
    a term, and terms that no document holds, have no rows; an empty table on either side gives an empty result.
    """
    of = materialize(item_terms(items, item_col, item_text_col), "item-terms")
    index = ImpactIndex.build(docs, of.select(F.explode("terms").alias("term")), id_col, text_col)
    return index.search(of, k, item_col, id_col)
