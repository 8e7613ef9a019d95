"""Alignment of two tokenizers over the same texts, and how often their tokens meet in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, quoted, slices, text_of
from .tokenizer import TokenizerFile, encoder, token_bytes

#: A block of documents ends at so many of them, or of their distinct linked pairs, summed over documents.
BLOCK_DOCUMENTS = 4096
BLOCK_PAIRS = 2_000_000


class IntervalIndex:
    """A static index over intervals that follow each other: their starts and ends, both sorted, for stabbing by bisection."""

    def __init__(self, lengths: np.ndarray):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def overlaps(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the first interval that ends after its start, and the first that begins at its end or later."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")


def links(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) positions of all pairs of tokens that overlap, in order, and the group of each token of A and of B.

    Both lists cover the same bytes and no token is empty. A gap between two tokens of B that no token of A spans is a
    place where both end, so groups are counted by such gaps.
    """
    end = np.cumsum(lengths_a)
    first, stop = IntervalIndex(lengths_b).overlaps(end - lengths_a, end)
    many = stop - first
    a = np.repeat(np.arange(len(lengths_a)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many - first, many)
    spanned = np.zeros(len(lengths_b), bool)  # whether the gap before a token of B is
    spanned[b[1:][a[1:] == a[:-1]]] = True
    group_b = np.cumsum(~spanned) - 1
    return a, b, group_b[first], group_b


class Written:
    """The decimal numbers of all ids behind each separator, so that a document's groups are one join of known parts."""

    def __init__(self, size: int):
        numbers = [b"%d" % i for i in range(size)]
        self.size, self.parts = size, [mark + n for mark in (b"", b";", b",", b"|") for n in numbers]

    def groups(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of A and B by groups."""
        group = np.concatenate((group_a, group_b))
        order = np.argsort(group * 2 + np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)], kind="stable")
        heads = lambda g: np.r_[True, g[1:] != g[:-1]][: len(g)]
        mark = np.concatenate((np.where(heads(group_a), 1, 2), np.where(heads(group_b), 3, 2)))[order]
        mark[:1] = 0
        keys = mark * self.size + np.concatenate((a, b)).astype(np.int64)[order]
        return b"".join(map(self.parts.__getitem__, keys.tolist()))


def _aligned(docs: DataFrame, a: TokenizerFile, b: TokenizerFile, prefix_a: str, prefix_b: str, prefix: str, id_col: str, text_col: str, keep_groups: bool) -> DataFrame:
    """Blocks of documents: a row for each, with its distinct pairs as places in the block's list, and one with that list.

    pairs and times (how many links) belong to a document; keys (ascending) and held (how many of its documents) to a block.
    """
    spark = docs.sparkSession
    ship_a, ship_b = a.ship(spark), b.ship(spark)
    longs = ("_a", "_b", "_groups", "_links")
    schema = T.StructType([
        T.StructField("_block", T.LongType()), T.StructField("_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("_sha", T.StringType()), T.StructField("_text", T.BinaryType()),
        *(T.StructField(c, T.BinaryType()) for c in ("_pairs", "_times", "_keys", "_held")),
    ])

    def written(block: int, ids: list[pa.Array], rows: list[tuple], keys: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        known, place, held = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        cut = np.cumsum([0, *map(len, keys)])
        of = [place[s:t].astype("<u4").tobytes() for s, t in zip(cut[:-1], cut[1:], strict=True)]
        all_ids = pa.concat_arrays(ids)
        for at in range(0, len(rows), 128):
            some = rows[at : at + 128]
            k = len(some)
            cols = list(zip(*some, strict=True))
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * k, pa.int64()), all_ids.slice(at, k), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary()),
                pa.array(of[at : at + k], pa.binary()), pa.array([x.astype("<u4").tobytes() for x in times[at : at + k]], pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
            ], schema.names)
        no = [pa.nulls(1, t) for t in (all_ids.type, *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 3)]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *no, pa.array([known.astype("<i8").tobytes()], pa.binary()), pa.array([held.astype("<i8").tobytes()], pa.binary())], schema.names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, encode_b, bytes_a, bytes_b = encoder(ship_a), encoder(ship_b), token_bytes(ship_a), token_bytes(ship_b)
        length_a, length_b = (np.array([len(x) for x in t], np.int64) for t in (bytes_a, bytes_b))
        write, block = Written(max(len(bytes_a), len(bytes_b))), TaskContext.get().partitionId() << 32
        none = np.empty(0, np.int64)
        ids, rows, keys, times, held = [], [], [], [], 0
        for batch in slices(batches):
            ids.append(batch.column(0))
            for text in batch.column(1).to_pylist():
                whole = (prefix + text).encode()
                x, y = (encode_a(prefix_a + text), encode_b(prefix_b + text)) if text else (none, none)
                same = text and all(b"".join(map(table.__getitem__, t.tolist())) == whole for table, t in ((bytes_a, x), (bytes_b, y)))
                if not same:
                    rows.append((0, 0, 0, 0, "", None))
                    keys.append(none)
                    times.append(none)
                    continue
                x, y = x[length_a[x] > 0], y[length_b[y] > 0]
                at_a, at_b, group_a, group_b = links(length_a[x], length_b[y])
                line = write.groups(x, group_a, y, group_b)
                pairs, n = np.unique(x[at_a].astype(np.int64) << 32 | y[at_b], return_counts=True)
                rows.append((len(x), len(y), int(group_b[-1]) + 1, len(at_a), hashlib.sha256(line).hexdigest(), line if keep_groups else None))
                keys.append(pairs)
                times.append(n)
                held += len(pairs)
            if len(rows) + 128 > BLOCK_DOCUMENTS or held > BLOCK_PAIRS:
                yield from written(block, ids, rows, keys, times)
                ids, rows, keys, times, held, block = [], [], [], [], 0, block + 1
        if rows:
            yield from written(block, ids, rows, keys, times)

    return docs.select(quoted(id_col), text_of(text_col)).mapInArrow(align, schema)


def _block_keys(aligned: DataFrame) -> DataFrame:
    """(_block, _key, _n): the distinct pairs of each block, and in how many of its documents each is."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                k, n = np.frombuffer(keys, "<i8"), np.frombuffer(held, "<i8")
                for at in range(0, len(k), 65_536):
                    part = k[at : at + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(n[at : at + 65_536])], ["_block", "_key", "_n"])

    return aligned.where("_keys is not null").select("_block", "_keys", "_held").mapInArrow(each, "_block bigint, _key bigint, _n bigint")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(_pair, _count, _best): in how many documents a pair of ids is linked, and whether no pair of its A id is in more.

    A block sends each of its pairs once, however many documents hold it; an A id has at most as many rows here as
    B has ids.
    """
    counts = _block_keys(aligned).groupBy("_key").agg(F.sum("_n").alias("_count"))
    most = F.max("_count").over(Window.partitionBy(F.shiftright("_key", 32)))
    return counts.select(F.col("_key").alias("_pair"), "_count", (F.col("_count") == most).alias("_best"))


def align_tokenizers(docs: DataFrame, a: TokenizerFile, b: TokenizerFile, prefix_a: str = " ", prefix_b: str = "", prefix: str = " ", id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if asked for.

    Texts are encoded with ``prefix_a`` or ``prefix_b`` before them; the tokens' bytes must join to ``prefix`` and the text.
    Texts that are null, empty or do not come out so have no tokens: zeros, and an empty groups_sha256. Where tokens of
    A and B both end, the text is cut into groups, written as in :class:`Written`. Tokens of A and B are linked where
    their bytes overlap. n_best is the number of links whose pair of ids is in as many documents of the table as any pair
    of that A id; count_sum adds over the links how many documents hold their pair.

    A text is encoded once. Documents are kept by blocks, made inside the tasks that scan them; a block has a list of its
    distinct pairs, and its documents refer to places in it. Only such lists are counted over the corpus and joined with
    the counts, then each block gets its own back; so a pair that is in all documents is one row of a block, and nothing
    is broadcast. Rows that repeat count as a document each, null ids stay, other columns are ignored; an empty table gives
    an empty result.
    """
    aligned = materialize(_aligned(docs, a, b, prefix_a, prefix_b, prefix, id_col, text_col, keep_groups), "aligned")
    counts = materialize(pair_counts(aligned), "pair-counts")
    known = _block_keys(aligned).select("_block", "_key").join(counts, F.col("_key") == F.col("_pair")).select(F.col("_block").alias("_of"), "_key", "_count", "_best")
    shown = [c for c in ("_id", "_a", "_b", "_groups", "_links", "_sha", *(["_text"] if keep_groups else []))]
    of_docs = aligned.where("_keys is null").select("_block", *shown, "_pairs", "_times")
    schema = T.StructType([*(of_docs.schema[c] for c in shown), T.StructField("_n_best", T.LongType()), T.StructField("_sum", T.LongType())])

    def look_up(key: tuple, of: pa.Table, counted: pa.Table) -> pa.Table:
        order = np.argsort(counted.column("_key").to_numpy())
        count, best = counted.column("_count").to_numpy()[order], counted.column("_best").to_numpy()[order]
        n_best, total = [], []
        for pairs, times in zip(of.column("_pairs").to_pylist(), of.column("_times").to_pylist(), strict=True):
            p, n = np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int(n[best[p]].sum()))
            total.append(int((n * count[p]).sum()))
        return pa.table([*(of.column(c) for c in shown), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], schema.names)

    out = of_docs.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(look_up, schema)
    cols = {"_id": id_col, "_a": "n_a", "_b": "n_b", "_groups": "n_groups", "_links": "n_links", "_n_best": "n_best", "_sum": "count_sum", "_sha": "groups_sha256"} | ({"_text": "groups"} if keep_groups else {})
    return out.select(*(F.col(k).cast("string").alias(v) if k == "_text" else F.col(k).alias(v) for k, v in cols.items()))
