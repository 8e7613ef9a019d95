"""Exact duplicates by counting quotient filters with byte verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Presence, Scratch, fresh, materialize, quoted, text_of, without_ids

#: High bits of a fingerprint that form its quotient; the rest is the remainder, of which these are beyond the low 32.
QUOTIENT_BITS = 20
REMAINDER_BITS = 64 - QUOTIENT_BITS
REST_BITS = REMAINDER_BITS - 32


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask, bitorder="little").tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)


class CountingQuotientFilter:
    """Fingerprints of 64 bits as quotients, sorted remainders and counts, without loss.

    A filter covers the quotients from ``first`` on, ``size`` of them. In memory it is sorted fingerprints and their
    counts. Written, a quotient has one bit that says whether it has a run, and each remainder has a slot: its
    ``REMAINDER_BITS`` bits, one bit that ends a run and one that says a counter follows; counters are as wide as the
    largest needs. That is 5.8 bytes for a fingerprint that occurs once. As the remainder keeps all bits that the
    quotient lacks, filters merge into exactly the filter of all their inputs.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, first: int = 0, size: int = 1 << QUOTIENT_BITS):
        self.fingerprints, self.counts, self.first, self.size = fingerprints, counts, first, size

    @classmethod
    def build(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return cls(*np.unique(fingerprints.astype(np.uint64), return_counts=True))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Merge the sorted remainders of filters over the same quotients; counts of equal ones add up."""
        if not filters:
            return cls.build(np.empty(0, np.uint64))
        fps, counts = np.concatenate([f.fingerprints for f in filters]), np.concatenate([f.counts for f in filters])
        order = np.argsort(fps, kind="stable")  # of sorted runs, which this merges
        fps, counts = fps[order], counts[order]
        starts = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]][: len(fps)])
        return cls(fps[starts], np.add.reduceat(counts, starts) if len(starts) else counts, filters[0].first, filters[0].size)

    def blocks(self, shift: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter cut by the high bits of its quotients; parts without a run are left out."""
        if not len(self.fingerprints):
            return
        block = (self.fingerprints >> np.uint64(REMAINDER_BITS + shift)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
        for a, b in zip(cuts, np.r_[cuts[1:], len(block)], strict=True):
            k = int(block[a])
            yield k, CountingQuotientFilter(self.fingerprints[a:b], self.counts[a:b], k << shift, 1 << shift)

    def to_bytes(self) -> bytes:
        """n, then the bits of quotients, run ends and counters, the remainders' low 32 bits and rest, and the counters."""
        n, many = len(self.fingerprints), self.counts > 1
        quotient = (self.fingerprints >> np.uint64(REMAINDER_BITS)).astype(np.int64) - self.first
        occupied = np.zeros(self.size, bool)
        occupied[quotient] = True
        ends = np.r_[quotient[1:] != quotient[:-1], True][:n]
        rest = (self.fingerprints >> np.uint64(32)).astype(np.uint16) & np.uint16((1 << REST_BITS) - 1)
        high = _bits(((rest[:, None] >> np.arange(REST_BITS, dtype=np.uint16)) & 1).astype(bool).ravel())
        wide = next(w for w in (1, 2, 4, 8) if not many.any() or int(self.counts.max()) < 1 << (8 * w))
        head = np.array([n, wide], "<u4").tobytes()
        return b"".join((head, _bits(occupied), _bits(ends), _bits(many), self.fingerprints.astype("<u4").tobytes(), high, self.counts[many].astype(f"<u{wide}").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes, first: int, size: int) -> CountingQuotientFilter:
        n, wide = (int(x) for x in np.frombuffer(data, "<u4", 2))
        at = 8

        def take(length: int) -> bytes:
            nonlocal at
            at += length
            return data[at - length : at]

        occupied = np.flatnonzero(_flags(take(-(-size // 8)), size))
        ends, many = (_flags(take(-(-n // 8)), n) for _ in range(2))
        low = np.frombuffer(take(4 * n), "<u4").astype(np.uint64)
        bits = _flags(take(-(-n * REST_BITS // 8)), n * REST_BITS).reshape(n, REST_BITS)
        rest = (bits * (np.uint64(1) << np.arange(REST_BITS, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
        run = np.cumsum(ends) - ends  # the number of runs that ended before a slot
        quotient = (occupied[run] + first).astype(np.uint64) if n else np.empty(0, np.uint64)
        counts = np.ones(n, np.int64)
        counts[many] = np.frombuffer(take(wide * int(many.sum())), f"<u{wide}").astype(np.int64)
        return cls((quotient << np.uint64(REMAINDER_BITS)) | (rest << np.uint64(32)) | low, counts, first, size)


def repeated_fingerprints(fps: DataFrame, col: str, blocks_log2: int | None = None) -> DataFrame:
    """Fingerprints that occur more than once, as rows (_fp bigint, _n bigint).

    Each partition builds its own filter and sends it cut into blocks of quotients; all parts of one block meet in one
    task, which merges them. The number of blocks follows the number of partitions, so blocks stay small.
    """
    parts = fps.rdd.getNumPartitions() if blocks_log2 is None else 0
    log2 = min(QUOTIENT_BITS, max(8, (parts // 32).bit_length())) if blocks_log2 is None else blocks_log2
    shift = QUOTIENT_BITS - log2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, waiting, held = None, [], 0
        for b in batches:
            waiting.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held += len(waiting[-1])
            if held >= 1 << 18:
                new = CountingQuotientFilter.build(np.concatenate(waiting))
                whole, waiting, held = new if whole is None else CountingQuotientFilter.merge([whole, new]), [], 0
        rest = CountingQuotientFilter.build(np.concatenate(waiting)) if waiting else None
        both = [f for f in (whole, rest) if f is not None]
        rows = [(k, f.to_bytes()) for k, f in CountingQuotientFilter.merge(both).blocks(shift)]
        for i in range(0, len(rows), 1024):
            cols = list(zip(*rows[i : i + 1024], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], ["block", "filter"])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        first = key[0].as_py() << shift
        f = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x, first, 1 << shift) for x in t.column("filter").to_pylist()])
        many = f.counts > 1
        return pa.table({"_fp": f.fingerprints[many].view(np.int64), "_n": f.counts[many]})

    built = fps.select(col).mapInArrow(build, "block int, filter binary")
    return built.groupBy("block").applyInArrow(merge, "_fp bigint, _n bigint")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of two or more equal texts: _gfp, _gsha, _keep, _size, written, by the method in :func:`exact_dedup`."""
    base = docs.select(quoted(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    with Scratch() as keep:
        repeated = keep(repeated_fingerprints(base, "_h"), "repeated")
        suspects = Presence(repeated, "_fp").flag(base, F.col("_h"), "_maybe").where("_maybe")
        # grouping by the text itself is the verification, byte by byte; equal texts of one task become one row before the shuffle
        groups = suspects.groupBy("_h", "_text").agg(F.count(F.lit(1)).alias("_size"), F.max("_id").alias("_keep")).where("_size > 1")
        return materialize(groups.select(F.col("_h").alias("_gfp"), F.sha2("_text", 256).alias("_gsha"), "_keep", "_size"), "groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are; null counts as empty. Of equal texts the row with the largest id stays.

    Every partition puts the fingerprints of its texts into a counting quotient filter; the filters merge without loss,
    and only texts whose fingerprint has a count above one are compared byte by byte. Rows are then resolved by
    fingerprint and SHA-256 of groups that were compared; rows whose fingerprint is in no group are not shuffled.

    Rows that repeat an id with the same text are one document and get the same answer. A null id is less than any
    other; a group of null ids only keeps all its rows. Other columns are ignored; an empty table gives an empty result.
    """
    groups = duplicate_groups(docs, id_col, text_col)
    rows = docs.select(quoted(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_h"), F.sha2(text_of(text_col), 256).alias("_sha"))
    flagged = Presence(groups, "_gfp").flag(rows, F.col("_h"), "_maybe")
    alone = flagged.where("not _maybe").select("_id", "_sha", F.lit(None).cast(groups.schema["_keep"].dataType).alias("_keep"), F.lit(None).cast("long").alias("_size"))
    joined = flagged.where("_maybe").join(groups, (F.col("_h") == F.col("_gfp")) & (F.col("_sha") == F.col("_gsha")), "left").select("_id", "_sha", "_keep", "_size")
    keep = F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    out = alone.unionByName(joined)
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that :func:`exact_dedup` keeps, with all their columns; rows with a null id stay as well.

    Rows go by id and text, so another text under the same id stays.
    """
    (key,) = fresh(docs, "_key")
    pair = lambda i, sha: F.struct(i.alias("i"), sha.alias("h"))
    lost = exact_dedup(docs.select(quoted(id_col).alias("_i"), text_of(text_col).alias("_t")), "_i", "_t").where("not kept and _i is not null")
    lost = materialize(lost.select(pair(F.col("_i"), F.col("text_sha256")).alias(key)), "lost")
    return without_ids(docs.withColumn(key, pair(quoted(id_col), F.sha2(text_of(text_col), 256))), lost, key).drop(key)
