"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python, so that batches of long texts stay small.
BATCH_ROWS = 128
#: A presence bitmap never has more bits than two to this power (8 MB), whatever the input.
MAX_BITMAP_LOG2 = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batch_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside; the session's own setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if int(own) <= 0 or int(own) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of at most ``rows`` rows, for frames that are run after their function has returned."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Only a session in one process may have none; it gets a temporary one. On a cluster that is an error, as executors
    would write to their own disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sorrel-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor costs a reread of the files, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        jvm, path = df.sparkSession.sparkContext._jvm, df._written_to
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Materializes tables and deletes them all when its block ends; what outlives the block must be written elsewhere."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(materialize(df, label))
        return self.tables[-1]

    def __exit__(self, *error: object) -> None:
        discard(*self.tables)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column], *tuple[str, ...]]:
    """df with columns c0, c1, ..., which clash with no working column; what selects its own names back; the new names of some."""
    new = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return new, [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], *(f"c{df.columns.index(n)}" for n in names)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(text_col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(quoted(text_col), F.lit(""))


class Presence:
    """A bitmap over hashed keys that is small enough to be broadcast.

    It answers "certainly not among the keys" or "perhaps"; the rows that may be there go on to an exact join, all
    others skip that shuffle. The table has at most ``2**(MAX_BITMAP_LOG2 - 6)`` rows of one long, so the broadcast is
    bounded; beyond its capacity only more rows take the exact join and results stay the same.
    """

    def __init__(self, keys: DataFrame, key: str):
        """keys: a frame with a bigint column ``key`` of well-mixed hashes that is cheap to read twice."""
        n = keys.count()
        self.bits = min(MAX_BITMAP_LOG2, max(10, (16 * max(1, n) - 1).bit_length()))
        self.empty = n == 0
        words = keys.select(self._word(F.col(key)).alias("_pw"), F.call_function("shiftleft", F.lit(1).cast("long"), self._bit(F.col(key))).alias("_pb"))
        self.table = words.groupBy("_pw").agg(F.bit_or("_pb").alias("_pb"))

    def _word(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - self.bits + 6).cast("int")

    def _bit(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - self.bits).bitwiseAND(F.lit(63)).cast("int")

    def flag(self, df: DataFrame, h: Column, name: str) -> DataFrame:
        """Add a boolean column that is false only where the hash is certainly not among the keys."""
        if self.empty:
            return df.withColumn(name, F.lit(False))
        at, bit, word, bits = fresh(df, "_at", "_bit", "_word", "_bits")
        joined = df.withColumns({at: self._word(h), bit: self._bit(h)}).join(F.broadcast(self.table.toDF(word, bits)), F.col(at) == F.col(word), "left")
        return joined.select(*map(quoted, df.columns), F.coalesce(F.bit_get(F.col(bits), F.col(bit)) == 1, F.lit(False)).alias(name))


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs whose id isn't in the column ``id_col`` of dropped; texts of rows surely kept aren't shuffled.

    A row with a null id stays. dropped: a frame that is cheap to read twice.
    """
    lost, maybe = fresh(docs, "_lost", "_maybe")
    ids = dropped.select(quoted(id_col).alias(lost)).where(F.col(lost).isNotNull()).distinct()
    seen = Presence(ids.select(F.xxhash64(lost).alias("_h")), "_h")
    flagged = seen.flag(docs, F.xxhash64(quoted(id_col)), maybe)
    sure = flagged.where(~F.col(maybe)).drop(maybe)
    if seen.empty:
        return sure
    return sure.unionByName(flagged.where(F.col(maybe)).drop(maybe).join(ids, quoted(id_col) == F.col(lost), "left_anti"))
