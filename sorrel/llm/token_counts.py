"""Token counts with a cache keyed by digests of content and tokenizer."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Presence, materialize, quoted, shared_dir, slices, text_of
from .tokenizer import TokenizerFile, encoder

CACHE_SCHEMA = "digest binary, n_tokens bigint, version string"


def count_tokens(docs: DataFrame, tokenizer: TokenizerFile, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    cache: a Parquet folder of (digest, n_tokens) by version that all executors reach, so that only one version's counts
    are read; a new one in the checkpoint folder if None. Counts found there are reused, each distinct missing text is encoded once, and its count is appended. The
    content's digest is the SHA-256 of the text with null as empty; nothing else is normalised, as counts depend on
    every byte. The tokenizer's version is a digest of its file and options, so other tokenizers never share counts.

    Texts that are certainly neither cached nor repeated are encoded where they are read; only the others are shuffled.
    A null or empty text has no tokens. Repeated rows and null ids stay, one result each; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    text = text_of(text_col)
    base = docs.select(F.unhex(F.sha2(text, 256)).alias("_digest"), text.alias("_text"))
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == tokenizer.version).select("digest", "n_tokens")
        known.isEmpty()
    except AnalysisException:
        known = spark.createDataFrame([], "digest binary, n_tokens bigint")
    repeated = base.groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_digest")
    special = materialize(repeated.unionByName(known.select(F.col("digest").alias("_digest"))).select(F.xxhash64("_digest").alias("_h")), "known-digests")
    flagged = Presence(special, "_h").flag(base, F.xxhash64("_digest"), "_maybe")
    once = flagged.where(~F.col("_maybe")).select("_digest", "_text")
    shared = flagged.where("_maybe").join(known.select(F.col("digest").alias("_digest")), "_digest", "left_anti").groupBy("_digest", "_text").agg(F.lit(1)).select("_digest", "_text")
    shipped = tokenizer.ship(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(shipped)
        for b in slices(batches):
            n = np.fromiter((len(ids(t)) for t in b.column(1).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["digest", "n_tokens"])

    new = once.unionByName(shared).mapInArrow(encode, "digest binary, n_tokens bigint")
    new.select(F.lit(tokenizer.version).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(cache)
    # concurrent writers may have stored a digest twice; written out, so that the join below can split a hot digest
    counts = materialize(spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == tokenizer.version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    rows = docs.select(quoted(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("_digest"))
    out = rows.join(counts, F.col("_digest") == F.col("digest"), "inner")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
