"""Mixing documents to target shares of soft domains."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, numbered, quoted, slices, text_of
from .tokenizer import TokenizerFile, encoder

#: Labelled rows that the classifier is fitted on, at most: those of the smallest hashes of their ids.
MAX_DOCUMENTS = 20_000
#: Tokens' worth of evidence that the mean likelihood of a text's tokens counts for, at most: the model's temperature.
EVIDENCE = 64.0
#: Rounds after which rates are written out; in between they are recomputed from the steps since.
WRITE_EVERY = 10


class Domains:
    """Multinomial naive Bayes over token ids: log prior, log likelihood of each token per domain.

    Tokens of a text are not independent, and their summed likelihoods would make every posterior 0 or 1. So the mean over
    all its tokens is taken and counts as ``evidence`` tokens, or as many as there are if fewer; no token is left out.
    """

    def __init__(self, names: list[str], documents: np.ndarray, counts: np.ndarray, evidence: float = EVIDENCE):
        self.names, self.evidence = names, evidence
        self.prior = np.log((documents + 1) / (documents + 1).sum())
        smooth = counts + 0.5
        self.token = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)

    def posterior(self, ids: np.ndarray) -> np.ndarray:
        z = self.prior.copy()
        if len(ids):
            seen = self.token[:, np.minimum(ids, self.token.shape[1] - 1)].astype(float)
            z += seen.mean(axis=1) * min(len(ids), self.evidence)
        z = np.exp(z - z.max())
        return z / z.sum()


def fit_domains(docs: DataFrame, labels: DataFrame, tokenizer: TokenizerFile, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_documents: int = MAX_DOCUMENTS, evidence: float = EVIDENCE) -> Domains:
    """Fit on at most ``max_documents`` labelled documents. The domains are the label's values as text, in order.

    Labels with a null id or value are ignored; of several for one id the largest value counts. Without any label there
    is one domain, ``all``. What reaches the driver is bounded by domains times vocabulary.
    """
    spark = docs.sparkSession
    y = quoted(label_col).cast("string")
    picked = labels.select(quoted(id_col).alias("_lid"), y.alias("_y")).where("_lid is not null and _y is not null")
    picked = picked.groupBy("_lid").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_lid"), "_lid").limit(max_documents)
    sample = docs.select(quoted(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(picked), F.col("_id") == F.col("_lid"))
    shipped = tokenizer.ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, documents = encoder(shipped), {}, Counter()
        for b in slices(batches):
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                documents[label] += 1
                ids = encode(text)
                n = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
                old = seen.get(label, np.zeros(0, np.int64))
                seen[label] = (old if len(old) >= len(n) else np.r_[old, np.zeros(len(n) - len(old), np.int64)]) + np.r_[n, np.zeros(max(0, len(old) - len(n)), np.int64)]
        for label, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * (len(at) + 1), pa.string()), pa.array(np.r_[-1, at]), pa.array(np.r_[documents[label], n[at]])], ["domain", "token", "n"])

    rows = sample.select("_y", "_text").mapInArrow(count, "domain string, token bigint, n bigint").groupBy("domain", "token").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["domain"] for r in rows}) or ["all"]
    size = max((r["token"] for r in rows), default=0) + 1
    counts, documents = np.zeros((len(names), max(1, size))), np.zeros(len(names))
    for r in rows:
        if r["token"] < 0:
            documents[names.index(r["domain"])] = r["n"]
        else:
            counts[names.index(r["domain"]), r["token"]] = r["n"]
    return Domains(names, documents, counts, evidence)


def memberships(docs: DataFrame, domains: Domains, tokenizer: TokenizerFile, text_col: str = "text") -> DataFrame:
    """All columns of docs with _tokens bigint and _p array<double>, the posteriors in the order of ``domains.names``."""
    spark = docs.sparkSession
    shipped, model = tokenizer.ship(spark), spark.sparkContext.broadcast(domains)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("_tokens", T.LongType()), T.StructField("_p", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shipped)
        for b in slices(batches):
            ids = [encode(t or "") for t in b.column(at).to_pylist()]
            p = pa.array([model.value.posterior(x).tolist() for x in ids], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in ids], pa.int64()), p], schema.names)

    return docs.mapInArrow(run, schema)


def _dot(p: Column, v: np.ndarray) -> Column:
    return sum((F.get(p, F.lit(i)) * F.lit(float(x)) for i, x in enumerate(v)), F.lit(0.0))


def fit_rates(members: DataFrame, targets: np.ndarray, rounds: int = 30, tolerance: float = 1e-6, least_rate: float = 0.0) -> DataFrame:
    """Add _rate, at least ``least_rate``, such that the sums of rate times _tokens times _p come as near to ``targets`` as they can.

    Projected gradient on the least squares of the totals, from rates of one. A round sums the totals of all documents;
    only they, one number per domain, reach the driver, which sends the gradient back scaled by the domains' Gram matrix.
    Every document steps along it and is cut off at the least rate. A step that makes the misfit larger is taken back and halved.
    members: materialized.
    """
    k = len(targets)
    p, t = F.col("_p"), F.col("_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = members.agg(*(F.sum(t * F.get(p, F.lit(i)) * F.get(p, F.lit(j))).alias(f"g{i}_{j}") for i, j in pairs)).first()
    gram = np.zeros((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = first[f"g{i}_{j}"] or 0.0
    inverse = np.linalg.pinv(gram + 1e-9 * np.trace(gram) / k * np.eye(k)) if gram.any() else np.zeros((k, k))

    def totals(df: DataFrame, steps: list[np.ndarray]) -> np.ndarray:
        r = rate(steps)
        row = df.agg(*(F.sum(r * t * F.get(p, F.lit(i))).alias(f"s{i}") for i in range(k))).first()
        return np.array([row[i] or 0.0 for i in range(k)])

    def rate(steps: list[np.ndarray]) -> Column:
        r = F.col("_rate")
        for s in steps:
            r = F.greatest(F.lit(float(least_rate)), r - _dot(p, s))
        return r

    now, steps = members.withColumn("_rate", F.lit(1.0)), []
    at, size = totals(now, steps), 1.0
    miss = at - targets
    for _ in range(rounds):
        if not gram.any() or np.abs(miss).max() <= tolerance * max(1.0, np.abs(targets).max()) or size < 1e-3:
            break
        trial = [*steps, size * (inverse @ miss)]
        new = totals(now, trial) - targets
        if np.linalg.norm(new) < np.linalg.norm(miss):
            steps, miss = trial, new
            if len(steps) >= WRITE_EVERY:
                now, steps = materialize(now.withColumn("_rate", rate(steps)), "rates"), []
        else:
            size /= 2
    return now.withColumn("_rate", rate(steps))


def mix(docs: DataFrame, labels: DataFrame, tokenizer: TokenizerFile, shares: dict[str, float] | None = None, total: float | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", least_rate: float = 0.0) -> tuple[DataFrame, Domains]:
    """All columns of docs, which must not be named like them, with _tokens, _p, _rate and _copies; and the domains.

    A classifier fitted on labelled documents gives each document's posteriors over the domains. Document rates are then
    fitted so that the expected tokens of each domain match the targets. shares: the domains' target shares of tokens, in
    any unit; domains not named keep their own share of what the named ones leave (none named: all keep theirs). total:
    the mix's tokens; by default the least at which no domain's target is below what it has; single documents may still
    get a rate below one, unless ``least_rate`` is one: then totals are as near as such rates allow, and no document is lost. A document is taken as often as its rate says, the fraction decided by a hash of its id and text.

    Null texts count as empty and have a prior's posterior, no tokens and the rate that follows. Repeated rows get equal
    rates. Rows with a null id are treated like any other. An empty table gives an empty result.
    """
    domains = fit_domains(docs, labels, tokenizer, label_col, id_col, text_col)
    members = materialize(memberships(docs, domains, tokenizer, text_col), "members")
    k = len(domains.names)
    row = members.agg(*(F.sum(F.col("_tokens") * F.get("_p", F.lit(i))).alias(f"s{i}") for i in range(k))).first()
    have = np.array([row[i] or 0.0 for i in range(k)])
    named = {d: float(v) for d, v in (shares or {}).items() if d in domains.names and v > 0}
    whole = max(1.0, sum(named.values()))
    rest = have[[d not in named for d in domains.names]].sum()
    left = max(0.0, whole - sum(named.values()))
    want = np.array([named.get(d, 0.0 if not rest else (left if named else 1.0) * have[i] / rest) for i, d in enumerate(domains.names)])
    want = want / want.sum() if want.sum() else want
    at = want > 0
    whole_tokens = total if total is not None else float((have[at] / want[at]).max()) if at.any() else 0.0
    rated = fit_rates(members, want * whole_tokens, least_rate=least_rate)
    u = F.shiftrightunsigned(F.xxhash64(quoted(id_col), text_of(text_col), F.lit(20)), 11).cast("double") * F.lit(2.0**-53)
    copies = (F.floor("_rate") + (u < F.col("_rate") - F.floor("_rate")).cast("long")).cast("int")
    return rated.withColumn("_copies", copies), domains


def mixing_rates(docs: DataFrame, labels: DataFrame, tokenizer: TokenizerFile, shares: dict[str, float] | None = None, total: float | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, domains, posteriors (arrays in one order), rate, copies; see :func:`mix`."""
    plain = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    mixed, domains = mix(plain, labels.withColumnRenamed(id_col, "id"), tokenizer, shares, total, label_col, "id", "text")
    names = F.array(*map(F.lit, domains.names))
    return mixed.select(F.col("id").alias(id_col), F.col("_tokens").alias("n_tokens"), names.alias("domains"), F.col("_p").alias("posteriors"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))


def mixed_documents(docs: DataFrame, labels: DataFrame, tokenizer: TokenizerFile, shares: dict[str, float] | None = None, total: float | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", least_rate: float = 0.0) -> DataFrame:
    """The rows of docs, each as many times as :func:`mix` says, with the columns of docs."""
    plain, own, id_now, text_now = numbered(docs, id_col, text_col)
    mixed, _ = mix(plain, labels.withColumnRenamed(id_col, id_now), tokenizer, shares, total, label_col, id_now, text_now, least_rate)
    return mixed.where("_copies > 0").select("*", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))).alias("_copy")).select(*own)
