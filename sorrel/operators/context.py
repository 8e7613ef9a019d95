"""Retrieving, scoring and packing context chunks under a token budget."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.render import snippet
from ..functions.text import byte_tokens, lines

#: Index chunk types and the context types they become.
CONTEXT_TYPES = {"file_summary": "file_summary", "symbol_definition": "definition", "symbol_reference": "reference", "code_block": "code", "documentation": "documentation"}
QUERY = "query_id string, type string, name string, path string, line int, description string, keywords array<string>, paths array<string>, symbols array<string>, base_symbol string, relation string"
CHUNK = ("query_id", "ord", "file_id", "content", "chunk_type", "symbol", "n_symbols", "signature")


def symbol_query(name: str) -> dict:
    return {"type": "symbol", "name": name}


def position_query(path: str, line: int) -> dict:
    return {"type": "position", "path": path, "line": line}


def file_query(path: str) -> dict:
    return {"type": "file", "path": path}


def concept_query(description: str) -> dict:
    return {"type": "concept", "description": description}


def task_query(keywords: list[str], paths: list[str], symbols: list[str]) -> dict:
    return {"type": "task_driven", "keywords": keywords, "paths": paths, "symbols": symbols}


def related_query(base_symbol: str, relation: str = "callers") -> dict:
    return {"type": "related", "base_symbol": base_symbol, "relation": relation}


def queries(spark: SparkSession, *rows: dict) -> DataFrame:
    """Queries of any kind as one table; a row's query_id is its place unless it has one."""
    names = [c.split()[0] for c in QUERY.split(", ")]
    return spark.createDataFrame([tuple(({"query_id": str(i)} | r).get(c) for c in names) for i, r in enumerate(rows)], QUERY)


def chunk_id(*parts: Column) -> Column:
    """A digest of what the chunk is, so that the same chunk has the same id in every run."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def relevance(chunk_type: Column, n_symbols: Column) -> Column:
    bonus = F.when(chunk_type == "symbol_definition", 0.3).when(chunk_type.isin("file_summary", "documentation"), 0.1).otherwise(0.0)
    return F.round(F.least(F.greatest(F.lit(0.5) + bonus + F.lit(0.1) * F.least(n_symbols, F.lit(3)), F.lit(0.0)), F.lit(1.0)), 6)


def dedup_by_symbol(chunks: DataFrame, group: list[str]) -> DataFrame:
    """Of chunks whose first symbol is equal the first (by ord) stays; chunks without symbols all stay."""
    first = Window.partitionBy(*group, "symbol").orderBy("ord")
    none = chunks.where("symbol is null")
    return chunks.where("symbol is not null").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn").unionByName(none)


def within_budget(chunks: DataFrame, group: list[str], budget: int = 4000) -> DataFrame:
    """The chunks, by relevance then ord, whose running sum of tokens keeps within the budget; the first over it ends."""
    w = Window.partitionBy(*group).orderBy(F.desc("relevance"), "ord").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("running_tokens", F.sum("token_count").over(w)).where(F.col("running_tokens") <= budget)


def refine(chunks: DataFrame, group: list[str], budget: int = 4000) -> DataFrame:
    """Dedup, score and cut: chunks (group, ord, content, chunk_type, symbol, n_symbols) become context chunks.

    symbol_signatures: the symbol's name and, of a definition that has one, its signature.
    """
    scored = dedup_by_symbol(chunks, group).withColumn("relevance", relevance(F.col("chunk_type"), F.col("n_symbols"))).withColumn("token_count", byte_tokens(F.col("content")))
    types = F.create_map(*(F.lit(x) for kv in CONTEXT_TYPES.items() for x in kv))
    named = F.array_compact(F.array("symbol", *(["signature"] if "signature" in chunks.columns else [])))
    return within_budget(scored, group, budget).withColumn("context_type", types[F.col("chunk_type")]).withColumn("symbol_signatures", named)


def chunk_text(path: Column, first: Column, last: Column, signatures: Column, content: Column) -> Column:
    named = F.when(F.size(signatures) > 0, F.concat(F.lit(" ("), F.array_join(signatures, ", "), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("// "), path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), named, F.lit("\n"), content, F.lit("\n"))


def prompt(chunks: DataFrame, group: list[str], header: str = "## Relevant Code Context\n\n", footer: str = "## End Context\n") -> DataFrame:
    """One text for each group of context chunks with a ``block``: header, blocks by relevance and ord, footer.

    A group has as many chunks as its budget lets in.
    """
    parts = F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "ord", "block")))
    return chunks.groupBy(*group).agg(F.concat(F.lit(header), F.array_join(F.transform(parts, lambda x: F.concat(x["block"], F.lit("\n"))), ""), F.lit(footer)).alias("prompt"))


def truncate_to_tokens(content: Column, tokens: Column) -> Column:
    """Cut at four bytes a token, then back to the last line break if there is one."""
    cut = F.make_valid_utf8(F.substr(F.encode(content, "utf-8"), F.lit(1), tokens.cast("int") * 4).cast("string"))
    cut = F.regexp_replace(cut, "�+$", "")
    return F.when(F.octet_length(content) <= tokens * 4, content).otherwise(F.when(cut.contains("\n"), F.regexp_replace(cut, r"\n[^\n]*\z", "")).otherwise(cut))


def file_head(content: Column, n: int = 50) -> Column:
    return F.array_join(F.slice(lines(content), 1, n), "\n")


def window(content: Column, line: Column, around: int = 5) -> Column:
    """Lines from ``line - around`` to ``line + around``, the last left out; 0-based; empty beyond the text."""
    ls = lines(content)
    first = F.greatest(line - around, F.lit(0))
    n = F.least(line + around, F.size(ls)) - first
    return F.array_join(F.when(n > 0, F.slice(ls, first + 1, F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<string>")), "\n")


def retrieve_symbols(queries: DataFrame, definitions: DataFrame, references: DataFrame, files: DataFrame, top_k: int = 10) -> DataFrame:
    """Chunks for queries (query_id, name): definitions as signature and snippet, then references, top_k in all."""
    f = files.select("file_id", "rel_path", "content")
    from .navigation import signature

    sig = signature(F.col("content"), F.col("start_line"))
    d = queries.join(definitions, "name").join(f.drop("rel_path"), "file_id").select("query_id", "name", "file_id", F.lit(0).alias("phase"), F.col("rank").alias("place"), "start_line", F.concat(sig, F.lit("\n"), snippet(F.col("content"), F.col("start_line"), 5)).alias("content"), F.lit("symbol_definition").alias("chunk_type"), sig.alias("signature"))
    r = queries.join(references, "name").join(f, "file_id").select("query_id", "name", "file_id", F.lit(1).alias("phase"), F.col("seq").alias("place"), "start_line", snippet(F.col("content"), F.col("start_line"), 3).alias("content"), F.lit("symbol_reference").alias("chunk_type"), F.lit(None).cast("string").alias("signature"))
    order = Window.partitionBy("query_id").orderBy("phase", "place")
    both = d.unionByName(r).withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= top_k).drop("phase", "place")
    symbol = F.when(F.col("chunk_type") == "symbol_definition", F.col("name"))
    return both.withColumn("symbol", symbol).withColumn("n_symbols", symbol.isNotNull().cast("int"))


def retrieve_positions(queries: DataFrame, files: DataFrame, top_k: int = 10) -> DataFrame:
    """Queries (query_id, path, line): the lines around, and for a file under 100 lines its first 20 as well."""
    q = queries.join(files.select(F.col("rel_path").alias("path"), "file_id", F.col("content").alias("_c")), "path")
    near = q.select("query_id", "file_id", F.lit(1).alias("ord"), window(F.col("_c"), F.col("line")).alias("content"), F.lit("code_block").alias("chunk_type")).where("content <> ''")
    head = q.where((F.size(lines(F.col("_c"))) < 100) & F.lit(top_k > 1)).select("query_id", "file_id", F.lit(2).alias("ord"), file_head(F.col("_c"), 20).alias("content"), F.lit("file_summary").alias("chunk_type"))
    return near.unionByName(head).withColumn("symbol", F.lit(None).cast("string")).withColumn("n_symbols", F.lit(0))


def retrieve_files(queries: DataFrame, files: DataFrame) -> DataFrame:
    """Queries (query_id, path): a file's first 50 lines."""
    q = queries.join(files.select(F.col("rel_path").alias("path"), "file_id", F.col("content").alias("_c")), "path")
    return q.select("query_id", "file_id", F.lit(1).alias("ord"), file_head(F.col("_c")).alias("content"), F.lit("file_summary").alias("chunk_type"), F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("n_symbols"))


def retrieve_tasks(queries: DataFrame, by_symbol: DataFrame, by_file: DataFrame, top_k: int = 10) -> DataFrame:
    """Task queries (query_id, symbols, paths): three chunks of each distinct symbol, then files, top_k in all.

    by_symbol (name, ord, content, chunk_type) and by_file (path, content, chunk_type) are retrieved chunks, whose other
    common columns stay; keywords have no part.
    """
    more = [c for c in by_symbol.columns if c in by_file.columns and c not in ("content", "chunk_type")]
    s = queries.select("query_id", F.posexplode(F.array_distinct("symbols")).alias("place", "name")).join(by_symbol.where("ord <= 3"), "name")
    p = queries.select("query_id", F.posexplode("paths").alias("place", "path")).join(by_file, "path")
    both = s.select("query_id", F.lit(0).alias("phase"), "place", "ord", "content", "chunk_type", F.col("name").alias("symbol"), *more).unionByName(p.select("query_id", F.lit(1).alias("phase"), "place", F.lit(0).alias("ord"), "content", "chunk_type", F.lit(None).cast("string").alias("symbol"), *more))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("phase", "place", "ord"))
    return both.withColumn("_rank", rank).where(F.col("_rank") <= top_k).drop("phase", "place", "ord").withColumnRenamed("_rank", "ord")


def retrieve_related(queries: DataFrame, references: DataFrame, definitions: DataFrame, top_k: int = 10) -> DataFrame:
    """Queries (query_id, base_symbol, relation): callers, the references of a symbol that is defined; others have none."""
    q = queries.where("relation = 'callers'").withColumnRenamed("base_symbol", "name").join(definitions.select("name").distinct(), "name", "left_semi")
    order = Window.partitionBy("query_id").orderBy("seq")
    return q.join(references.where(F.col("seq") <= 2 * top_k), "name").withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= top_k)


KINDS = ("symbol", "position", "file", "task_driven", "related")


def retrieve(queries: DataFrame, definitions: DataFrame, references: DataFrame, files: DataFrame, top_k: int = 10, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Chunks (CHUNK) for queries of every kind at once, ``top_k`` for each: a union of one plan for each of ``kinds``.

    definitions, references: of all names that queries ask for, as navigation finds them. Concepts find nothing, as known
    results have it; see :func:`concept_top_k`.
    """
    no_signature = F.lit(None).cast("string").alias("signature")
    of = lambda k: queries.where(F.col("type") == k)

    def tasks() -> DataFrame:
        asked = of("task_driven")
        names = asked.select(F.explode("symbols").alias("name")).distinct().select(F.col("name").alias("query_id"), "name")
        paths = asked.select(F.explode("paths").alias("path")).distinct().select(F.col("path").alias("query_id"), "path")
        by_symbol = retrieve_symbols(names, definitions, references, files, 3).select(F.col("query_id").alias("name"), "ord", "content", "chunk_type", "signature", "file_id")
        by_file = retrieve_files(paths, files).select(F.col("query_id").alias("path"), "content", "chunk_type", no_signature, "file_id")
        return retrieve_tasks(asked.select("query_id", "symbols", "paths"), by_symbol, by_file, top_k).withColumn("n_symbols", F.col("symbol").isNotNull().cast("int"))

    def related() -> DataFrame:
        uses = retrieve_related(of("related").select("query_id", "base_symbol", "relation"), references, definitions, top_k).join(files.select("file_id", "content"), "file_id")
        return uses.select("query_id", "ord", "file_id", snippet(F.col("content"), F.col("start_line"), 3).alias("content"), F.lit("symbol_reference").alias("chunk_type"), F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("n_symbols"), no_signature)

    make = {
        "symbol": lambda: retrieve_symbols(of("symbol").select("query_id", "name"), definitions, references, files, top_k),
        "position": lambda: retrieve_positions(of("position").select("query_id", "path", "line"), files, top_k).select("*", no_signature),
        "file": lambda: retrieve_files(of("file").select("query_id", "path"), files).select("*", no_signature),
        "task_driven": tasks,
        "related": related,
    }
    parts = [make[k]().select(*CHUNK) for k in KINDS if k in kinds]
    return reduce(DataFrame.unionByName, parts) if parts else retrieve_files(queries.where("false").select("query_id", "path"), files).select("*", no_signature).select(*CHUNK)


def concept_top_k(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors of largest cosine with the query; an addition of this library, concepts otherwise find nothing."""
    v, q = F.col(vector_col), F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))
    return vectors.select(id_col, F.round(cosine, 6).alias("cosine")).orderBy(F.desc("cosine"), id_col).limit(k)


def missing_from(wanted: DataFrame, chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """Wanted (key, name) that no chunk's signatures of that key contain."""
    have = chunks.select(F.col(key).alias("_k"), F.explode("symbol_signatures").alias("_sig"))
    return wanted.join(have, (F.col(key) == F.col("_k")) & F.col("_sig").contains(F.col("name")), "left_anti")


def query_complexity(parts: Column, kind: Column) -> Column:
    """Symbol, position and file queries are Fast, concepts Slow, tasks Medium up to two symbols and paths, then Slow."""
    task = F.when(parts <= 2, "Medium").otherwise("Slow")
    return F.when(kind.isin("symbol", "position", "file"), "Fast").when(kind == "concept", "Slow").when(kind == "task_driven", task).otherwise("Medium")


def evict(entries: DataFrame, cap: int = 1000, now: Column | None = None) -> DataFrame:
    """The better half by accesses over age, if there are as many entries as the cap: entries (key, access, age_s).

    Ranking a cache is one sort of at most ``cap`` kept rows.
    """
    score = F.col("access") / (F.col("age_s") + 1)
    return entries.withColumn("score", score).orderBy(F.desc("score"), "key").limit(cap // 2)


def invalidate(chunks: DataFrame, locations: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.join(locations.select(*keys).distinct(), keys, "left_anti")


class ContextCache:
    """Chunk tables by query and top_k; storage is Spark's. Past ``cap`` entries the better half by accesses over age stays."""

    def __init__(self, cap: int = 1000, clock=time.monotonic) -> None:
        self._frames: dict[tuple, list] = {}  # frame, accesses, time of the last one
        self.cap, self._clock, self.hits, self.misses = cap, clock, 0, 0

    def get(self, query, top_k: int, make) -> DataFrame:
        """query: a hashable key or a query row."""
        key = (tuple(sorted((k, str(v)) for k, v in query.items())) if isinstance(query, dict) else query, top_k)
        if key in self._frames:
            self.hits += 1
        else:
            self.misses += 1
            if len(self._frames) >= self.cap:
                self._evict()
            self._frames[key] = [make().persist(), 0, self._clock()]
        entry = self._frames[key]
        entry[1:] = entry[1] + 1, self._clock()
        return entry[0]

    def _evict(self) -> None:
        now = self._clock()
        ranked = sorted(self._frames.items(), key=lambda kv: kv[1][1] / (now - kv[1][2] + 1))
        for key, (df, _, _) in ranked[: len(ranked) - self.cap // 2]:
            df.unpersist()
            del self._frames[key]

    def _all(self) -> DataFrame | None:
        frames = [df for df, _, _ in self._frames.values()]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def by_symbol(self, name: str) -> DataFrame | None:
        """Distinct cached chunks of a symbol; None while nothing is cached."""
        every = self._all()
        return None if every is None else every.where(F.col("symbol") == name).drop("query_id", "ord").distinct()

    def by_file(self, file_id: str) -> DataFrame | None:
        every = self._all()
        return None if every is None else every.where(F.col("file_id") == file_id).drop("query_id", "ord").distinct()

    def clear(self) -> None:
        for df, _, _ in self._frames.values():
            df.unpersist()
        self._frames.clear()

    def stats(self) -> dict[str, int]:
        return {"entries": len(self._frames), "hits": self.hits, "misses": self.misses}
