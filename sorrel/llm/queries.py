"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .common import table
from .cost_packing import balanced_packing
from .exact_dedup import exact_dedup
from .hamming import nearest_codes
from .impact_index import TERM_PATTERN, ranked_search
from .licenses import COPYRIGHT_LINE, DIGESTS, LIST_MARK, SPELLINGS, TEXTS, find_licenses
from .minhash import near_duplicates
from .mixing import mixing_rates
from .packing import pack_documents
from .pii import find_pii
from .preferences import CLOSE, MIDDLE, OPEN, preference_pairs
from .token_counts import count_tokens
from .tokenizer import TokenizerFile
from .toxicity import score, train


def byte_bpe() -> TokenizerFile:
    import public_tokenizers

    return TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))


def plain(name: str) -> TokenizerFile:
    """A public tokenizer for which the strings of special tokens inside texts are plain text."""
    import public_tokenizers

    return TokenizerFile(public_tokenizers.path(name), specials=False)


#: Target shares of tokens by predicted quality.
QUALITY_SHARES = {"0": 0.1, "1": 0.9}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), byte_bpe(), QUALITY_SHARES)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), byte_bpe(), capacity=2048)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"), "toxic"), threshold=0.7)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), least=0.8, size=5)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op8_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_codes(table(spark, sf_dir, "embeddings"), k=10, every=20)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), byte_bpe(), limit=512)


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as chosen; the same with the last answer of its neighbour (0 and 1, 2 and 3, ...) as rejected."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    last = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("_of"), F.col("last.text").alias("answer"))
    ends = last.join(other, F.col("conv_id") == F.col("_of")).select(F.col("conv_id").alias("_c"), F.col("last.turn").alias("_last"), "answer")
    chosen = c.select((F.col("conv_id") * 2).alias("conv_id"), "turn", "role", "text")
    kept = c.join(ends, F.col("conv_id") == F.col("_c")).where("turn < _last").select((F.col("conv_id") * 2 + 1).alias("conv_id"), "turn", "role", "text")
    swapped = ends.select((F.col("_c") * 2 + 1).alias("conv_id"), F.col("_last").alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    return preference_pairs(chosen.unionByName(kept).unionByName(swapped))


def op11_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_packing(table(spark, sf_dir, "documents"), byte_bpe(), capacity=2048, end_id=1)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), plain("byte_bpe_50k.json"), plain("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_best_fit_packing, op3_licenses, op4_toxicity, op5_exact_dedup, op6_minhash_near_dedup, op7_pii, op8_hamming_top_k, op9_token_counts, op10_preferences,
        op11_cost_packing, op12_ranked_search, op13_tokenizer_alignment,
    )
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"lower(regexp_replace({text}, '\\r\\n?', chr(10), 'g'))"
    for pattern in (COPYRIGHT_LINE, LIST_MARK):
        out = f"regexp_replace({out}, {_quoted(pattern)}, '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for other, usual in SPELLINGS.items():
        out = f"replace({out}, ' {other} ', ' {usual} ')"
    return f"trim({out})"


_DIGESTS = ", ".join(f"({_quoted(k)}, {_quoted(d)})" for k, ds in DIGESTS.items() for d in ds)
_KNOWN = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, (title, body) in TEXTS.items() for v in (body, f"{title}\n{body}"))

ORACLES = {
    "op3_licenses": f"""
        WITH named(license, text) AS (VALUES {_KNOWN}),
        digests(license, digest) AS (SELECT license, sha256({_canonical_sql("text")}) FROM named UNION ALL VALUES {_DIGESTS}),
        known AS (SELECT digest, min(license) AS license FROM digests GROUP BY 1),
        docs AS (SELECT doc_id, sha256({_canonical_sql("coalesce(text, '')")}) AS canonical_sha256 FROM documents)
        SELECT doc_id, license, canonical_sha256 FROM docs LEFT JOIN known ON digest = canonical_sha256""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, max(doc_id) OVER w = doc_id AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_hamming_top_k": """
        WITH bits AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS b FROM embeddings),
        codes AS (SELECT vec_id, array_to_string(b, '')::BIT AS code FROM bits),
        found AS (
            SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, bit_count(xor(q.code, c.code))::BIGINT AS distance
            FROM codes q JOIN codes c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM found)
        SELECT query_id, rank::INT AS rank, neighbor_id, distance FROM ranked WHERE rank <= 10""",
    "op10_preferences": f"""
        WITH answers AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1),
        lasts AS (SELECT conv_id, last, max(text) AS answer FROM conversations JOIN answers USING (conv_id) WHERE role = 'assistant' AND turn = last GROUP BY 1, 2),
        ends AS (SELECT a.conv_id, a.last, b.answer FROM lasts a JOIN lasts b ON b.conv_id = xor(a.conv_id, 1)),
        dealt AS (
            SELECT conv_id * 2 AS conv_id, turn, role, text FROM conversations
            UNION ALL SELECT conv_id * 2 + 1, turn, role, text FROM conversations JOIN ends USING (conv_id) WHERE turn < last
            UNION ALL SELECT conv_id * 2 + 1, last, 'assistant', answer FROM ends),
        turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM dealt WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS seq, conv_id // 2 AS pair_id FROM turns),
        pairs AS (SELECT pair_id, min(conv_id) AS chosen_id, max(conv_id) AS rejected_id FROM numbered GROUP BY 1 HAVING min(conv_id) <> max(conv_id)),
        sides AS (SELECT n.*, CASE WHEN conv_id = chosen_id THEN 'chosen' ELSE 'rejected' END AS side FROM numbered n JOIN pairs USING (pair_id)),
        lone AS (SELECT pair_id, turn, seq FROM sides GROUP BY pair_id, turn, seq, role, text HAVING count(*) = 1),
        ends_at AS (SELECT pair_id, min(turn * 1000000 + seq) AS stop FROM lone GROUP BY 1),
        parts AS (SELECT s.*, CASE WHEN stop IS NULL OR turn * 1000000 + seq < stop THEN 'prompt' ELSE side END AS part FROM sides s LEFT JOIN ends_at USING (pair_id)),
        shown AS (SELECT *, {_quoted(OPEN)} || role || {_quoted(MIDDLE)} || text || {_quoted(CLOSE)} AS rendered FROM parts WHERE part <> 'prompt' OR side = 'chosen'),
        placed AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, seq) AS stop_at FROM shown)
        SELECT pair_id, count(*) FILTER (part = 'prompt') AS prompt_turns,
               {", ".join(f"coalesce(string_agg(rendered, '' ORDER BY turn, seq) FILTER (part = '{p}'), '') AS {p}" for p in ("prompt", "chosen", "rejected"))},
               {", ".join(f"coalesce(string_agg((stop_at - length(rendered)) || ':' || stop_at, ',' ORDER BY turn, seq) FILTER (part = '{p}' AND role = 'assistant'), '') AS {p}_loss" for p in ("chosen", "rejected"))}
        FROM placed GROUP BY 1""",
    "op12_ranked_search": f"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_quoted(TERM_PATTERN)})) AS term
            FROM documents),
        lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
        totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
        norms AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // total AS m FROM lengths, totals),
        held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term, docs),
        impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS impact FROM held JOIN weights USING (term) JOIN norms USING (doc_id)),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_quoted(TERM_PATTERN)})) AS term FROM benchmark),
        scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY 1, 2 HAVING sum(impact) > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
}
