"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcode.llm import broken_files, chunking, function_docs, handwritten, leakage, mixing, residue, terms
from loomcode.session import checkpoint_dir, load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return function_docs.documented_functions(load(spark, d, "code_functions"), load(spark, d, "files")).where("code is not null").select("path", "owner", "name").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return function_docs.pairs(load(spark, d, "code_functions"), load(spark, d, "files"), load(spark, d, "code_units"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_items(chunking.project_items(load(spark, d, "files"), load(spark, d, "documents"), load(spark, d, "chunk_config")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("text is not null").select("item_table", "item_key").distinct()


def p2_shards(spark: SparkSession, d: str) -> DataFrame:
    """The documents as large text files in the shared folder, split by offset: bytes covered, and pieces above the limit."""
    shards = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    load(spark, d, "documents").where("text is not null").select("text").write.text(shards)
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(shards).select("path", "length")
    pieces = chunking.split_files(listing, 256, 32, code=False)
    covered = pieces.groupBy("item_key").agg(F.max("end_byte").alias("n"), F.count_if(F.octet_length("text") > 4 * 256).alias("over"))
    return covered.agg(F.sum("n").alias("n_bytes"), F.sum("over").alias("n_over"))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.project_terms(load(spark, d, "code_units"), load(spark, d, "compact_modules"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_files.broken_paths(load(spark, d, "files"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return broken_files.broken_rates(load(spark, d, "files"), load(spark, d, "compact_modules"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(load(spark, d, "files")).select("path")


def p5_origins(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.origin_counts(load(spark, d, "files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p6_suites(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p7_draws(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(load(spark, d, "documents"), load(spark, d, "mix_targets")).draws


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(load(spark, d, "documents")).select("doc_id")


def p8_messages(spark: SparkSession, d: str) -> DataFrame:
    return residue.recurring_messages(load(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_shards": p2_shards,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p5_found": p5_found,
    "p5_origins": p5_origins,
    "p6_found": p6_found,
    "p6_suites": p6_suites,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p7_draws": p7_draws,
    "p8_found": p8_found,
    "p8_messages": p8_messages,
}

_RUNS = """
WITH iw AS (SELECT item_id, suite, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM iw, unnest(range(1, len(w) - 11)) AS t(k)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM dw, unnest(range(1, len(w) - 11)) AS t(k)),
p AS (SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g))
"""

_TERMS = """
WITH e AS (SELECT 'dependencies' AS field, unit_id AS record, trim(t, ' ') AS term FROM code_units, unnest(dependencies) AS u(t)
           UNION ALL SELECT 'imports', file, trim(t, ' ') FROM compact_modules, unnest(imports) AS u(t)),
n AS (SELECT 'dependencies' AS field, count(DISTINCT unit_id) AS total FROM code_units UNION ALL SELECT 'imports', count(DISTINCT file) FROM compact_modules),
c AS (SELECT field, term, count(*) AS n_occurrences, count(DISTINCT record) AS n_records FROM e WHERE term <> '' GROUP BY 1, 2),
m AS (SELECT field, term, n_occurrences, n_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.12 * total THEN 'common' END AS mark FROM c JOIN n USING (field))
"""

SQL: dict[str, str] = {
    "p2_found": """
WITH i AS (SELECT 'files' AS item_table, path AS item_key, 'code' AS scope, language AS l, strlen(content) AS b FROM files
           UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 'text', lang, strlen(text) FROM documents)
SELECT DISTINCT item_table, item_key FROM i
LEFT JOIN chunk_config c ON c.scope = i.scope AND c.profile = i.l
JOIN chunk_config s ON s.scope = i.scope AND s.profile = '*'
WHERE item_key IS NOT NULL AND b // 4 > coalesce(c.chunk_size, s.chunk_size)""",
    "p4_terms": _TERMS + "SELECT * FROM m",
    "p4_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_shards": "SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS n_over FROM documents WHERE text IS NOT NULL",
    # No source is near its limit, so sizes in bytes give the same answer as sizes in tokens.
    "p7_found": """
WITH s AS (SELECT lower(trim(source)) AS source, sum(strlen(text)) AS size FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
t AS (SELECT m.mix, m.source, m.target_share, m.max_repeats, coalesce(s.size, 0) AS size, sum(coalesce(s.size, 0)) OVER (PARTITION BY m.mix) AS total FROM mix_targets m LEFT JOIN s ON s.source = m.source)
SELECT mix, source FROM t WHERE target_share * total > max_repeats * size""",
    "p6_found": _RUNS + "SELECT item_id, doc_id FROM p",
    "p6_suites": _RUNS
    + """SELECT coalesce(suite, 'unknown') AS suite, count(DISTINCT i.item_id) AS n_items, count(DISTINCT p.item_id) AS n_leaked_items, count(DISTINCT p.doc_id) AS n_documents
         FROM (SELECT DISTINCT item_id, suite FROM eval_items) i LEFT JOIN p USING (item_id) GROUP BY 1""",
}
