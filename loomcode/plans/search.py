"""Queries of the scans, the text search and the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcode.functions import paths
from loomcode.operators import text_search, vectors
from loomcode.session import load
from loomcode.sources import files as tree

PATTERN = r"retry polic(?:y|ies)"
RULES = ["vendor/", "*.min.js", "/tools/", "**/generated/**", "!*.go", "node_modules/", "conftest.py", "src/*.rb"]


def _files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "files").select("path").distinct()


def lang_detect(spark, d):
    language = F.when(paths.detect_language(F.col("path")) == "", "unknown").otherwise(paths.detect_language(F.col("path")))
    return _files(spark, d).groupBy(language.alias("language")).agg(F.count("*").alias("n_files"), F.countDistinct(paths.repo(F.col("path"))).alias("n_repos"))


def file_predicates(spark, d):
    p = F.col("path")
    return _files(spark, d).groupBy(paths.extension(p).alias("ext")).agg(
        F.count_if(paths.is_test(p)).alias("n_test"), F.count_if(paths.is_compiled(p)).alias("n_compiled"), F.count_if(paths.in_directory(p, "tests", "vendor")).alias("n_in_dirs"), F.count("*").alias("n_files"),
    )


def ignored_files(spark, d):
    files = _files(spark, d)
    repos = files.select(paths.repo(F.col("path")).alias("dir")).distinct()
    rules = repos.select("dir", F.posexplode(F.array(*[F.lit(r) for r in RULES])).alias("ord", "pattern"))
    return tree.ignored(files, tree.rules_of(rules))


def path_tree(spark, d):
    return tree.tree_nodes(load(spark, d, "files"))


def _doc_lines(spark, d):
    return text_search.lines(load(spark, d, "documents").where("doc_id is not null"), "doc_id", "text")


def text_grep(spark, d):
    return text_search.grep(_doc_lines(spark, d), PATTERN).select("doc_id", "line_no", "col", "matched")


def text_grep_context(spark, d):
    return text_search.grep_context(_doc_lines(spark, d), "doc_id", PATTERN).select("doc_id", "line_no", "context")


def text_grep_by_file(spark, d):
    return text_search.match_counts(text_search.grep(_doc_lines(spark, d), PATTERN), "doc_id")


def text_grep_limit(spark, d):
    return text_search.first_matches(text_search.grep(_doc_lines(spark, d), PATTERN), "doc_id", 100).select("doc_id", "line_no", "col")


def code_grep(spark, d):
    """Search in source files of some extensions, outside excluded directories."""
    f = load(spark, d, "files").where(paths.extension(F.col("path")).isin("py", "go", "rs") & ~paths.in_directory(F.col("path"), "vendor", "node_modules")).select("path", "content").distinct()
    return text_search.grep(text_search.lines(f, "path", "content"), r"\bTODO\b", case_sensitive=True).select("path", "line_no", "col")


def match_ranges(spark, d):
    return text_search.line_ranges(text_search.grep(_doc_lines(spark, d), r"\b(?:cache|index)\b"), "doc_id", "line_no")


def vec_norms(spark, d):
    n = vectors.norm(F.col("embedding"))
    return load(spark, d, "embeddings").select("vec_id", F.round(n, 6).alias("norm"), (F.abs(n - 1) < 1e-3).alias("is_unit"))


def vec_stats(spark, d):
    return vectors.index_stats(load(spark, d, "embeddings"))


def vec_topk_cosine(spark, d):
    e = load(spark, d, "embeddings")
    return vectors.top_k(e, e.where("vec_id % 20 = 0"), 10)


def vec_threshold_after_topk(spark, d):
    return vectors.above(vec_topk_cosine(spark, d), 0.3)


def vec_same_label_rate(spark, d):
    """How many of a query's neighbours share its label: the hits joined with the metadata of both sides."""
    e = load(spark, d, "embeddings").select("vec_id", "label")
    hits = vec_topk_cosine(spark, d).where("query_id <> id")
    both = hits.join(e.withColumnsRenamed({"vec_id": "query_id", "label": "query_label"}), "query_id").join(e.withColumnRenamed("vec_id", "id"), "id")
    return both.groupBy("query_label").agg(F.count("*").alias("n_hits"), F.count_if(F.col("label") == F.col("query_label")).alias("n_same"))


def vec_dot_rank(spark, d):
    """Every vector against its label's first vector, ranked by inner product."""
    e = load(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    scored = e.join(first, "label").select("label", "vec_id", F.round(vectors.dot(F.col("embedding"), F.col("q")), 6).alias("score"))
    rank = F.expr("row_number() over (partition by label order by score desc, vec_id)")
    return scored.withColumn("rank", rank).where("rank <= 5")


def vec_centroids(spark, d):
    return vectors.centroids(load(spark, d, "embeddings"), "label").select("label", "component", F.round("mean", 6).alias("mean"))


def vec_upsert_latest(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label")
    changes = e.where("label = 3").withColumn("label", F.lit(30)).unionByName(e.where("label < 5").select((F.col("vec_id") + 1).alias("vec_id"), F.lit(31).alias("label")))
    return vectors.upsert(e, changes)


def vec_delete(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label")
    return vectors.delete(e, e.where("label in (1, 4)"))


QUERIES = {f.__name__: f for f in (lang_detect, file_predicates, ignored_files, path_tree, text_grep, text_grep_context, text_grep_by_file, text_grep_limit, code_grep, match_ranges, vec_norms, vec_stats, vec_topk_cosine, vec_threshold_after_topk, vec_same_label_rate, vec_dot_rank, vec_centroids, vec_upsert_latest, vec_delete)}

_F = "f AS (SELECT DISTINCT path FROM files)"
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = f"lower(regexp_extract({_NAME}, '\\.([^.]*)$', 1))"
_LINES = "l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS a FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))"
_G = f"WITH {_LINES}, g AS (SELECT *, length(regexp_extract(line, '(?i)^(.*?)retry polic(?:y|ies)', 1)) AS col, regexp_extract(line, '(?i)retry polic(?:y|ies)') AS matched FROM l WHERE regexp_matches(line, '(?i)retry polic(?:y|ies)'))"
_DIRS = "list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1)"
_TOPK = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q),
t AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s QUALIFY rank <= 10)
"""


def _rule(regex: str, negated: bool = False) -> str:
    return f"SELECT regexp_matches(path[length(repo) + 2:], '{regex}') AS hit, {str(negated).lower()} AS negated"


# The rules of the query written by hand as expressions on the path below the repository.
_HAND_RULES = [("vendor/", r"(^|/)vendor/"), ("*.min.js", r"(^|/)[^/]*\.min\.js$"), ("/tools/", r"^tools/"), ("**/generated/**", r"^(.*/)?generated(/.*)?$"), ("!*.go", r"(^|/)[^/]*\.go$"), ("node_modules/", r"(^|/)node_modules/"), ("conftest.py", r"(^|/)conftest\.py$"), ("src/*.rb", r"^src/[^/]*\.rb$")]
SQL = {
    "lang_detect": f"""WITH {_F} SELECT CASE {_EXT} WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'c' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' ELSE 'unknown' END AS language,
        count(*) AS n_files, count(DISTINCT split_part(path, '/', 1)) AS n_repos FROM f GROUP BY 1""",
    "file_predicates": f"""WITH {_F} SELECT {_EXT} AS ext, count(*) FILTER (regexp_matches(lower({_NAME}), '^test_|_test\\.[^.]+$|\\.(test|spec)\\.[^.]+$|^conftest\\.py')) AS n_test, count(*) FILTER ({_EXT} IN ('pyc','pyo','class','o')) AS n_compiled,
        count(*) FILTER (list_has_any({_DIRS}, ['tests','vendor'])) AS n_in_dirs, count(*) AS n_files FROM f GROUP BY 1""",
    "ignored_files": f"WITH {_F}, r AS (SELECT path, split_part(path, '/', 1) AS repo FROM f), m AS ("
    + " UNION ALL ".join(f"SELECT path, {k} AS ord, '{p}' AS rule FROM r WHERE regexp_matches(path[length(repo) + 2:], '{x}')" for k, (p, x) in enumerate(_HAND_RULES))
    + ") SELECT path, rule FROM m QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord DESC) = 1 AND rule NOT LIKE '!%'",
    "path_tree": f"""WITH {_F}, e AS (SELECT path AS p, string_split(path, '/') AS a, unnest(range(1, len(string_split(path, '/')) + 1)) AS d FROM f),
        n AS (SELECT array_to_string(a[1:d], '/') AS path, max(d = len(a)) AS leaf, count(*) AS n_files FROM e GROUP BY 1)
        SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, {_NAME} AS name, CASE WHEN leaf THEN 'file' ELSE 'dir' END AS kind, n_files FROM n""",
    "text_grep": _G + " SELECT doc_id, line_no, col, matched FROM g",
    "text_grep_context": f"""WITH {_LINES}, w AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM l)
        SELECT doc_id, line_no, context FROM w WHERE regexp_matches(line, '(?i)retry polic(?:y|ies)')""",
    "text_grep_by_file": _G + " SELECT doc_id, count(*) AS n_matches, min(line_no) AS first_line FROM g GROUP BY 1",
    "text_grep_limit": _G + " SELECT doc_id, line_no, col FROM g ORDER BY doc_id, line_no LIMIT 100",
    "code_grep": f"""WITH s AS (SELECT DISTINCT path, content FROM files WHERE {_EXT} IN ('py','go','rs') AND NOT list_has_any({_DIRS}, ['vendor','node_modules'])),
        l AS (SELECT path, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (SELECT path, regexp_split_to_array(content, '\\r?\\n') AS a FROM s WHERE content IS NOT NULL))
        SELECT path, line_no, length(regexp_extract(line, '^(.*?)\\bTODO\\b', 1)) AS col FROM l WHERE regexp_matches(line, '\\bTODO\\b')""",
    "match_ranges": f"""WITH {_LINES}, g AS (SELECT DISTINCT doc_id, line_no AS n FROM l WHERE regexp_matches(line, '(?i)\\b(?:cache|index)\\b')),
        i AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM g), r AS (SELECT doc_id, min(n) AS a, max(n) AS b FROM i GROUP BY doc_id, k)
        SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1""",
    "vec_norms": "WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, round(n, 6) AS norm, abs(n - 1) < 1e-3 AS is_unit FROM n",
    "vec_stats": "SELECT count(*) AS n_vectors, max(len(embedding)) AS dimension, count(*) FILTER (abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) < 1e-3) AS n_unit FROM embeddings",
    "vec_topk_cosine": _TOPK + "SELECT * FROM t",
    "vec_threshold_after_topk": _TOPK + "SELECT * FROM t WHERE score >= 0.3",
    "vec_same_label_rate": _TOPK + "SELECT a.label AS query_label, count(*) AS n_hits, count(*) FILTER (a.label = b.label) AS n_same FROM t JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id WHERE query_id <> id GROUP BY 1",
    "vec_dot_rank": """WITH f AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY 1),
        s AS (SELECT e.label, vec_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings e JOIN f ON f.label = e.label)
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""",
    "vec_centroids": "WITH u AS (SELECT label, unnest(range(len(embedding))) AS component, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, component, round(avg(x), 6) AS mean FROM u GROUP BY 1, 2",
    "vec_upsert_latest": """WITH c AS (SELECT vec_id, 30 AS label FROM embeddings WHERE label = 3 UNION ALL SELECT vec_id + 1, 31 FROM embeddings WHERE label < 5), m AS (SELECT vec_id, max(label) AS label FROM c GROUP BY 1)
        SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM m) UNION ALL SELECT * FROM m""",
    "vec_delete": "SELECT vec_id, label FROM embeddings WHERE label NOT IN (1, 4)",
}
