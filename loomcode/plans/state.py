"""Queries of change detection, caches, streams and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcode.functions import paths
from loomcode.operators import cache, callgraph, extraction, flow, incremental, units
from loomcode.session import cut, load
from loomcode.plans.flow_queries import LINES_SQL
from loomcode.streaming import notify


def dirty_diff(spark, d):
    return incremental.detect_changes(load(spark, d, "files"), load(spark, d, "file_state"))


def dirty_counts(spark, d):
    s = incremental.latest_states(load(spark, d, "file_state"))
    return s.groupBy(paths.repo(F.col("path")).alias("repo")).agg(F.count("*").alias("n_paths"), F.count_if("is_dirty").alias("n_dirty"), F.max("last_seen").alias("last_seen"))


def state_merge(spark, d):
    s = load(spark, d, "file_state")
    return incremental.merge_states(s, incremental.detect_changes(load(spark, d, "files"), s))


def state_clear(spark, d):
    s = incremental.latest_states(load(spark, d, "file_state"))
    return incremental.clear_dirty(s, load(spark, d, "code_functions").select("path")).groupBy("is_dirty").agg(F.count("*").alias("n_paths"))


def notify_batches(spark, d):
    return incremental.notification_batches(load(spark, d, "file_state"))


def stream_first_notices(spark, d):
    stream = notify.first_notices(notify.read_notices(spark, f"{d}/file_state.parquet"), "36500 days").select("path", "hash")
    return notify.stream_to_table(spark, stream, "first")


def stream_daily(spark, d):
    return notify.stream_to_table(spark, notify.daily_counts(notify.read_notices(spark, f"{d}/file_state.parquet"), "36500 days"), "daily", "complete")


def cache_probe(spark, d):
    """Documents against the cache of what was fetched before 2024-07: hits and misses by source."""
    docs = load(spark, d, "documents").where("text is not null")
    known = docs.where("fetched_at < timestamp'2024-07-01'").select(cache.content_key(F.col("text")).alias("key"))
    probed = cache.probe(docs.where("fetched_at >= timestamp'2024-07-01'").select(F.lower(F.trim("source")).alias("source"), "text"), known)
    return probed.groupBy("source").agg(F.count("*").alias("n_lookups"), F.count_if("hit").alias("n_hits"), F.round(cache.hit_rate(F.col("hit")), 6).alias("hit_rate"))


def cache_misses(spark, d):
    docs = load(spark, d, "documents").where("text is not null")
    known = docs.where("fetched_at < timestamp'2024-07-01'").select(cache.content_key(F.col("text")).alias("key"))
    return cache.misses(docs.where("fetched_at >= timestamp'2024-07-01'").select("text"), known).select("key", units.estimated_tokens(F.col("text")).alias("tokens"))


def content_groups(spark, d):
    """Contents that several documents share, by hash."""
    docs = load(spark, d, "documents").where("text is not null").withColumn("key", cache.content_key(F.col("text")))
    return docs.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


def asof_last_signup(spark, d):
    """Each purchase with the user's last signup before it: an as-of join as one window."""
    last = "last(case when event_type = 'signup' then event_id end, true) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)"
    return load(spark, d, "events").withColumn("signup", F.expr(last)).where("event_type = 'purchase' and signup is not null").select("event_id", "user_id", "signup")


def source_declarations(spark, d):
    return extraction.declarations(extraction.source_lines(load(spark, d, "files")))


def source_imports(spark, d):
    return extraction.imports(extraction.source_lines(load(spark, d, "files"), block_strings=False))


def source_functions(spark, d):
    """The functions of the function table, with all that is said of them read from the files (broken files hold more)."""
    found = extraction.functions(extraction.source_lines(load(spark, d, "files"), block_strings=False))
    return found.join(load(spark, d, "code_functions").select("path", "name", F.col("line_number").alias("line_no")), ["path", "name", "line_no"], "left_semi")


def source_functions_per_file(spark, d):
    found = extraction.functions(extraction.source_lines(load(spark, d, "files"), block_strings=False))
    return found.groupBy("path").agg(F.count("*").alias("n_functions"), F.count_if(F.col("owner") != "").alias("n_methods"), F.count_if("is_async").alias("n_async"))


def source_import_roots(spark, d):
    """First part of the name of each module that a file imports, of the files whose module row has no null import."""
    m = load(spark, d, "compact_modules").where("file is not null")
    told = m.groupBy(F.col("file").alias("path")).agg(F.max(F.coalesce(F.exists("imports", lambda x: x.isNull()), F.lit(True))).alias("gaps")).where("not gaps")
    module = F.regexp_replace(F.regexp_replace("module", r"^(?:[./]+|(?:super|crate|self)::)+", ""), r"\.h$", "")
    root = F.regexp_replace(F.regexp_extract(module, r"^([^./:\\]+)", 1), r"(?<=[a-z])(?=[A-Z0-9])", "_")
    found = extraction.imports(extraction.source_lines(load(spark, d, "files"), block_strings=False)).select("path", F.translate(F.lower(root), "_", "").alias("root"))
    return found.where("root <> ''").distinct().join(told, "path", "left_semi")


def source_import_names(spark, d):
    return extraction.imported_names(extraction.source_lines(load(spark, d, "files"), block_strings=False)).groupBy("path").agg(F.count("*").alias("n_names"), F.count_if(F.col("name") != F.col("alias")).alias("n_aliases"))


def source_calls(spark, d):
    return extraction.call_sites(extraction.source_lines(load(spark, d, "files"))).groupBy("path", "name", "call_type").agg(F.count("*").alias("n_sites"), F.min("line_no").alias("first_line"))


def source_call_kinds(spark, d):
    """Calls in the source by file and kind, with the imports and functions of the same file."""
    source = cut(extraction.source_lines(load(spark, d, "files"), block_strings=False))
    kinds = callgraph.call_kinds(extraction.call_sites(source), extraction.functions(source), extraction.imported_names(source))
    return kinds.groupBy("path", "kind").agg(F.count("*").alias("n_calls"), F.countDistinct("name").alias("n_names"))


def same_file_calls(spark, d):
    files, functions = load(spark, d, "files"), load(spark, d, "code_functions")
    table = cut(flow.function_lines(files, functions))
    return extraction.same_file_edges(extraction.call_sites(extraction.source_lines(files)), table, functions)


QUERIES = {f.__name__: f for f in (dirty_diff, dirty_counts, state_merge, state_clear, notify_batches, stream_first_notices, stream_daily, cache_probe, cache_misses, content_groups, asof_last_signup, source_declarations, source_imports, source_functions, source_functions_per_file, source_import_roots, source_import_names, source_calls, source_call_kinds, same_file_calls)}

_S = "s AS (SELECT path, coalesce(hash, '') AS hash, coalesce(is_dirty, false) AS is_dirty, coalesce(last_seen, -1) AS last_seen FROM file_state WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY coalesce(last_seen, -1) DESC, coalesce(is_dirty, false) DESC, coalesce(hash, '') DESC) = 1)"
_DIFF = f"""WITH {_S}, n AS (SELECT path, max(sha256(coalesce(content, ''))) AS current FROM files WHERE path IS NOT NULL GROUP BY 1),
d AS (SELECT path, CASE WHEN s.hash IS NULL THEN 'new' WHEN current IS NULL THEN 'removed' WHEN s.hash = current THEN 'unchanged' ELSE 'changed' END AS status FROM n FULL JOIN s USING (path))
"""
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_LANG = f"CASE lower(regexp_extract({_NAME}, '\\.([^.]*)$', 1)) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'c' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' ELSE '' END"
_SRC = f"""WITH o AS (SELECT DISTINCT path, content FROM files WHERE path IS NOT NULL AND content IS NOT NULL),
l AS (SELECT path, {_LANG} AS language, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (SELECT path, regexp_split_to_array(regexp_replace(content, '^\\x{{FEFF}}', ''), '\\r?\\n') AS a FROM o)),
src AS (SELECT * FROM l WHERE language <> '' AND NOT regexp_matches(ltrim(line, ' '), '^(?://|\\*|/\\*)') AND NOT (language IN ('python', 'ruby', 'php') AND ltrim(line, ' ') LIKE '#%'))
"""


def _cases(patterns: dict[str, str]) -> str:
    out = []
    for name, pattern in patterns.items():
        p = pattern.replace("'", "''")
        first = f"regexp_extract(line, '{p}', 1)"
        if pattern.count("([^\"']+)") == 2:
            first = f"coalesce(nullif({first}, ''), regexp_extract(line, '{p}', 2))"
        out.append(f"WHEN '{name}' THEN {first}")
    return "CASE language " + " ".join(out) + " END"


def _any(patterns: dict[str, str]) -> str:
    """The first form that matches, whatever the language."""
    found = [x.split(" THEN ", 1)[1] for x in _cases({str(k): v for k, v in enumerate(dict.fromkeys(patterns.values()))}).removeprefix("CASE language ").removesuffix(" END").split(" WHEN ")]
    return f"coalesce({', '.join(f'nullif({x}, {chr(39) * 2})' for x in found)})"


_BASES = extraction.BASES.replace("'", "''")
SQL = {
    "dirty_diff": _DIFF + "SELECT path, status, status <> 'unchanged' AS is_dirty FROM d",
    "dirty_counts": f"WITH {_S} SELECT split_part(path, '/', 1) AS repo, count(*) AS n_paths, count(*) FILTER (is_dirty) AS n_dirty, max(last_seen) AS last_seen FROM s GROUP BY 1",
    "state_merge": _DIFF + "SELECT path, coalesce(s.hash, '') AS hash, CASE WHEN status IN ('new', 'changed') THEN true WHEN status = 'unchanged' THEN false ELSE coalesce(s.is_dirty, false) END AS is_dirty, coalesce(last_seen, -1) AS last_seen FROM s FULL JOIN d USING (path) WHERE coalesce(status, '') <> 'removed'",
    "state_clear": f"WITH {_S} SELECT is_dirty AND path NOT IN (SELECT path FROM code_functions WHERE path IS NOT NULL) AS is_dirty, count(*) AS n_paths FROM s GROUP BY 1",
    "notify_batches": """WITH f AS (SELECT path, min(coalesce(last_seen, 0)) AS seen FROM file_state WHERE is_dirty AND path IS NOT NULL GROUP BY 1), n AS (SELECT *, (row_number() OVER (ORDER BY seen, path) - 1) // 20 AS batch FROM f)
        SELECT batch, count(*) AS n_paths, min(seen) AS first_seen, max(seen) AS last_seen FROM n GROUP BY 1""",
    "stream_first_notices": "SELECT DISTINCT path, hash FROM file_state WHERE is_dirty AND path IS NOT NULL",
    "stream_daily": "SELECT date_trunc('day', make_timestamp(last_seen * 1000000)) AS start, count(*) AS n_notices, count(*) FILTER (is_dirty) AS n_dirty FROM file_state WHERE last_seen IS NOT NULL GROUP BY 1",
    "cache_probe": """WITH k AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE text IS NOT NULL AND fetched_at < TIMESTAMP '2024-07-01'),
        p AS (SELECT lower(trim(source, ' ')) AS source, sha256(text) IN (SELECT key FROM k) AS hit FROM documents WHERE text IS NOT NULL AND fetched_at >= TIMESTAMP '2024-07-01')
        SELECT source, count(*) AS n_lookups, count(*) FILTER (hit) AS n_hits, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM p GROUP BY 1""",
    "cache_misses": """WITH k AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE text IS NOT NULL AND fetched_at < TIMESTAMP '2024-07-01')
        SELECT DISTINCT sha256(text) AS key, strlen(text) // 4 AS tokens FROM documents WHERE text IS NOT NULL AND fetched_at >= TIMESTAMP '2024-07-01' AND sha256(text) NOT IN (SELECT key FROM k)""",
    "content_groups": "SELECT sha256(text) AS key, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "asof_last_signup": """WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS signup FROM events)
        SELECT event_id, user_id, signup FROM e WHERE event_type = 'purchase' AND signup IS NOT NULL""",
    "source_declarations": _SRC + f""", c AS (SELECT *, {_cases(extraction.CLASSES)} AS cls, {_cases(extraction.INTERFACES)} AS itf FROM src)
        SELECT path, line_no, CASE WHEN coalesce(cls, '') <> '' THEN 'class' ELSE 'interface' END AS kind, CASE WHEN coalesce(cls, '') <> '' THEN cls ELSE itf END AS name,
        regexp_replace(concat(regexp_extract(line, '{_BASES}', 1), regexp_extract(line, '{_BASES}', 2), regexp_extract(line, '{_BASES}', 3)), '\\s+', '', 'g') AS bases FROM c WHERE coalesce(cls, '') <> '' OR coalesce(itf, '') <> ''""",
    "source_imports": _SRC + f", c AS (SELECT *, {_any(extraction.IMPORTS)} AS module FROM src) SELECT path, line_no, module, regexp_matches(line, '{extraction.FROM_IMPORTS}') AS is_from FROM c WHERE module <> ''",
    # No pattern of the extraction stands in these two: the tables hold what another extractor found.
    "source_functions": "SELECT DISTINCT path, line_number AS line_no, coalesce(owner, '') AS owner, name, params, is_async FROM code_functions WHERE path IN (SELECT path FROM files WHERE content IS NOT NULL) AND name IS NOT NULL",
    "source_import_roots": """WITH m AS (SELECT * FROM compact_modules WHERE file IN (SELECT path FROM files WHERE content IS NOT NULL)),
        g AS (SELECT file FROM m GROUP BY file HAVING bool_and(imports IS NOT NULL AND len(list_filter(imports, lambda x: x IS NULL)) = 0))
        SELECT DISTINCT file AS path, replace(regexp_extract(split_part(trim(i, ' '), ' ', 2), '^[.]*([^.]+)', 1), '_', '') AS root FROM m, unnest(imports) AS t(i) WHERE file IN (SELECT file FROM g) AND trim(i, ' ') <> ''""",
    "source_calls": _SRC + f""", b AS (SELECT path, line_no, unnest(list_distinct(regexp_extract_all(regexp_replace(line, '"[^"]*"|''[^'']*''|`[^`]*`', ' ', 'g'), '{extraction.CALL}', 1))) AS call FROM src WHERE regexp_matches(line, '^\\s')),
        c AS (SELECT path, line_no, regexp_extract(call, '([^.]*)$', 1) AS name, regexp_replace(call, '\\.?[^.]*$', '') AS base FROM b)
        SELECT path, name, CASE WHEN base IN ('self', 'this', 'cls') THEN 'method' WHEN base <> '' THEN 'attribute' ELSE 'local' END AS call_type, count(*) AS n_sites, min(line_no) AS first_line
        FROM c WHERE name <> '' AND name NOT IN ({', '.join(repr(x) for x in extraction.NO_CALLS)}) GROUP BY 1, 2, 3""",
    "same_file_calls": _SRC + f""", {LINES_SQL}, b AS (SELECT path, line_no, unnest(list_distinct(regexp_extract_all(regexp_replace(line, '"[^"]*"|''[^'']*''|`[^`]*`', ' ', 'g'), '{extraction.CALL}', 1))) AS call FROM src WHERE regexp_matches(line, '^\\s')),
        c AS (SELECT path, line_no, regexp_extract(call, '([^.]*)$', 1) AS callee FROM b), k AS (SELECT func, callee, c.path FROM c JOIN t ON split_part(t.func, ':', 1) = c.path AND t.line_no = c.line_no WHERE callee <> '' AND callee NOT IN ({', '.join(repr(x) for x in extraction.NO_CALLS)}))
        SELECT func, callee, count(*) AS n_sites FROM k WHERE (path, callee) IN (SELECT (path, name) FROM code_functions) GROUP BY 1, 2""",
}
