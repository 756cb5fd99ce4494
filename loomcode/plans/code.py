"""Queries of code units and the call graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loomcode.functions import paths
from loomcode.operators import callgraph, units
from loomcode.session import cut, load


def _units(spark, d):
    return units.latest_units(load(spark, d, "code_units"))


def units_latest(spark, d):
    return _units(spark, d).select("unit_id", "type", "line_number", "indexed_at", F.array_join("dependencies", ",").alias("deps"))


def unit_embedding_text(spark, d):
    return units.embedding_text(_units(spark, d))


def unit_significant_deps(spark, d):
    return units.significant_dependencies(_units(spark, d))


def unit_summaries(spark, d):
    return units.summaries(_units(spark, d))


def units_by_type(spark, d):
    u = load(spark, d, "code_units")
    return u.groupBy("repo", "type").agg(F.count("*").alias("n_rows"), F.countDistinct("unit_id").alias("n_units"), F.countDistinct("file_path").alias("n_files"), F.count_if(F.coalesce(F.trim("docstring"), F.lit("")) == "").alias("n_undocumented"))


def function_signatures(spark, d):
    f = load(spark, d, "code_functions").select("path", "owner", "name", "params", "return_type").distinct()
    language = paths.detect_language(F.col("path"))
    return f.select("path", "owner", "name", units.function_signature(language, F.col("owner"), F.col("name"), F.col("params"), F.col("return_type")).alias("signature"))


def functions_per_file(spark, d):
    f = load(spark, d, "code_functions").select("path", "owner", "name", "is_method", "is_async", "decorators").distinct()
    return f.groupBy("path").agg(F.count("*").alias("n_functions"), F.count_if("is_method").alias("n_methods"), F.count_if("is_async").alias("n_async"), F.countDistinct("name").alias("n_names"), F.sum(F.coalesce(F.size("decorators"), F.lit(0))).alias("n_decorators"))


def module_names(spark, d):
    f = load(spark, d, "files").select("path").distinct()
    return f.select("path", paths.module_name(F.col("path")).alias("module"))


def compact_projection(spark, d):
    return units.compact_modules(load(spark, d, "compact_modules"), load(spark, d, "code_functions"))


def compact_calls_map(spark, d):
    return callgraph.compact_calls(load(spark, d, "compact_modules"))


def canonical_imports(spark, d):
    i = callgraph.imported_modules(load(spark, d, "compact_modules"))
    return i.select("file", "module", callgraph.resolve_import().alias("canonical"))


def token_estimate(spark, d):
    f = load(spark, d, "files").select("path", "content").distinct()
    return f.groupBy(paths.detect_language(F.col("path")).alias("language")).agg(F.sum(units.estimated_tokens(F.col("content"))).alias("tokens"), F.sum(F.length(units.shortened(F.col("content"), 2048))).alias("kept_chars"))


def symbol_index(spark, d):
    return callgraph.symbols(_units(spark, d)).select("kind", F.replace("key", F.lit("\x01"), F.lit("|")).alias("key"), "unit_id")


def _resolved(spark, d):
    return callgraph.resolve_calls(cut(_units(spark, d).select("unit_id", "type", "name", "file_path", "calls")), load(spark, d, "compact_modules"))


def call_resolution(spark, d):
    return _resolved(spark, d)


def callgraph_stats(spark, d):
    return callgraph.graph_stats(_resolved(spark, d))


def unresolved_calls(spark, d):
    return _resolved(spark, d).where("target is null").groupBy("callee").agg(F.count("*").alias("n_calls"))


def impact_direct(spark, d):
    return callgraph.direct_impact(callgraph.call_edges(_resolved(spark, d)))


def impact_transitive(spark, d):
    """How many units each called unit can break within three steps."""
    edges = cut(callgraph.call_edges(_resolved(spark, d)))
    back = callgraph.reversed_edges(edges)
    found = callgraph.reach(back, back.select(F.col("src").alias("start")).distinct(), 3).where("depth > 0")
    return found.groupBy("start").agg(F.count("*").alias("n_affected"), F.max("depth").alias("farthest"))


#: Names whose impact is asked for, whole or as the end of a longer one.
ASKED = ("run", "_chunk")


def impact_of_names(spark, d):
    """All that calls the units of a name, or of names that end so, through any number of calls."""
    u = _units(spark, d)
    edges = cut(callgraph.call_edges(_resolved(spark, d)))
    name = F.lower("name")
    seeds = u.where(reduce(lambda a, b: a | b, [name.endswith(x) if x.startswith("_") else name == x for x in ASKED])).select(F.col("unit_id").alias("start"))
    found = callgraph.reach(callgraph.reversed_edges(edges), seeds).where("depth > 0")
    return found.groupBy("start").agg(F.count("*").alias("n_affected"), F.max("depth").alias("farthest"))


def call_depth(spark, d):
    """Forward reach of the units that nobody calls."""
    edges = cut(callgraph.call_edges(_resolved(spark, d)))
    roots = edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("start"))
    return callgraph.reach(edges, roots, 4).groupBy("start").agg((F.count("*") - 1).alias("n_reached"), F.max("depth").alias("depth"))


def related_modules(spark, d):
    edges = callgraph.file_edges(_resolved(spark, d), load(spark, d, "compact_modules"), load(spark, d, "files"))
    return edges.groupBy("src", "via").agg(F.count("*").alias("n_files"), F.min("dst").alias("first_file"))


def callers_attached(spark, d):
    """Callee and caller lists side by side for each unit that has either."""
    edges = cut(callgraph.call_edges(_resolved(spark, d)))
    out = edges.groupBy(F.col("src").alias("unit_id")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("callees"))
    back = edges.groupBy(F.col("dst").alias("unit_id")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("callers"))
    return out.join(back, "unit_id", "full").select("unit_id", F.coalesce("callees", F.lit("")).alias("callees"), F.coalesce("callers", F.lit("")).alias("callers"))


QUERIES = {f.__name__: f for f in (units_latest, unit_embedding_text, unit_significant_deps, unit_summaries, units_by_type, function_signatures, functions_per_file, module_names, compact_projection, compact_calls_map, canonical_imports, token_estimate, symbol_index, call_resolution, callgraph_stats, unresolved_calls, impact_direct, impact_transitive, impact_of_names, call_depth, related_modules, callers_attached)}

_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_LANG = f"CASE lower(regexp_extract({_NAME}, '\\.([^.]*)$', 1)) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'c' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' ELSE '' END"
_U = "u AS (SELECT * FROM code_units WHERE unit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY indexed_at DESC NULLS LAST, coalesce(array_to_string(list_transform(dependencies, lambda x: coalesce(x, chr(2))), chr(1)), '') DESC, coalesce(signature, '') DESC) = 1)"
_SPACES = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))"
_CUT = "CASE WHEN length({0}) > 200 THEN {0}[1:200] || '...' ELSE {0} END"
_LIST = "array_to_string(list_filter({}, lambda x: x IS NOT NULL), ', ')"


def _part(label: str, value: str) -> str:
    return f"CASE WHEN coalesce({value}, '') <> '' THEN '{label}: ' || ({value}) END"


_MODS = "mods AS (SELECT DISTINCT file, regexp_extract(trim(i, ' '), '^(?:from|import)\\s+(\\.*[\\w./:-]+)', 1) AS module FROM compact_modules, unnest(imports) AS t(i) WHERE file IS NOT NULL), im AS (SELECT *, regexp_extract(module, '^\\.*([^.]*)', 1) AS first FROM mods WHERE module <> '')"
_STEM = "regexp_replace(regexp_extract({}, '([^/]*)$', 1), '\\.[^.]*$', '')"
_RESOLVED = f"""WITH {_U}, {_MODS},
n AS (SELECT unit_id, name, file_path AS file, split_part(file_path, '/', 1) AS repo, {_STEM.format('file_path')} AS stem FROM u WHERE type IN ('function', 'method') AND name IS NOT NULL AND file_path IS NOT NULL),
kf AS (SELECT file, name, min(unit_id) AS t FROM n GROUP BY 1, 2), km AS (SELECT repo, stem, name, min(unit_id) AS t FROM n GROUP BY 1, 2, 3), kr AS (SELECT repo, name, min(unit_id) AS t FROM n GROUP BY 1, 2),
s AS (SELECT DISTINCT unit_id AS caller, file_path AS file, split_part(file_path, '/', 1) AS repo, trim(c, ' ') AS callee FROM u, unnest(calls) AS t(c) WHERE file_path IS NOT NULL AND trim(c, ' ') <> ''),
bi AS (SELECT caller, callee, min(km.t) AS t FROM s JOIN (SELECT DISTINCT file, first FROM im) i ON i.file = s.file JOIN km ON km.repo = s.repo AND km.stem = i.first AND km.name = s.callee GROUP BY 1, 2),
r AS (SELECT s.caller, s.callee, coalesce(kf.t, bi.t, kr.t) AS target, CASE WHEN kf.t IS NOT NULL THEN 'file' WHEN bi.t IS NOT NULL THEN 'import' WHEN kr.t IS NOT NULL THEN 'repo' ELSE 'unresolved' END AS how
      FROM s LEFT JOIN kf ON kf.file = s.file AND kf.name = s.callee LEFT JOIN bi ON bi.caller = s.caller AND bi.callee = s.callee LEFT JOIN kr ON kr.repo = s.repo AND kr.name = s.callee),
e AS (SELECT DISTINCT caller AS src, target AS dst FROM r WHERE target IS NOT NULL)
"""
_RECURSIVE = _RESOLVED.replace("WITH ", "WITH RECURSIVE ", 1)
SQL = {
    "units_latest": f"WITH {_U} SELECT unit_id, type, line_number, indexed_at, array_to_string(list_filter(dependencies, lambda x: x IS NOT NULL), ',') AS deps FROM u",
    "unit_embedding_text": f"""WITH {_U} SELECT unit_id, concat_ws(chr(10), upper(coalesce(type, 'unit')[1]) || lower(coalesce(type, 'unit')[2:]) || ': ' || coalesce(name, ''), {_part('Signature', _SPACES.format('signature'))}, {_part('Description', "trim(docstring, ' ')")},
        {_part('Calls', _CUT.format(_LIST.format('calls')))}, {_part('Called by', _CUT.format(_LIST.format('called_by')))}, {_part('Dependencies', _LIST.format('dependencies'))}, {_part('Control flow', 'cfg_summary')}, {_part('Data flow', 'dfg_summary')}) AS text FROM u""",
    "unit_significant_deps": f"""WITH {_U}, x AS (SELECT unit_id, unnest(dependencies) AS t, unnest(range(len(dependencies))) AS k FROM u),
        c AS (SELECT unit_id, trim(t, ' ') AS t, min(k) AS k FROM x WHERE trim(t, ' ') <> '' AND t NOT LIKE '.%' AND trim(t, ' ') NOT LIKE '.%' AND trim(t, ' ') NOT IN ({', '.join(repr(x) for x in units.STDLIB)}) GROUP BY 1, 2),
        f AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY k) AS n FROM c), g AS (SELECT unit_id, string_agg(t, ',' ORDER BY k) AS deps FROM f WHERE n <= 5 GROUP BY 1)
        SELECT unit_id, CASE WHEN dependencies IS NOT NULL THEN coalesce(deps, '') END AS deps FROM u LEFT JOIN g USING (unit_id)""",
    "unit_summaries": f"""WITH {_U} SELECT unit_id, try_cast(regexp_extract(cfg_summary, 'complexity: (\\d+)', 1) AS INT) AS complexity, try_cast(regexp_extract(cfg_summary, 'blocks: (\\d+)', 1) AS INT) AS blocks,
        try_cast(regexp_extract(dfg_summary, 'params: (\\d+)', 1) AS INT) AS params, try_cast(regexp_extract(dfg_summary, 'definitions: (\\d+)', 1) AS INT) AS definitions FROM u""",
    "units_by_type": "SELECT repo, type, count(*) AS n_rows, count(DISTINCT unit_id) AS n_units, count(DISTINCT file_path) AS n_files, count(*) FILTER (coalesce(trim(docstring, ' '), '') = '') AS n_undocumented FROM code_units GROUP BY 1, 2",
    "function_signatures": f"""WITH f AS (SELECT DISTINCT path, owner, name, params, return_type, {_LANG} AS l FROM code_functions),
        g AS (SELECT *, CASE WHEN {_SPACES.format('params')} = '' THEN '()' ELSE {_SPACES.format('params')} END AS p, {_SPACES.format('return_type')} AS r, coalesce(owner, '') AS o FROM f)
        SELECT path, owner, name, CASE l WHEN 'go' THEN 'func' WHEN 'javascript' THEN 'function' WHEN 'typescript' THEN 'function' WHEN 'rust' THEN 'fn' WHEN 'php' THEN 'function' ELSE 'def' END || ' ' ||
        CASE WHEN o <> '' AND l = 'go' THEN '(' || o || ') ' ELSE '' END || CASE WHEN o <> '' AND l <> 'go' THEN o || '.' || name ELSE name END || p ||
        CASE WHEN r = '' THEN '' WHEN l IN ('python', 'rust') THEN ' -> ' || r WHEN l IN ('typescript', 'javascript', 'php') THEN ': ' || r ELSE ' ' || r END AS signature FROM g""",
    "functions_per_file": "WITH f AS (SELECT DISTINCT path, owner, name, is_method, is_async, decorators FROM code_functions) SELECT path, count(*) AS n_functions, count(*) FILTER (is_method) AS n_methods, count(*) FILTER (is_async) AS n_async, count(DISTINCT name) AS n_names, sum(coalesce(len(decorators), 0))::BIGINT AS n_decorators FROM f GROUP BY 1",
    "module_names": "SELECT DISTINCT path, replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '.') AS module FROM files",
    "compact_projection": """WITH m AS (SELECT file, max(coalesce(doc, '')[1:200]) AS doc, max(len(list_distinct(list_filter(list_transform(imports, lambda x: trim(x, ' ')), lambda x: x <> ''))))::INT AS n FROM compact_modules WHERE file IS NOT NULL GROUP BY 1),
        f AS (SELECT path, string_agg(name, ',' ORDER BY line_number, name) AS functions FROM (SELECT DISTINCT path, line_number, owner, name FROM code_functions) GROUP BY 1)
        SELECT file, doc, coalesce(n, 0) AS n_imports, coalesce(functions, '') AS functions FROM m LEFT JOIN f ON f.path = m.file""",
    "compact_calls_map": "SELECT DISTINCT file, e.key AS caller, array_to_string(e.value, ',') AS callees FROM compact_modules, unnest(map_entries(calls)) AS t(e) WHERE file IS NOT NULL",
    "canonical_imports": f"""WITH {_MODS}, q AS (SELECT file, module, len(regexp_extract(module, '^(\\.*)', 1)) AS level, string_split(regexp_replace(replace(regexp_replace(file, '\\.[^./]+$', ''), '/', '.'), '\\.?[^.]*$', ''), '.') AS package, regexp_replace(module, '^\\.+', '') AS rest FROM im)
        SELECT file, module, CASE WHEN level = 0 THEN module WHEN len(package) - (level - 1) < 0 THEN NULL ELSE concat_ws('.', nullif(array_to_string(list_slice(package, 1, len(package) - (level - 1)), '.'), ''), nullif(rest, '')) END AS canonical FROM q""",
    "token_estimate": f"WITH f AS (SELECT DISTINCT path, content FROM files) SELECT {_LANG} AS language, sum(coalesce(strlen(content) // 4, 0))::BIGINT AS tokens, sum(CASE WHEN length(content) > 2048 THEN 2051 ELSE length(content) END)::BIGINT AS kept_chars FROM f GROUP BY 1",
    "symbol_index": _RESOLVED + "SELECT 'file' AS kind, file || '|' || name AS key, t AS unit_id FROM kf UNION ALL SELECT 'module', repo || '|' || stem || '|' || name, t FROM km UNION ALL SELECT 'repo', repo || '|' || name, t FROM kr",
    "call_resolution": _RESOLVED + "SELECT * FROM r",
    "callgraph_stats": _RESOLVED + "SELECT count(*) AS n_calls, count(target) AS n_resolved, count(*) FILTER (split_part(caller, ':', 1) = split_part(target, ':', 1)) AS n_intra_file, count(*) FILTER (split_part(caller, ':', 1) <> split_part(target, ':', 1)) AS n_cross_file, count(*) FILTER (target IS NULL) AS n_unresolved FROM r",
    "unresolved_calls": _RESOLVED + "SELECT callee, count(*) AS n_calls FROM r WHERE target IS NULL GROUP BY 1",
    "impact_direct": _RESOLVED + "SELECT dst, count(DISTINCT src) AS n_callers, count(DISTINCT split_part(src, ':', 1)) AS n_files FROM e GROUP BY 1",
    "impact_transitive": _RECURSIVE + """, w(start, node, depth) AS (SELECT DISTINCT dst, dst, 0 FROM e UNION SELECT w.start, e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.node WHERE w.depth < 3),
        b AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2) SELECT start, count(*) AS n_affected, max(depth) AS farthest FROM b WHERE depth > 0 GROUP BY 1""",
    "impact_of_names": _RECURSIVE + """, w(start, node, depth) AS (SELECT unit_id, unit_id, 0 FROM u WHERE lower(name) = 'run' OR lower(name) LIKE '%\\_chunk' ESCAPE '\\' UNION SELECT w.start, e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.node WHERE w.depth < 60),
        b AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2) SELECT start, count(*) AS n_affected, max(depth) AS farthest FROM b WHERE depth > 0 GROUP BY 1""",
    "call_depth": _RECURSIVE + """, w(start, node, depth) AS (SELECT DISTINCT src, src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 4),
        b AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2) SELECT start, count(*) - 1 AS n_reached, max(depth) AS depth FROM b GROUP BY 1""",
    "related_modules": _RESOLVED + f""", fe AS (SELECT DISTINCT split_part(src, ':', 1) AS src, split_part(dst, ':', 1) AS dst, 'call' AS via FROM e WHERE split_part(src, ':', 1) <> split_part(dst, ':', 1)
        UNION ALL SELECT DISTINCT i.file, f.path, 'import' FROM im i JOIN (SELECT DISTINCT path FROM files WHERE path IS NOT NULL) f ON split_part(f.path, '/', 1) = split_part(i.file, '/', 1) AND {_STEM.format('f.path')} = i.first WHERE i.file <> f.path)
        SELECT src, via, count(*) AS n_files, min(dst) AS first_file FROM fe GROUP BY 1, 2""",
    "callers_attached": _RESOLVED + """, o AS (SELECT src AS unit_id, string_agg(dst, ',' ORDER BY dst) AS callees FROM e GROUP BY 1), b AS (SELECT dst AS unit_id, string_agg(src, ',' ORDER BY src) AS callers FROM e GROUP BY 1)
        SELECT unit_id, coalesce(callees, '') AS callees, coalesce(callers, '') AS callers FROM o FULL JOIN b USING (unit_id)""",
}
