"""Queries of control and data flow inside functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcode.operators import flow, text_search
from loomcode.session import cut, load, store


def _lines(spark, d):
    return flow.function_lines(load(spark, d, "files"), load(spark, d, "code_functions"))


def flow_lines(spark, d):
    return _lines(spark, d).groupBy("func").agg(F.count("*").alias("n_lines"), F.max("level").alias("depth"), F.sum("line_no").alias("line_sum"), F.count_if(F.col("kind") == "plain").alias("n_plain"))


def cfg_complexity(spark, d):
    return flow.complexity(_lines(spark, d))


def cfg_edges(spark, d):
    return flow.flow_edges(cut(_lines(spark, d)))


def cfg_blocks(spark, d):
    return flow.basic_blocks(_lines(spark, d))


def slice_source(spark, d):
    """The lines of every function with a mark for those that its last line depends on."""
    table = store(_lines(spark, d))
    marks = flow.slices_of_last(table).select("func", F.col("slice_line").alias("line_no"), F.lit(None).cast("string").alias("text"))
    # Marks meet their lines by function, not by line: rows of one function lie together and are small when shuffled.
    met = table.select("func", "line_no", "text").unionByName(marks).repartition("func")
    return met.withColumn("in_slice", F.max(F.col("text").isNull()).over(Window.partitionBy("func", "line_no"))).where("text is not null").select("func", "line_no", "in_slice", "text")


def dfg_refs(spark, d):
    return flow.references(_lines(spark, d)).groupBy("func", "var").agg(F.count_if("is_def").alias("n_defs"), F.count_if(~F.col("is_def")).alias("n_uses"), F.min("line_no").alias("first_line"))


def def_use_chains(spark, d):
    return flow.nearest_definitions(flow.references(_lines(spark, d)))


def reaching_defs(spark, d):
    return flow.reaching_definitions_of(store(_lines(spark, d)))


def _dependence(spark, d):
    table = store(_lines(spark, d))
    return table, flow.dependence_edges(table, flow.nearest_definitions(flow.references(table)))


def pdg_edges(spark, d):
    return cut(_dependence(spark, d)[1])


def pdg_line_dependencies(spark, d):
    return flow.line_dependencies(cut(_dependence(spark, d)[1]))


def slice_backward(spark, d):
    """What the last line of every function depends on, as line ranges."""
    return text_search.line_ranges(flow.slices_of_last(store(_lines(spark, d))).repartition("func"), "func", "slice_line")


def slice_forward(spark, d):
    """What depends on the head of every function through data alone, as line ranges."""
    table, edges = _dependence(spark, d)
    first = table.groupBy("func").agg(F.min("line_no").alias("line_no"))
    return text_search.line_ranges(flow.slices(edges.where("dep = 'data'"), first, backward=False), "func", "slice_line")


QUERIES = {f.__name__: f for f in (flow_lines, cfg_complexity, cfg_blocks, cfg_edges, dfg_refs, def_use_chains, reaching_defs, pdg_edges, pdg_line_dependencies, slice_backward, slice_forward, slice_source)}


#: The SQL looks so many levels deep, which is deeper than any line of the given tables.
LEVELS = 24


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


_BARE = """regexp_replace(text, '"[^"]*"|''[^'']*''|`[^`]*`', ' ', 'g')"""
_T = f"""
st AS (SELECT path, line_number AS line_no, min(path || ':' || CASE WHEN coalesce(owner, '') <> '' THEN owner || '.' ELSE '' END || name) AS id FROM code_functions WHERE path IS NOT NULL AND name IS NOT NULL AND line_number IS NOT NULL GROUP BY 1, 2),
fl AS (SELECT path, unnest(range(1, len(a) + 1)) AS line_no, replace(unnest(a), chr(9), '    ') AS line FROM (SELECT path, regexp_split_to_array(content, '\\r?\\n') AS a FROM (SELECT DISTINCT path, content FROM files WHERE content IS NOT NULL AND path IN (SELECT path FROM st)))),
q1 AS (SELECT fl.*, st.id, length(regexp_extract(line, '^( *)', 1)) AS indent, trim(line, ' ') AS text FROM fl LEFT JOIN st USING (path, line_no)),
q2 AS (SELECT *, last_value(CASE WHEN id IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS first_line, last_value(id IGNORE NULLS) OVER w AS func, last_value(CASE WHEN id IS NOT NULL THEN indent END IGNORE NULLS) OVER w AS head_indent FROM q1 WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
q3 AS (SELECT *, max((text <> '' AND line_no > first_line AND indent <= head_indent AND NOT regexp_matches(text, '^[)\\]{{]'))::INT) OVER (PARTITION BY path, first_line ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS closed, len(regexp_extract_all(text, '\"\"\"|''''''')) AS marks FROM q2 WHERE func IS NOT NULL),
q4 AS (SELECT *, sum(marks) OVER (PARTITION BY path, first_line ORDER BY line_no ROWS UNBOUNDED PRECEDING) - marks AS quoted FROM q3 WHERE closed = 0),
q5 AS (SELECT *, min(CASE WHEN line_no > first_line THEN indent - head_indent END) OVER (PARTITION BY path, first_line) AS unit FROM q4 WHERE text <> '' AND quoted % 2 = 0 AND marks = 0 AND NOT regexp_matches(text, '^(?://|#|/\\*|\\*)') AND NOT regexp_matches(text, '^[\\])}}]+;?,?$|^end$') AND (line_no = first_line OR indent > head_indent)),
t AS (SELECT func, line_no, first_line, text, CASE WHEN line_no = first_line THEN 0 ELSE greatest(1, (indent - head_indent) // unit) END AS level,
      CASE WHEN line_no = first_line THEN 'entry' WHEN regexp_matches(text, '{_re2(flow.LOOP)}') THEN 'loop' WHEN regexp_matches(text, '{_re2(flow.BRANCH)}') THEN 'branch' WHEN regexp_matches(text, '{_re2(flow.ELSE)}') THEN 'else' WHEN regexp_matches(text, '{_re2(flow.LEAVE)}') THEN 'leave' WHEN regexp_matches(text, '{_re2(flow.JUMP)}') THEN 'jump' ELSE 'plain' END AS kind FROM q5)
"""
LINES_SQL = _T
_REFS = f""",
b AS (SELECT *, {_BARE} AS bare FROM t), b2 AS (SELECT *, CASE WHEN kind <> 'entry' THEN regexp_extract(bare, '{_re2(flow.DEFINED)}', 1) ELSE '' END AS defined, regexp_extract(bare, '{_re2(flow.DEFINED)}', 2) <> '' AS plain_def FROM b),
uw AS (SELECT DISTINCT func, line_no, defined, plain_def, bare, unnest(regexp_extract_all(bare, '{flow.WORD}')) AS var FROM b2 WHERE kind <> 'entry'),
uu AS (SELECT func, var, line_no FROM uw WHERE var NOT IN ({', '.join(repr(k) for k in flow.KEYWORDS)}) AND (var <> defined OR NOT plain_def OR len(list_filter(regexp_extract_all(bare, '\\w+'), lambda x: x = var)) > 1)),
refs AS (SELECT DISTINCT func, unnest(regexp_extract_all(regexp_extract(bare, '\\((.*)\\)', 1), '{flow.WORD}')) AS var, line_no, true AS is_def FROM b2 WHERE kind = 'entry'
         UNION SELECT func, defined, line_no, true FROM b2 WHERE defined <> '' UNION SELECT func, var, line_no, false FROM uu),
du AS (SELECT func, var, def_line, line_no AS use_line FROM (SELECT *, last_value(CASE WHEN is_def THEN line_no END IGNORE NULLS) OVER (PARTITION BY func, var ORDER BY line_no, is_def::INT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_line FROM refs) WHERE NOT is_def AND def_line IS NOT NULL)
"""
_PDG = _REFS + f""",
ab AS (SELECT *, [{', '.join(f"last_value(CASE WHEN level = {n} THEN line_no END IGNORE NULLS) OVER w" for n in range(LEVELS))}] AS above FROM t WINDOW w AS (PARTITION BY func, first_line ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ce AS (SELECT func, list_filter(above[1:level], lambda x: x IS NOT NULL)[-1] AS src, line_no AS dst FROM ab WHERE level > 0),
pe AS (SELECT func, src, dst, 'control' AS dep, '' AS label FROM ce WHERE src IS NOT NULL UNION ALL SELECT func, def_line, use_line, 'data', var FROM du WHERE def_line <> use_line)
"""
_N = range(LEVELS + 1)
_CFG = f""",
x1 AS (SELECT *, (kind = 'else' OR kind = 'branch' AND regexp_matches(text, '{_re2(flow.ELSE)}')) AS clause FROM t),
x2 AS (SELECT *, lead(line_no) OVER o AS nxt, lead(level) OVER o AS nl, lead(clause) OVER o AS nc, first_value(CASE WHEN clause THEN line_no END IGNORE NULLS) OVER a AS clause_at,
  [{', '.join(f"first_value(CASE WHEN level <= {n} AND NOT clause THEN {{'l': line_no, 'v': level}} END IGNORE NULLS) OVER a" for n in _N)}] AS aft,
  [{', '.join(f"first_value(CASE WHEN level <= {n} THEN line_no END IGNORE NULLS) OVER a" for n in _N)}] AS eit,
  [{', '.join(f"last_value(CASE WHEN level = {n} THEN {{'l': line_no, 'v': level, 'k': kind, 'c': regexp_matches(text, '^(?:case|default)' || chr(92) || 'b')}} END IGNORE NULLS) OVER b" for n in _N)}] AS abv
  FROM x1 WINDOW o AS (PARTITION BY func, first_line ORDER BY line_no), a AS (PARTITION BY func, first_line ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), b AS (PARTITION BY func, first_line ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x3 AS (SELECT *, list_filter(abv[1:level], lambda x: x.k = 'loop')[-1] AS lp, aft[greatest(level - 1, 0) + 1] AS past, aft[level + 1] AS here, aft[greatest(level - 2, 0) + 1] AS sw, eit[level + 1] AS cn, coalesce(abv[level].c, false) AND text LIKE 'break%' AS ls FROM x2),
x4 AS (SELECT *, lp IS NOT NULL AND (past IS NULL OR past.v <= lp.v) AS ends_loop FROM x3),
x5 AS (SELECT *, CASE WHEN ends_loop THEN {{'dst': lp.l, 'edge': 'back_edge'}} ELSE {{'dst': coalesce(past.l, 0), 'edge': 'unconditional'}} END AS be FROM x4),
x6 AS (SELECT *, CASE WHEN here IS NOT NULL AND here.v = level THEN here.l ELSE be.dst END AS skip FROM x5),
x7 AS (SELECT func, line_no AS src, unnest(CASE
  WHEN kind = 'leave' THEN [{{'dst': 0, 'edge': 'return'}}]
  WHEN kind = 'jump' THEN [CASE WHEN ls AND (sw IS NULL OR sw.v = level - 2) THEN {{'dst': coalesce(sw.l, 0), 'edge': 'unconditional'}} WHEN text LIKE 'break%' AND lp IS NOT NULL AND NOT ls THEN {{'dst': coalesce(aft[lp.v + 1].l, 0), 'edge': 'unconditional'}}
       WHEN text NOT LIKE 'break%' AND lp IS NOT NULL THEN {{'dst': lp.l, 'edge': 'back_edge'}} ELSE be END]
  WHEN kind = 'loop' THEN [{{'dst': CASE WHEN nl > level THEN nxt END, 'edge': 'true'}}, {{'dst': skip, 'edge': 'false'}}]
  WHEN kind = 'branch' THEN [{{'dst': CASE WHEN nl > level THEN nxt END, 'edge': 'true'}}, {{'dst': CASE WHEN cn IS NOT NULL AND clause_at = cn THEN cn ELSE skip END, 'edge': 'false'}}]
  ELSE [CASE WHEN nxt IS NOT NULL AND nl >= level AND NOT coalesce(nc AND nl = level, false) THEN {{'dst': nxt, 'edge': 'unconditional'}} WHEN nxt IS NOT NULL AND nl = level THEN {{'dst': coalesce(here.l, 0), 'edge': 'unconditional'}} ELSE be END]
  END) AS e FROM x6),
fe AS (SELECT DISTINCT func, src, e.dst AS dst, e.edge AS edge FROM x7 WHERE e.dst IS NOT NULL)
"""
_RANGES = """, i AS (SELECT func, n, n - row_number() OVER (PARTITION BY func ORDER BY n) AS k FROM g), r AS (SELECT func, min(n) AS a, max(n) AS b FROM i GROUP BY func, k)
SELECT func, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1"""
SQL = {
    "flow_lines": f"WITH {_T} SELECT func, count(*) AS n_lines, max(level) AS depth, sum(line_no)::BIGINT AS line_sum, count(*) FILTER (kind = 'plain') AS n_plain FROM t GROUP BY 1",
    "cfg_complexity": f"""WITH {_T} SELECT func, (1 + sum((kind IN ('branch', 'loop'))::INT + CASE WHEN kind <> 'entry' THEN len(regexp_extract_all(text, '{_re2(flow.JOINED)}')) ELSE 0 END))::BIGINT AS complexity,
        count(*) AS n_lines, max(level) AS depth, count(*) FILTER (kind = 'loop') AS n_loops, count(*) FILTER (kind = 'leave') AS n_leaves FROM t GROUP BY 1""",
    "cfg_blocks": f"""WITH {_T}, g AS (SELECT *, lag(kind) OVER w AS lk, lag(level) OVER w AS ll FROM t WINDOW w AS (PARTITION BY func, first_line ORDER BY line_no)),
        n AS (SELECT *, sum((lk IS NULL OR level <> ll OR lk IN ('branch', 'loop', 'else', 'leave', 'jump') OR kind IN ('loop', 'else'))::INT) OVER (PARTITION BY func, first_line ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS block_no FROM g)
        SELECT func, block_no, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines FROM n GROUP BY 1, 2""",
    "slice_source": f"WITH RECURSIVE {_T} {_PDG}, s(func, n) AS (SELECT func, max(line_no) FROM t GROUP BY 1 UNION SELECT s.func, pe.src FROM s JOIN pe ON pe.func = s.func AND pe.dst = s.n) SELECT func, line_no, (func, line_no) IN (SELECT (func, n) FROM s) AS in_slice, text FROM t",
    "cfg_edges": f"WITH {_T} {_CFG} SELECT * FROM fe",
    "reaching_defs": f"""WITH RECURSIVE {_T} {_CFG} {_REFS}, dd AS (SELECT DISTINCT func, var, line_no FROM refs WHERE is_def), g AS (SELECT DISTINCT func, src, dst FROM fe WHERE dst <> 0),
        r(func, var, def_line, here) AS (SELECT dd.func, dd.var, dd.line_no, g.dst FROM dd JOIN g ON g.func = dd.func AND g.src = dd.line_no
          UNION SELECT r.func, r.var, r.def_line, g.dst FROM r LEFT JOIN dd ON dd.func = r.func AND dd.var = r.var AND dd.line_no = r.here JOIN g ON g.func = r.func AND g.src = r.here WHERE dd.func IS NULL)
        SELECT r.func, r.var, r.def_line, u.line_no AS use_line FROM r JOIN (SELECT DISTINCT func, var, line_no FROM refs WHERE NOT is_def) u ON u.func = r.func AND u.var = r.var AND u.line_no = r.here""",
    "dfg_refs": f"WITH {_T} {_REFS} SELECT func, var, count(*) FILTER (is_def) AS n_defs, count(*) FILTER (NOT is_def) AS n_uses, min(line_no) AS first_line FROM refs GROUP BY 1, 2",
    "def_use_chains": f"WITH {_T} {_REFS} SELECT * FROM du",
    "pdg_edges": f"WITH {_T} {_PDG} SELECT * FROM pe",
    "pdg_line_dependencies": f"""WITH {_T} {_PDG}, o AS (SELECT func, dst AS line_no, dep || '_in' AS way FROM pe UNION ALL SELECT func, src, dep || '_out' FROM pe)
        SELECT func, line_no, count(*) FILTER (way = 'control_in') AS control_in, count(*) FILTER (way = 'control_out') AS control_out, count(*) FILTER (way = 'data_in') AS data_in, count(*) FILTER (way = 'data_out') AS data_out FROM o GROUP BY 1, 2""",
    "slice_backward": f"WITH RECURSIVE {_T} {_PDG}, s(func, n) AS (SELECT func, max(line_no) FROM t GROUP BY 1 UNION SELECT s.func, pe.src FROM s JOIN pe ON pe.func = s.func AND pe.dst = s.n), g AS (SELECT DISTINCT func, n FROM s)" + _RANGES,
    "slice_forward": f"WITH RECURSIVE {_T} {_PDG}, s(func, n) AS (SELECT func, min(line_no) FROM t GROUP BY 1 UNION SELECT s.func, pe.dst FROM s JOIN pe ON pe.func = s.func AND pe.src = s.n AND pe.dep = 'data'), g AS (SELECT DISTINCT func, n FROM s)" + _RANGES,
}
