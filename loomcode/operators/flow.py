"""Control flow, data flow and dependence inside functions, as tables of lines and edges.

Functions, lines and nesting come from one sort of each file's lines: a line belongs to the nearest definition above it
until the text returns to the definition's indentation, and its level is its indentation in units of that function. Edges
follow from levels by window functions, so a function is never gathered into one value. What travels along edges is followed
in Python, one function at a time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcode.functions.arrow import map_runs

#: Definitions on their way are held in at most so many bits for all lines of a function (64 MB), however long it is.
STATE = 1 << 29
# What a line starts with, and words that are no variables.
BRANCH = r"^(?:\} )?(?:else if|if|elif|elsif|unless|case|when|catch|except|rescue)\b|^(?:\d+|_) => "
LOOP = r"^(?:async )?(?:for|while|until|loop)\b|\.(?:times|each|forEach)\b"
ELSE = r"^(?:\} )?(?:else|elif|elsif|catch|except|rescue|finally|ensure)\b"
LEAVE = r"^(?:return|raise|throw)\b"
JUMP = r"^(?:break|continue|next)\b"
JOINED = r"&&|\|\||\band\b|\bor\b"
DEFINED = r"^(?:(?:let|var|const|mut|int|auto|val)\s+)*\$?([A-Za-z_]\w*)(?:\s*:\s*[\w<>\[\]]+)?\s*(?:(:=|=)(?:[^=]|$)|(\+=|-=|\*=|/=|\+\+|--))"
WORD = r"[A-Za-z_]\w*"
KEYWORDS = (
    "if else elif elsif unless case when switch match default catch except rescue try finally ensure begin end do for while until loop in of range return raise throw break continue next def func function fn let var const mut int auto val and or not is"
    " null nil None true false True False new self this as await async lambda yield print println printf len str sum max min"
).split()
REACHED = "func string, var string, def_line int, use_line int"
# End of the fixed values.


def function_lines(files: DataFrame, functions: DataFrame) -> DataFrame:
    """``func, line_no, first_line, level, kind, text`` of the code lines of each function, its head at level 0.

    Blank lines, comment lines and block strings are left out. Files without a function have no rows; of several functions
    on one line the smallest id stands; nested functions keep their own lines.
    """
    starts = (
        functions.where("path is not null and name is not null and line_number > 0")
        .select("path", F.col("line_number").alias("line_no"), F.concat(F.col("path"), F.lit(":"), F.when(F.coalesce("owner", F.lit("")) != "", F.concat(F.col("owner"), F.lit("."))).otherwise(""), F.col("name")).alias("id"))
        .repartition("path").groupBy("path", "line_no").agg(F.min("id").alias("id"))
        .groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "id"))).alias("starts"))
    )
    # Files move once, by path; all that follows stays in the task of the file, so no line is shuffled.
    with_functions = files.select("path", "content").repartition("path").distinct().join(starts, "path")
    text = with_functions.select("path", F.split("content", "\r?\n").alias("all"), "starts").select("path", "all", F.filter("starts", lambda x: x["line_no"] <= F.size("all")).alias("starts"))
    end = lambda i: F.coalesce(F.get("starts", i + 1)["line_no"], F.size("all") + 1)
    parts = text.select("path", F.explode(F.transform("starts", lambda x, i: F.struct(x["id"].alias("func"), x["line_no"].alias("first_line"), F.slice("all", x["line_no"], end(i) - x["line_no"]).alias("part")))).alias("f")).select("path", "f.*")
    line = lambda c: F.replace(c, F.lit("\t"), F.lit("    "))
    indent = lambda c: F.length(c) - F.length(F.ltrim(c))
    own = parts.select("path", "func", "first_line", indent(line(F.get("part", F.lit(0)))).alias("head_indent"), F.posexplode("part").alias("at", "line"))
    own = own.withColumn("line_no", F.col("first_line") + F.col("at")).withColumn("line", line("line")).withColumn("indent", indent(F.col("line"))).withColumn("text", F.trim("line"))
    inside = Window.partitionBy("path", "first_line").orderBy("line_no")
    marks = F.when(F.col("text").contains('"""') | F.col("text").contains("'''"), F.size(F.split("text", "\"\"\"|'''", -1)) - 1).otherwise(0)
    own = own.withColumn("closed", F.max(F.when((F.col("text") != "") & (F.col("line_no") > F.col("first_line")) & (F.col("indent") <= F.col("head_indent")) & ~F.col("text").rlike(r"^[)\]{]"), 1).otherwise(0)).over(inside))
    own = own.where("closed = 0").withColumn("marks", marks).withColumn("quoted", F.sum("marks").over(inside) - F.col("marks"))
    code = own.where((F.col("text") != "") & (F.col("quoted") % 2 == 0) & (F.col("marks") == 0) & ~F.col("text").rlike(r"^(?://|#|/\*|\*)") & ~F.col("text").rlike(r"^[\])}]+;?,?$|^end$") & ((F.col("line_no") == F.col("first_line")) | (F.col("indent") > F.col("head_indent"))))
    unit = F.min(F.when(F.col("line_no") > F.col("first_line"), F.col("indent") - F.col("head_indent"))).over(Window.partitionBy("path", "first_line"))
    level = F.when(F.col("line_no") == F.col("first_line"), 0).otherwise(F.greatest(F.lit(1), F.floor((F.col("indent") - F.col("head_indent")) / unit))).cast("int")
    kind = F.when(F.col("line_no") == F.col("first_line"), "entry").when(F.col("text").rlike(LOOP), "loop").when(F.col("text").rlike(BRANCH), "branch").when(F.col("text").rlike(ELSE), "else").when(F.col("text").rlike(LEAVE), "leave").when(F.col("text").rlike(JUMP), "jump").otherwise("plain")
    return code.withColumn("level", level).withColumn("kind", kind).select("func", "line_no", "first_line", "level", "kind", "text")


def deepest(table: DataFrame) -> int:
    """The deepest level of any line: so many windows are needed to look for the lines around."""
    return table.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]


def complexity(table: DataFrame) -> DataFrame:
    """``func, complexity, n_lines, depth, n_loops, n_leaves``: 1 and a point for each branch, loop and joined condition."""
    joined = F.when(F.col("kind") != "entry", F.regexp_count("text", F.lit(JOINED))).otherwise(0)
    points = F.when(F.col("kind").isin("branch", "loop"), 1).otherwise(0) + joined
    return table.groupBy("func").agg((F.sum(points) + 1).cast("bigint").alias("complexity"), F.count("*").alias("n_lines"), F.max("level").alias("depth"), F.count_if(F.col("kind") == "loop").alias("n_loops"), F.count_if(F.col("kind") == "leave").alias("n_leaves"))


def basic_blocks(table: DataFrame) -> DataFrame:
    """``func, block_no, start_line, end_line, n_lines``: runs of lines that are entered only at their first and left only at
    their last; a block ends at a branch or a jump, at a change of level, and before a loop or a clause."""
    w = Window.partitionBy("func", "first_line").orderBy("line_no")
    last_kind, last_level = F.lag("kind").over(w), F.lag("level").over(w)
    leads = last_kind.isNull() | (F.col("level") != last_level) | last_kind.isin("branch", "loop", "else", "leave", "jump") | F.col("kind").isin("loop", "else")
    numbered = table.withColumn("leads", leads.cast("int")).withColumn("block_no", F.sum("leads").over(w))
    return numbered.groupBy("func", "block_no").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines"))


def flow_edges(table: DataFrame) -> DataFrame:
    """``func, src, dst, edge``: the control-flow graph on lines; the exit is line 0. The table is read twice, so it should
    be a written one.

    A branch has a true edge into its block and a false edge to its next clause or past it; a loop a true and a false edge;
    the end of a block goes back to the innermost loop that ends with it, else past its clauses.
    """
    return _with_edges(table).select("func", F.col("line_no").alias("src"), F.explode("out").alias("e")).where("e.dst is not null").select("func", "src", F.col("e.dst").alias("dst"), F.col("e.edge").alias("edge")).distinct()


def _with_edges(table: DataFrame, *kept: str) -> DataFrame:
    """``func, line_no, out`` and the columns to keep, partitioned and sorted by function; ``out`` holds the edges from a line."""
    # What lies ahead is what lies behind in falling order: a frame up to the end would be read anew for each line.
    behind, down = (Window.partitionBy("func", "first_line").orderBy(order) for order in ("line_no", F.desc("line_no")))
    behind, ahead = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (behind, down))
    is_else = F.col("kind").isin("else") | (F.col("text").rlike(ELSE) & (F.col("kind") == "branch"))
    marked = table.select("func", "first_line", "line_no", "level", "kind", is_else.alias("clause"), F.col("text").rlike(r"^(?:case|default)\b").alias("case"), F.col("text").startswith("break").alias("breaks"), *kept)
    # Lines move without their text, and once: windows and the last step stay with the function.
    t = marked.repartition("func").withColumn("next", F.lag("line_no").over(down)).withColumn("next_level", F.lag("level").over(down)).withColumn("next_clause", F.lag("clause").over(down))
    spot = F.struct("line_no", "level")
    levels = range(deepest(table) + 1)
    after = [F.last(F.when((F.col("level") <= n) & ~F.col("clause"), spot), True).over(ahead) for n in levels]
    either = [F.last(F.when(F.col("level") <= n, F.col("line_no")), True).over(ahead) for n in levels]
    above = [F.last(F.when(F.col("level") == n, F.struct("line_no", "level", "kind", "case")), True).over(behind) for n in levels]
    t = t.withColumn("clause_at", F.last(F.when(F.col("clause"), F.col("line_no")), True).over(ahead))
    t = t.select("*", F.array(*after).alias("after"), F.array(*either).alias("either")).select("*", F.array(*above).alias("above"))
    loops = F.filter(F.slice("above", 1, F.greatest(F.col("level"), F.lit(0))), lambda x: x["kind"] == "loop")
    t = t.withColumn("loop", F.get(F.reverse(loops), F.lit(0))).withColumn("past", F.get("after", F.greatest(F.col("level") - 1, F.lit(0))))
    exit_line = lambda c: F.coalesce(c, F.lit(0))
    ends_loop = F.col("loop").isNotNull() & (F.col("past").isNull() | (F.col("past.level") <= F.col("loop.level")))
    block_end = F.when(ends_loop, F.struct(F.col("loop.line_no").alias("dst"), F.lit("back_edge").alias("edge"))).otherwise(F.struct(exit_line(F.col("past.line_no")).alias("dst"), F.lit("unconditional").alias("edge")))
    # A break leaves the clause of a switch, else the innermost loop; what continues goes back to the loop.
    switch = F.get("after", F.greatest(F.col("level") - 2, F.lit(0)))
    leaves_switch = F.coalesce(F.get("above", F.col("level") - 1)["case"], F.lit(False)) & F.col("breaks")
    past_loop = F.get("after", F.coalesce(F.col("loop.level"), F.lit(0)))
    jump = (
        F.when(leaves_switch & (switch.isNull() | (switch["level"] == F.col("level") - 2)), F.struct(exit_line(switch["line_no"]).alias("dst"), F.lit("unconditional").alias("edge")))
        .when(F.col("breaks") & F.col("loop").isNotNull() & ~leaves_switch, F.struct(exit_line(past_loop["line_no"]).alias("dst"), F.lit("unconditional").alias("edge")))
        .when(~F.col("breaks") & F.col("loop").isNotNull(), F.struct(F.col("loop.line_no").alias("dst"), F.lit("back_edge").alias("edge")))
        .otherwise(block_end)
    )
    deeper = F.col("next_level") > F.col("level")
    here = F.get("after", F.col("level"))
    # Past a loop or a branch without further clauses may be the end of the block around it.
    around = lambda c: F.when(c.isNotNull() & (F.col("next").isNotNull()), c)
    goes_on = F.col("next").isNotNull() & (F.col("next_level") >= F.col("level")) & ~F.coalesce(F.col("next_clause") & (F.col("next_level") == F.col("level")), F.lit(False))
    step = F.when(goes_on, F.struct(F.col("next").alias("dst"), F.lit("unconditional").alias("edge"))).when(F.col("next").isNotNull() & (F.col("next_level") == F.col("level")), F.struct(exit_line(here["line_no"]).alias("dst"), F.lit("unconditional").alias("edge"))).otherwise(block_end)
    skip = F.when(here.isNotNull() & (here["level"] == F.col("level")), F.struct(here["line_no"].alias("dst"), F.lit("false").alias("edge"))).otherwise(F.struct(block_end["dst"].alias("dst"), F.lit("false").alias("edge")))
    clause_next = F.get("either", F.col("level"))
    false_branch = F.when(clause_next.isNotNull() & (F.col("clause_at") == clause_next), F.struct(clause_next.alias("dst"), F.lit("false").alias("edge"))).otherwise(skip)
    true_edge = F.struct(around(F.when(deeper, F.col("next"))).alias("dst"), F.lit("true").alias("edge"))
    out = (
        F.when(F.col("kind") == "leave", F.array(F.struct(F.lit(0).alias("dst"), F.lit("return").alias("edge"))))
        .when(F.col("kind") == "jump", F.array(jump))
        .when(F.col("kind") == "loop", F.array(true_edge, skip))
        .when(F.col("kind") == "branch", F.array(true_edge, false_branch))
        .otherwise(F.array(step))
    )
    return t.select("func", "line_no", out.alias("out"), *kept)


def references(table: DataFrame) -> DataFrame:
    """``func, var, line_no, is_def``: the variables a line defines or updates, those of the head, and those it uses.

    Strings are no part of a line here. An update also uses what it updates.
    """
    # One row for each line of a function, so every reference is distinct but for functions of one id.
    return _with_references(table).select("func", "line_no", F.explode("found").alias("r")).select("func", "r.var", "line_no", "r.is_def").repartition("func").distinct()


def _with_references(table: DataFrame) -> DataFrame:
    """The table with ``found``, the references of a line."""
    bare = F.regexp_replace("text", r"\"[^\"]*\"|'[^']*'|`[^`]*`", " ")
    t = table.withColumn("bare", bare).withColumn("defined", F.when(F.col("kind") != "entry", F.regexp_extract("bare", DEFINED, 1)).otherwise("")).withColumn("plain_def", F.regexp_extract("bare", DEFINED, 2) != "")
    head = F.col("kind") == "entry"
    words = F.array_distinct(F.filter(F.regexp_extract_all("bare", F.lit(f"({WORD})"), 1), lambda x: ~x.isin(KEYWORDS)))
    # A line that defines a variable uses it too if the name stands there twice.
    again = F.size(F.filter(F.regexp_extract_all("bare", F.lit(r"(\w+)"), 1), lambda x: x == F.col("defined"))) > 1
    t = t.withColumn("again", F.when(F.col("defined") != "", again).otherwise(False))
    as_def, as_use = (lambda x: F.struct(x.alias("var"), F.lit(True).alias("is_def"))), (lambda x: F.struct(x.alias("var"), F.lit(False).alias("is_def")))
    params = F.array_distinct(F.regexp_extract_all(F.regexp_extract("bare", r"\((.*)\)", 1), F.lit(f"({WORD})"), 1))
    uses = F.filter(words, lambda x: (x != F.col("defined")) | ~F.col("plain_def") | F.col("again"))
    none = F.array().cast("array<struct<var:string,is_def:boolean>>")
    found = F.when(head, F.transform(params, as_def)).otherwise(F.concat(F.when(F.col("defined") != "", F.array(as_def(F.col("defined")))).otherwise(none), F.transform(uses, as_use)))
    return t.select(*table.columns, found.alias("found"))


def nearest_definitions(refs: DataFrame) -> DataFrame:
    """``func, var, def_line, use_line``: each use with the last definition of the variable above it (an as-of join as one
    window); uses without one have no row."""
    w = Window.partitionBy("func", "var").orderBy("line_no", F.col("is_def").cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    return refs.withColumn("def_line", F.last(F.when(F.col("is_def"), F.col("line_no")), True).over(w)).where("not is_def and def_line is not null").select("func", "var", "def_line", F.col("line_no").alias("use_line"))


def reaching_definitions(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """``func, var, def_line, use_line``: each use with every definition that reaches it along the control flow.

    A definition travels from its line along the edges until a line that defines the variable again. The edges and
    references of a function meet in one task, which holds one function at a time.
    """
    row = lambda df, line, to, var: df.select("func", F.col(line).cast("int").alias("line_no"), to.cast("int").alias("to"), var.cast("string").alias("var"))
    rows = row(edges.where("dst <> 0"), "src", F.col("dst"), F.lit(None)).unionByName(row(refs, "line_no", F.when(F.col("is_def"), -1).otherwise(-2), F.col("var")))
    return map_runs(rows, "func", _reached, REACHED)


def reaching_definitions_of(table: DataFrame) -> DataFrame:
    """:func:`reaching_definitions` of the edges and references of a table, which move together, with their line. The table
    is read twice, so it should be a written one."""
    t = _with_edges(_with_references(table), "found")
    to = F.transform(F.filter("out", lambda e: e["dst"] != 0), lambda e: F.struct(e["dst"].cast("int").alias("to"), F.lit(None).cast("string").alias("var")))
    refs = F.transform("found", lambda r: F.struct(F.when(r["is_def"], -1).otherwise(-2).alias("to"), r["var"].alias("var")))
    return map_runs(t.select("func", "line_no", F.explode(F.concat(to, refs)).alias("r")).select("func", "line_no", "r.*"), "func", _reached, REACHED, met=True)


def _reached(func: str, lines: list, targets: list, names: list) -> Iterator[tuple]:
    """The definitions of one function that reach its uses; a row is an edge without a name, a definition at -1, a use at -2.

    Sets of definitions are bits of integers, taken in parts of at most STATE bits for all lines together. Lines wait in
    rising order, so that all that comes from above arrives before a line is left.
    """
    follows, defined, used = defaultdict(set), defaultdict(set), defaultdict(set)
    for line, to, name in zip(lines, targets, names, strict=True):
        (follows[line] if name is None else defined[name] if to == -1 else used[name]).add(line if name is not None else to)
    spots = [(name, line) for name in used if name in defined for line in sorted(defined[name])]
    width = max(64, STATE // max(1, len(follows)))
    for start in range(0, len(spots), width):
        part = spots[start : start + width]
        begins, ends, bits = defaultdict(int), defaultdict(int), {}
        for k, (name, line) in enumerate(part):
            begins[line] |= 1 << k
            low, n = bits.get(name, (k, 0))
            bits[name] = low, n + 1
        for name, (low, n) in bits.items():
            for line in defined[name]:
                ends[line] |= ((1 << n) - 1) << low
        arrived, waiting = defaultdict(int), sorted(begins)
        queued = set(waiting)
        while waiting:
            line = heappop(waiting)
            queued.remove(line)
            leaves = arrived[line] & ~ends[line] | begins[line] if line in ends else arrived[line]
            for to in follows.get(line, ()):
                before = arrived[to]
                if leaves & ~before:
                    arrived[to] = before | leaves
                    if to not in queued:
                        queued.add(to)
                        heappush(waiting, to)
        for name, (low, n) in bits.items():
            for use in used[name]:
                rest = arrived.get(use, 0) >> low & ((1 << n) - 1)
                while rest:
                    last = rest.bit_length() - 1
                    rest ^= 1 << last
                    yield func, name, part[low + last][1], use


def dependence_edges(table: DataFrame, data: DataFrame) -> DataFrame:
    """``func, src, dst, dep, label``: control edges from the line that holds a block to each of its lines, data edges from
    definitions to uses; no line depends on itself."""
    control = _with_control(table).where("src is not null").select("func", "src", F.col("line_no").alias("dst"), F.lit("control").alias("dep"), F.lit("").alias("label"))
    flows = data.where("def_line <> use_line").select("func", F.col("def_line").alias("src"), F.col("use_line").alias("dst"), F.lit("data").alias("dep"), F.col("var").alias("label"))
    return control.unionByName(flows)


def _with_control(table: DataFrame, *kept: str) -> DataFrame:
    """``func, line_no, src`` and the columns to keep, partitioned and sorted by function; ``src`` is the line that holds the
    block of a line, null at the head."""
    behind = Window.partitionBy("func", "first_line").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    above = F.array(*[F.last(F.when(F.col("level") == n, F.col("line_no")), True).over(behind) for n in range(deepest(table))])
    holder = F.get(F.reverse(F.filter(F.slice("above", F.lit(1), F.col("level")), lambda x: x.isNotNull())), F.lit(0))
    t = table.select("func", "first_line", "line_no", "level", *kept).repartition("func").withColumn("above", above)
    return t.select("func", "line_no", F.when(F.col("level") > 0, holder).alias("src"), *kept)


def line_dependencies(edges: DataFrame) -> DataFrame:
    """``func, line_no, control_in, control_out, data_in, data_out`` of each line with a dependence."""
    both = edges.select("func", F.col("dst").alias("line_no"), F.concat(F.col("dep"), F.lit("_in")).alias("way")).unionByName(edges.select("func", F.col("src").alias("line_no"), F.concat(F.col("dep"), F.lit("_out")).alias("way")))
    return both.groupBy("func", "line_no").agg(*[F.count_if(F.col("way") == x).alias(x) for x in ("control_in", "control_out", "data_in", "data_out")])


def slices(edges: DataFrame, criteria: DataFrame, backward: bool = True, var: str | None = None) -> DataFrame:
    """``func, line_no, slice_line``: the lines that a criterion ``func, line_no`` depends on, or that depend on it.

    Control edges always count, data edges only with the given variable if there is one. The criterion belongs to its slice.
    Chains are followed to their ends. The edges and criteria of a function meet in one task, which holds one function at a time.
    """
    e = edges if var is None else edges.where((F.col("dep") == "control") | (F.col("label") == var))
    a, b = ("dst", "src") if backward else ("src", "dst")
    row = lambda df, line, far: df.select("func", F.col(line).cast("int").alias("line_no"), far.cast("int").alias("far"))
    return map_runs(row(e, a, F.col(b)).unionByName(row(criteria, "line_no", F.lit(None))), "func", _sliced, "func string, line_no int, slice_line int")


def _sliced(func: str, lines: list, fars: list) -> Iterator[tuple]:
    """The slices of one function's criteria, which are the rows without a far end."""
    follows, criteria = defaultdict(set), set()
    for line, far in zip(lines, fars, strict=True):
        criteria.add(line) if far is None else follows[line].add(far)
    for criterion in criteria:
        for line in _followed(follows, criterion):
            yield func, criterion, line


def _followed(follows: dict[int, set], line: int) -> set:
    found, ahead = {line}, [line]
    while ahead:
        fresh = follows.get(ahead.pop(), set()) - found
        found |= fresh
        ahead += fresh
    return found


def slices_of_last(table: DataFrame) -> DataFrame:
    """The backward :func:`slices` of the last line of each function by control and nearest definitions. Lines move once, with
    their references; the table is read twice, so it should be a written one."""
    t = _with_control(_with_references(table), "found")
    control = F.array(F.struct(F.coalesce(F.col("src").cast("int"), F.lit(0)).alias("to"), F.lit(None).cast("string").alias("var")))
    refs = F.transform("found", lambda r: F.struct(F.when(r["is_def"], -1).otherwise(-2).alias("to"), r["var"].alias("var")))
    return map_runs(t.select("func", "line_no", F.explode(F.concat(control, refs)).alias("r")).select("func", "line_no", "r.*"), "func", _sliced_last, "func string, line_no int, slice_line int", met=True)


def _sliced_last(func: str, lines: list, targets: list, names: list) -> Iterator[tuple]:
    """A row without a name is a line with the line that holds its block, or 0; with one a definition at -1, a use at -2."""
    follows, defined, used = defaultdict(set), defaultdict(set), set()
    last = 0
    for line, to, name in zip(lines, targets, names, strict=True):
        if name is None:
            last = max(last, line)
            if to:
                follows[line].add(to)
        elif to == -1:
            defined[name].add(line)
        else:
            used.add((name, line))
    above = {name: sorted(x) for name, x in defined.items()}
    for name, line in used:
        if k := bisect_left(above.get(name, ()), line):
            follows[line].add(above[name][k - 1])
    for line in _followed(follows, last):
        yield func, last, line
