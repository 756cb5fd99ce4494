from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loomcode.operators import callgraph as cg
from loomcode.operators import extraction, flow, units

UNIT = "unit_id string, name string, type string, file_path string, signature string, docstring string, calls array<string>, called_by array<string>, cfg_summary string, dfg_summary string, dependencies array<string>, indexed_at timestamp"
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def _unit(uid, kind="function", calls=None, deps=None, at=T1, sig=None):
    path, name = uid.split(":")
    return (uid, name.split(".")[-1], kind, path, sig, None, calls, None, "", None, deps, at)


def test_latest_and_text(spark, rows):
    df = spark.createDataFrame([_unit("r/a.py:f", deps=["old"]), _unit("r/a.py:f", deps=["os", " x ", ".rel", "x", None, "", "y"], at=T2, sig=" def  f() "), _unit("r/a.py:f", deps=["old"]), (None, *_unit("r/a.py:g")[1:])], UNIT)
    latest = units.latest_units(df)
    assert latest.count() == 1
    assert rows(units.significant_dependencies(latest)) == [("r/a.py:f", "x,y")]
    assert units.embedding_text(latest).first().text == "Function: f\nSignature: def f()\nDependencies: os,  x , .rel, x, , y"
    assert units.latest_units(df.where("false")).count() == 0


def test_long_calls_are_cut(spark):
    df = spark.createDataFrame([_unit("r/a.py:f", calls=["c" * 150, "d" * 150])], UNIT)
    line = units.embedding_text(df).first().text.split("\n")[1]
    assert line == "Calls: " + ("c" * 150 + ", " + "d" * 150)[:200] + "..."


def test_signatures(spark):
    df = spark.createDataFrame([("python", "", "f", "(a)", "int"), ("go", "T", "f", "(a int)", "int"), ("typescript", "C", "m", "(a)", "void"), ("ruby", "", "x", None, None)], "l string, o string, n string, p string, r string")
    got = [x[0] for x in df.select(units.function_signature(F.col("l"), F.col("o"), F.col("n"), F.col("p"), F.col("r"))).collect()]
    assert got == ["def f(a) -> int", "func (T) f(a int) int", "function C.m(a): void", "def x()"]
    one = spark.createDataFrame([(["B", "C"], [])], "b array<string>, e array<string>")
    assert tuple(one.select(units.class_signature(F.lit("python"), F.lit("A"), F.col("b")), units.class_signature(F.lit("java"), F.lit("A"), F.col("b")), units.class_signature(F.lit("go"), F.lit("A"), F.col("e")), units.interface_signature(F.lit("I"), F.col("b"))).first()) == ("class A(B, C)", "class A extends B", "type A struct", "interface I { B, C }")


def test_resolution(spark, rows):
    df = spark.createDataFrame(
        [_unit("r/a.py:main", calls=["helper", "area", "far", "nowhere", " helper ", None, ""]), _unit("r/a.py:helper"), _unit("r/shapes.py:area"), _unit("r/other.py:area"), _unit("r/z.py:far"), _unit("q/z.py:nowhere")], UNIT
    )
    modules = spark.createDataFrame([("r/a.py", ["from shapes import area", None, "", " import shapes "])], "file string, imports array<string>")
    resolved = cg.resolve_calls(df, modules)
    assert rows(resolved.select("callee", "target", "how")) == [("area", "r/shapes.py:area", "import"), ("far", "r/z.py:far", "repo"), ("helper", "r/a.py:helper", "file"), ("nowhere", None, "unresolved")]
    assert rows(cg.graph_stats(resolved)) == [(4, 3, 1, 2, 1)]
    assert rows(cg.direct_impact(cg.call_edges(resolved)))[0] == ("r/a.py:helper", 1, 1)
    assert cg.resolve_calls(df.where("false"), modules.where("false")).count() == 0


def test_reach_with_cycle(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("c", "d"), (None, "x")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "start string")
    assert rows(cg.reach(edges, seeds, 9)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert rows(cg.reach(edges, seeds, 1)) == [("a", "a", 0), ("a", "b", 1)]
    # What is reached forward is what reaches backward.
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "start string")
    forward = {(r[0], r[1]) for r in cg.reach(edges, nodes, 9).collect()}
    backward = {(r[1], r[0]) for r in cg.reach(cg.reversed_edges(edges), nodes, 9).collect()}
    assert forward == backward


def test_relative_imports(spark, rows):
    df = spark.createDataFrame([("p/q/a.py", ".b"), ("p/q/a.py", "..c"), ("p/q/a.py", "."), ("p/a.py", "....x"), ("p/a.py", "m.n")], "file string, module string")
    assert [r[0] for r in df.select(cg.resolve_import()).collect()] == ["p.q.b", "p.c", "p.q", None, "m.n"]


CODE = """class A:
    def f(self, n):
        total = 0
        # a comment
        for i in range(n):
            if i > 2 and n:
                total += i
                continue
            else:
                total -= 1
        return total


def g(x):
    y = x
    return y
"""


def _tables(spark):
    files = spark.createDataFrame([("r/a.py", CODE), ("r/a.py", CODE), ("r/empty.py", ""), ("r/none.py", None)], "path string, content string")
    functions = spark.createDataFrame([("r/a.py", "A", "f", 2), ("r/a.py", "", "g", 14), ("r/a.py", "", "g", 14)], "path string, owner string, name string, line_number int")
    return files, functions


def test_flow(spark, rows):
    table = flow.function_lines(*_tables(spark))
    assert rows(table.where("func = 'r/a.py:A.f'").select("line_no", "level", "kind")) == [(10, 3, "plain"), (11, 1, "leave"), (2, 0, "entry"), (3, 1, "plain"), (5, 1, "loop"), (6, 2, "branch"), (7, 3, "plain"), (8, 3, "jump"), (9, 2, "else")]
    assert rows(flow.complexity(table).select("func", "complexity", "n_loops", "depth")) == [("r/a.py:A.f", 4, 1, 3), ("r/a.py:g", 1, 0, 1)]
    edges = {(r.src, r.dst, r.edge) for r in flow.flow_edges(table).where("func = 'r/a.py:A.f'").collect()}
    assert edges == {(2, 3, "unconditional"), (3, 5, "unconditional"), (5, 6, "true"), (5, 11, "false"), (6, 7, "true"), (6, 9, "false"), (7, 8, "unconditional"), (8, 5, "back_edge"), (9, 10, "unconditional"), (10, 5, "back_edge"), (11, 0, "return")}


def test_data_flow(spark, rows):
    table = flow.function_lines(*_tables(spark))
    refs = flow.references(table)
    near = {tuple(r) for r in flow.nearest_definitions(refs).where("var = 'total'").select("def_line", "use_line").collect()}
    assert near == {(3, 7), (7, 10), (10, 11)}
    reach = {tuple(r) for r in flow.reaching_definitions(flow.flow_edges(table), refs).where("var = 'total'").select("def_line", "use_line").collect()}
    # Along the loop every definition reaches each use; at the end also the first one.
    assert reach == {(d, u) for d in (3, 7, 10) for u in (7, 10, 11)}
    edges = flow.dependence_edges(table, flow.nearest_definitions(refs))
    last = spark.createDataFrame([("r/a.py:g", 16)], "func string, line_no int")
    assert sorted(r.slice_line for r in flow.slices(edges, last).collect()) == [14, 15, 16]
    first = spark.createDataFrame([("r/a.py:g", 15)], "func string, line_no int")
    assert sorted(r.slice_line for r in flow.slices(edges, first, backward=False).collect()) == [15, 16]
    assert sorted(r.slice_line for r in flow.slices(edges, first, backward=False, var="other").collect()) == [15]


def test_long_functions_are_followed_to_their_ends(spark):
    """A use 70 statements below its definition, and a chain of as many dependences."""
    n = 70
    edges = spark.createDataFrame([("f", k, k + 1, "unconditional") for k in range(1, n)], "func string, src int, dst int, edge string").coalesce(1)
    refs = spark.createDataFrame([("f", "x", 1, True), ("f", "x", n, False)], "func string, var string, line_no int, is_def boolean").coalesce(1)
    assert [tuple(r) for r in flow.reaching_definitions(edges, refs).collect()] == [("f", "x", 1, n)]
    chain = edges.selectExpr("func", "src", "dst", "'data' as dep", "'x' as label")
    last = spark.createDataFrame([("f", n)], "func string, line_no int").coalesce(1)
    assert sorted(r.slice_line for r in flow.slices(chain, last).collect()) == list(range(1, n + 1))


def test_extraction(spark, rows):
    files = spark.createDataFrame([("a.py", "import os\nfrom x.y import z\nclass A(B, C):\n    def f(self):\n        self.g(h(1), 'k(2)')\n"), ("b.ts", 'import { Q } from "./q";\nexport interface I {\n}\n'), ("c.txt", "class No")], "path string, content string")
    source = extraction.source_lines(files)
    assert rows(extraction.declarations(source)) == [("a.py", 3, "class", "A", "B,C"), ("b.ts", 2, "interface", "I", "")]
    assert rows(extraction.imports(source)) == [("a.py", 1, "os", False), ("a.py", 2, "x.y", True), ("b.ts", 1, "./q", True)]
    assert rows(extraction.call_sites(source).where("line_no = 5").select("base", "name", "call_type")) == [("", "h", "local"), ("self", "g", "method")]


def test_long_chains_and_deep_levels(spark, rows):
    """A slice of 200 links is whole, as is nesting below any fixed level; a wrapped parameter list belongs to the head."""
    n = 200
    edges = spark.createDataFrame([("f", k, k + 1, "data", "x") for k in range(1, n)], "func string, src int, dst int, dep string, label string")
    last = spark.createDataFrame([("f", n)], "func string, line_no int")
    assert sorted(r.slice_line for r in flow.slices(edges, last).collect()) == list(range(1, n + 1))
    body = "".join("    " * k + f"if a{k}:\n" for k in range(1, 15)) + "    " * 15 + "x = 1\n"
    files = spark.createDataFrame([("p/a.py", "def f(\n    a,\n):\n" + body)], "path string, content string")
    functions = spark.createDataFrame([("p/a.py", "", "f", 1)], "path string, owner string, name string, line_number int")
    table = flow.function_lines(files, functions)
    assert flow.deepest(table) == 15
    parents = {r.dst: r.src for r in flow.dependence_edges(table, flow.nearest_definitions(flow.references(table))).where("dep = 'control'").collect()}
    assert all(parents[k] == k - 1 for k in range(5, 19))


def test_imports_over_several_lines(spark, rows):
    texts = {
        "r/a.go": 'package p\n\nimport (\n\t"fmt"\n\tio "my/os"\n)\n\nimport x "one/two"\n\nfunc f() {\n\tg("not/one")\n}\n',
        "r/b.ts": 'import {\n  A,\n  B as C,\n} from "./q";\nimport * as ns from "mod/two";\nimport D, { E } from "d";\nconst s = "import";\n',
        "r/c.py": 'def f():\n    """\n    import nothing\n    """\n    import os.path as p, sys\nfrom ..pkg import (\n    one,\n    two as three,\n)\n',
        "r/d.rs": "use a::b::{\n    C,\n    D as E,\n};\nuse f::G;\n", "r/e.java": "import static x.Y.*;\nclass A { class B extends C { } }\n  class Inner implements D { }\n",
    }
    source = extraction.source_lines(spark.createDataFrame(list(texts.items()), "path string, content string"), block_strings=False)
    assert rows(extraction.imports(source).select("path", "line_no", "module")) == [("r/a.go", 4, "fmt"), ("r/a.go", 5, "my/os"), ("r/a.go", 8, "one/two"), ("r/b.ts", 4, "./q"), ("r/b.ts", 5, "mod/two"), ("r/b.ts", 6, "d"), ("r/c.py", 5, "os.path"), ("r/c.py", 6, "..pkg"), ("r/d.rs", 1, "a::b::"), ("r/d.rs", 5, "f::G"), ("r/e.java", 1, "x.Y.*")]
    assert rows(extraction.imported_names(source).select("path", "name", "alias")) == [("r/a.go", "x", "x"), ("r/b.ts", "*", "ns"), ("r/b.ts", "A", "A"), ("r/b.ts", "B", "C"), ("r/b.ts", "E", "E"), ("r/c.py", "one", "one"), ("r/c.py", "os.path", "p"), ("r/c.py", "sys", "sys"), ("r/c.py", "two", "three"), ("r/d.rs", "C", "C"), ("r/d.rs", "D", "E"), ("r/d.rs", "G", "G"), ("r/e.java", "*", "*")]
    assert ("r/e.java", 3, "class", "Inner") in rows(extraction.declarations(source).select("path", "line_no", "kind", "name"))
    assert extraction.imports(source.where("false")).count() == 0


def test_functions(spark, rows):
    texts = {
        "r/a.py": "class A:\n    async def f(self, x=(1, 2)):\n        def inner(a):\n            pass\n\n    def g(\n        self,\n        y: int,\n    ) -> int:\n        return h(1)\n\n\ndef top():\n    return 1\n",
        "r/b.go": "package p\n\nfunc (r *T) F(a int) (int, error) {\n\treturn g(a), nil\n}\n\nfunc G() {\n}\n", "r/c.ts": "export class B {\n  m(a: number): void {\n    if (a) {\n    }\n  }\n}\nexport const k = async (x: number) => x;\n",
        "r/d.rs": "impl<T> Tr for S<T> {\n    pub fn n(&self) -> u8 {\n        1\n    }\n}\n", "r/e.rb": "class C\n  def none\n    puts(1)\n  end\nend\n",
    }
    source = extraction.source_lines(spark.createDataFrame(list(texts.items()), "path string, content string"))
    found = [(r.path[2], r.line_no, r.owner, r.name, r.params, r.is_async) for r in extraction.functions(source).orderBy("path", "line_no").collect()]
    assert found == [
        ("a", 2, "A", "f", "(self, x=(1, 2))", True), ("a", 3, "A", "inner", "(a)", False), ("a", 6, "A", "g", "( self, y: int, )", False), ("a", 13, "", "top", "()", False), ("b", 3, "T", "F", "(a int)", False), ("b", 7, "", "G", "()", False),
        ("c", 2, "B", "m", "(a: number)", False), ("c", 7, "", "k", "(x: number)", True), ("d", 2, "S", "n", "(&self)", False), ("e", 2, "C", "none", "()", False),
    ]


def test_call_kinds(spark, rows):
    sites = spark.createDataFrame([("a.py", 1, "", "own"), ("a.py", 2, "", "one"), ("a.py", 3, "", "len"), ("a.py", 4, "", "far"), ("a.py", 5, "np", "zeros"), ("a.py", 6, "self", "own"), ("a.py", 7, "Shape", "area"), ("a.py", 8, "x.y", "z"), ("b.go", 9, "", "one")], "path string, line_no int, base string, name string")
    functions = spark.createDataFrame([("a.py", "own", 3), ("a.py", "own", 9)], "path string, name string, line_no int")
    names = spark.createDataFrame([("a.py", 1, "uno", "one"), ("a.py", 1, "numpy", "np"), ("a.py", 2, "zz", "one")], "path string, line_no int, name string, alias string")
    assert [(r.line_no, r.kind, r.source) for r in cg.call_kinds(sites, functions, names).orderBy("line_no").collect()] == [
        (1, "local", None), (2, "imported", "uno"), (3, "builtin", None), (4, "external", None), (5, "module", "numpy"), (6, "method", None), (7, "instance", None), (8, "attribute", None), (9, "external", None),
    ]
    assert cg.call_kinds(sites.where("false"), functions, names).count() == 0


def test_reach_without_a_bound(spark):
    n = 70
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(n)] + [(f"n{n}", "n0")], "src string, dst string").coalesce(1)
    seeds = spark.createDataFrame([("n0",)], "start string")
    assert cg.reach(edges, seeds).agg(F.max("depth")).first()[0] == n
