"""Training-data operators on texts: small cases, brute force, nulls, ties, clashing columns."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomcode.llm import broken_files, function_docs, handwritten, leakage, mixing, provenance, residue, syntax

VALID = [
    ("a.py", "\ufeffx = 1\r\n"), ("a.py", ""), ("a.py", "\ufeff"), ("a.py", 's = """\n<<<<<<< HEAD\n"""\n'), ("a.go", "package p\n\nfunc f(a int) (x int, err error) {\n\tx = a\n\treturn x, nil\n}\n"), ("a.go", "// only a comment\n"),
    ("a.js", "const t = `\n<<<<<<< a\n=======\n`;\nlet r = /[/\"]+/g;\nif (a) { b() } else c({x: 1});\n"), ("a.ts", "export function f(x: number, y?: string[]): Promise<number> { return g<T>(x as any); }\n"),
    ("a.tsx", "export const A = () => <div className=\"x\">it's fine here</div>;\n"), ("a.java", "package a.b;\nimport static x.Y.*;\n@Deprecated\npublic class A<T extends B> implements C {\n  int[] x = {1, 2};\n}\n"),
    ("a.rs", "use a::b;\n#[derive(Debug)]\nstruct S<'a> { x: &'a str }\nimpl<'a> S<'a> { fn f(&self) -> char { 'x' } }\nfn main() { println!(\"{}\", 1); }\n"), ("a.c", "#include <a.h>\n#define X 1\nstatic const char *s = \"a\" \"b\";\nint main(void) { return X; }\n"),
    ("a.rb", "class A\n  def f(x) = x + 1\n  def g\n    return 1 if x\n    [1].each do |y|\n      puts y unless z\n    end\n  end\nend\n"), ("a.php", "<p>hello world this is text</p>\n<?php\nfunction f(int $x): ?string { return $x . \"a\"; }\n?>\n"), ("a.txt", "((("), (None, "((("), ("a.go", None),
]
BROKEN = [
    ("a.py", "def f(:\n", "corrupt"), ("a.py", "package p\n\nfunc f() {\n}\n", "wrong_extension"), ("a.go", "package p\n\nfunc f() {\n", "corrupt"), ("a.js", "<<<<<<< HEAD\nx = 1;\n=======\nx = 2;\n>>>>>>> b\n", "corrupt"), ("a.js", "function f(x: number) { return x; }\n", "wrong_extension"),
    ("a.js", '{\n  "a": {"b": 1}\n}\n', "corrupt"), ("a.java", "class A {\n  int f() { return 1 +; }\n}\n", "corrupt"), ("a.rs", "fn f() {\n    let s = \"abc\n", "corrupt"), ("a.c", "int f(void) {\n    return (1;\n}\n", "corrupt"), ("a.c", "/* open\nint x;\n", "corrupt"),
    ("a.rb", "def f\n  if x\n    1\nend\n", "corrupt"), ("a.php", "<?php\nfunction f() {\n", "corrupt"), ("a.ts", "Notes on the parser\n\nWe copy the nested function and go.\n", "corrupt"), ("a.ts", 'import { A } fr', "corrupt"), ("a.go", "<!doctype html>\n<html></html>\n", "corrupt"),
]


@pytest.mark.parametrize(("path", "text"), VALID)
def test_valid(path, text):
    assert syntax.judge(text, path)[0] is False, syntax.judge(text, path)


@pytest.mark.parametrize(("path", "text", "cause"), BROKEN)
def test_broken(path, text, cause):
    assert syntax.judge(text, path)[:2] == (True, cause)


def test_broken_tables(spark, rows):
    files = spark.createDataFrame([("r/" + p, t, "x", True) for p, t, _ in BROKEN[:3]] + [("r/ok.py", "x = 1", "x", True), ("r/ok.py", "x = 1", "x", True), (None, "(", "x", True)], "path string, content string, lang string, broken boolean")
    assert rows(broken_files.broken_paths(files)) == [("r/a.go",), ("r/a.py",)]
    modules = spark.createDataFrame([("r/a.go", " Go "), ("r/a.py", ""), ("r/a.py", None)], "file string, lang string")
    assert rows(broken_files.broken_rates(files, modules).select("repo", "language", "n_files", "n_broken", "broken_rate")) == [("r", "go", 1, 1, 1.0), ("r", "python", 2, 1, 0.5)]
    assert broken_files.broken_rates(files.where("false"), modules).count() == 0


PROVENANCE = [
    ("r/a.go", "// Code generated by wiregen v1. DO NOT EDIT.\npackage p\n", "generated"), ("r/a.py", "# The stubs next door are generated by x; this file is edited by hand.\nx = 1\n", ""), ("r/a.py", 'banner = "Code generated by x. DO NOT EDIT."\n', ""),
    ("r/vendor/lib/a.go", "package p\n", "third_party"), ("r/vendor_portal/a.go", "package p\n", ""), ("r/a.py", "# Copyright the other contributors. All rights reserved.\nx = 1\n", "third_party"), ("r/a.py", "# Copyright the r contributors. All rights reserved.\nx = 1\n", ""),
    ("r/a.js", "a=b(1);" * 60, "minified"), ("r/a.js", "[" + ",".join(["12"] * 80) + "]\n", "data"), ("r/a.c", "".join(f"#define NAME_{chr(65 + i)} {i}\n" for i in range(20)), ""), ("r/x_pb2.py", "x = 1\n", "generated"),
    ("r/a.ts", "".join(f"export function getFieldX{i}(m) {{\n  return m.fields[{i}];\n}}\n" for i in range(9)), "generated"), (None, None, ""), ("r/a.py", "", ""),
]


@pytest.mark.parametrize(("path", "text", "kind"), PROVENANCE)
def test_provenance(path, text, kind):
    assert provenance.classify(path, text)[0] == kind


LICENCE = "".join(f"// Clause {k}: the licence says something at length here.\n" for k in range(40))
NOTICES = [
    ("r/a.go", "package p\n\n" + "func f() int { return 1 }\n" * 30 + "// Code generated by wiregen v2.17. DO NOT EDIT.\n", "generated"),
    ("r/a.js", LICENCE + "// @generated by tablemint from rule.idl\nexport const x = f(1);\n", "generated"),
    ("r/a.ts", LICENCE + "// Vendored copy of upstream tools\nexport const x = f(1);\n", "third_party"),
    ("r/a.py", "import a\n" * 20 + "x = a.f(1)\n# Maintained manually now, file was generated by typecast once\n", ""),
    ("r/A.java", "class A {\n" + "    int f() { return 1; }\n" * 20 + "    // Auto-generated method stub\n}\n", ""),
    ("r/gen.js", "const f = g(1);\n" * 20 + "const head = `\n// Code generated by wiregen v2.17. DO NOT EDIT.\n`;\n", ""),
    ("r/gen.py", "x = f(1)\n" * 20 + 'HEAD = """\n# @generated by tablemint from rule.idl\n"""\n', ""),
    ("r/gen.rb", "x = f(1)\n" * 20 + "HEAD = <<~TEXT\n  # @generated by tablemint from rule.idl\nTEXT\n", ""),
    ("r/gen.rs", "fn f() {}\n" * 20 + 'const HEAD: &str = r#"\n// Code generated by "wiregen" v2. DO NOT EDIT.\n"#;\n// Code generated by wiregen v2.17. DO NOT EDIT.\n', "generated"),
]


@pytest.mark.parametrize(("path", "text", "kind"), NOTICES)
def test_notices_of_the_whole_file(path, text, kind):
    assert provenance.by_header(path, text) == kind


def _source(seed: int, n: int = 30) -> list[str]:
    r = random.Random(seed)
    return [f"call_{r.randrange(10**6)}(argument_{r.randrange(10**6)}, other_{r.randrange(10**6)})" for _ in range(n)]


def test_copies_across_repositories(spark, rows):
    common = ["# shared helper line that everybody has"]
    files = [(f"repo{i}/own{i}.py", "\n".join(_source(i) + common)) for i in range(40)]
    base = _source(99)
    files += [(f"repo{i}/copy{i}.py", "\n".join([*base[: 25 + i], "edited_here(1, 2, 3)", *common])) for i in range(4)]
    twice = _source(77)
    files += [("solo/a.py", "\n".join(twice)), ("solo/b.py", "\n".join(twice)), ("solo/b.py", "\n".join(twice)), (None, "x"), ("solo/none.py", None)]
    df = spark.createDataFrame([(p, c, 1, 2) for p, c in files], "path string, content string, line int, repo int").repartition(6)
    assert rows(handwritten.not_handwritten(df)) == [(f"repo{i}/copy{i}.py", "third_party", "containment") for i in range(4)]
    assert handwritten.handwritten(df.where("path is not null")).select("path").distinct().count() == 43
    assert {r.kind for r in handwritten.origin_counts(df).collect()} == {"third_party", "handwritten"}
    assert handwritten.not_handwritten(df.where("false")).count() == 0


def test_many_copies(spark):
    """A third of all files copies one text: every copy is found, and pairs stay linear."""
    base = "\n".join(_source(5))
    files = [(f"r{i}/c.py", base) for i in range(60)] + [(f"r{i}/o.py", "\n".join(_source(1000 + i))) for i in range(120)]
    df = spark.createDataFrame(files, "path string, content string")
    assert {r.path for r in handwritten.not_handwritten(df).collect()} == {f"r{i}/c.py" for i in range(60)}
    assert handwritten.contained_copies(df).count() <= 2 * 60


def test_a_copy_is_found_whatever_its_lines_stand_in(spark):
    """Each line of two identical files also stands in one file of a lower and one of a higher repository."""
    base = _source(31, 12)
    files = [("m1/a.py", "\n".join(base)), ("m2/b.py", "\n".join(base))]
    for k, line in enumerate(base):
        for repo in ("a0", "z9"):
            files.append((f"{repo}/f{k}.py", "\n".join([line, *_source(500 + 2 * k + (repo == "z9"), 30)])))
    df = spark.createDataFrame(files, "path string, content string")
    assert {r.path for r in handwritten.not_handwritten(df).collect()} == {"m1/a.py", "m2/b.py"}


@pytest.mark.parametrize("rare", [2, 32])
def test_edited_copies_against_brute_force(spark, rare):
    """Families of edited copies, more versions than a rare line may have; every file against every other."""
    r = random.Random(8)
    files = {}
    for family in range(4):
        base = _source(900 + family, 20)
        for v in range(12):
            kept = [x for x in base if r.random() < 0.9]
            files[f"r{v}/f{family}.py"] = kept + _source(10_000 + 50 * family + v, r.choice([1, 4, 12, 20]))
    for k in range(60):
        files[f"r{k % 9}/own{k}.py"] = _source(20_000 + k, 15) + [f"shared line number {k % 5} for all of us"]
    sets = {p: frozenset(x) for p, x in files.items()}
    n = len(set(sets.values()))
    df = {x: sum(x in s for s in set(sets.values())) for s in sets.values() for x in s}
    w = lambda lines: sum(math.log(n / df[x]) for x in lines)
    expected = {p for p, s in sets.items() for q, o in sets.items() if p.split("/")[0] != q.split("/")[0] and len(s & o) >= 3 and w(s & o) >= max(0.6 * w(s), math.log(n) + 3)}
    table = spark.createDataFrame([(p, "\n".join(x)) for p, x in files.items()], "path string, content string")
    names = {r.h: r.path for r in table.select("path", F.xxhash64("path").alias("h")).collect()}
    assert {names[r.file] for r in handwritten.contained_copies(table, rare=rare).collect()} == expected
    assert 10 < len(expected) < 48


ITEM = "Write a function that ranks canal locks by creation order and mirrors those weather balloons whose indent level exceeds 6078 for all of them."


def _brute_leaks(docs, items, run=13):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda t: {tuple(x[k : k + run]) for x in [w(t)] for k in range(len(x) - run + 1)}
    return sorted({(i, d) for i, t in items for d, x in docs if i is not None and d is not None and grams(t) & grams(x)})


def test_leaks(spark, rows, monkeypatch):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(1, ITEM), (2, "too short"), (3, None), (None, ITEM), (5, " ".join(r.choice(vocabulary) for _ in range(60))), (6, " ".join(r.choice(vocabulary) for _ in range(40))), (1, ITEM)]
    words = ITEM.split()
    docs = [(10, "Before. " + " -- ".join(words[:13]).upper() + " after"), (11, " ".join(words[:12])), (12, " ".join(words[:6] + ["gap"] + words[6:])), (13, None), (14, ""), (None, ITEM), (15, "x" * 5000), (16, "filler " * 100 + ITEM + " filler" * 100)]
    docs += [(20 + i, " ".join(r.choice(vocabulary) for _ in range(30)) + " " + " ".join((items[4 + i % 2][1].split())[i : i + 11 + i % 5]) + " " + " ".join(r.choice(vocabulary) for _ in range(90))) for i in range(20)]
    d = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([(a, b, "s") for a, b in items], "item_id bigint, text string, suite string")
    expected = _brute_leaks(docs, items)
    assert len(expected) > 5
    assert rows(leakage.leaked(d, e)) == expected
    assert rows(leakage.leaked_by_join(d.select("doc_id", "text").where("doc_id is not null"), e.where("item_id is not null"))) == expected
    assert leakage.leaked(d.where("false"), e).count() == 0
    # In parts of a few items each, with the same result.
    monkeypatch.setattr(leakage, "PART_BYTES", 200)
    assert rows(leakage.leaked(d, e)) == expected
    monkeypatch.setattr(leakage, "PART_EXCESS", 0.1)
    with pytest.raises(ValueError, match="too long"):
        leakage.leaked(d, e)
    monkeypatch.undo()
    assert leakage.leaked(d, e.where("false")).count() == 0
    assert leakage.leak_report(d, e).count() == 1


RESIDUE = [
    ("Hello {{ name }}, welcome.", "placeholder"), ("The loader fills `{{ name }}` from the file.", ""), ("```html\n<h1>{{ title }}</h1>\n```\nReal text.", ""), ("Released on [INSERT DATE HERE] by us", "placeholder"), ("See __VERSION__ for it", "placeholder"),
    ("The pattern [a-z]{1,3} and __init__ are fine.", ""), ('Python fills `"{a} of {b}".format(...)` here', ""), ("Maintained by {owner}.", "placeholder"), ("404 Not Found\n\nnothing here", "error_page"), ("The daemon answered with a 404 because it was renamed.", ""),
    ('We log "502 Bad Gateway" whenever it restarts.', ""), ("Please enable JavaScript to view this page.", "script_notice"), ("Our test page shows a notice if JavaScript is disabled, and the parser checks that notice.", ""), ("blah blah blah, blah blah, blah blah", "filler"),
    ("Lorem ipsum dolor amet placet vixit fulget cordis.", "filler"), ("The fixture uses lorem ipsum as sample input for the index.", ""), ("", ""), (None, ""), ("ok", ""), ("An access denied error points to a parser; check its owner.", ""),
]


def test_residue(spark, rows):
    df = spark.createDataFrame([(i, t, "S " if i % 2 else None, "x") for i, (t, _) in enumerate(RESIDUE)] + [(None, "Hello {{ name }}", "s", "x")], "doc_id bigint, text string, source string, rule string")
    found = {r.doc_id: r.rules for r in residue.residue_documents(df).collect()}
    assert {i: found.get(i, "") for i in range(len(RESIDUE))} == {i: rule for i, (_, rule) in enumerate(RESIDUE)}
    assert residue.without_residue(df.where("doc_id is not null")).count() == sum(not rule for _, rule in RESIDUE)
    assert residue.residue_documents(df.where("false")).count() == 0


def test_bare_status_needs_recurrence(spark):
    text = "Some heading\n\nForbidden\n\nreal text follows here"
    one = spark.createDataFrame([(1, text, "a")], "doc_id bigint, text string, source string")
    many = spark.createDataFrame([(i, text, f"s{i}") for i in range(9)], "doc_id bigint, text string, source string")
    assert residue.residue_documents(one).count() == 0
    assert residue.residue_documents(many).count() == 9


RULED = [
    ("You must allow cookies.", "script_notice"), ("Please turn on scripts.", "script_notice"), ("Scripts are blocked, so this page cannot be shown.", "script_notice"), ("We detected that scripts are off.", "script_notice"), ("Scripts may be disabled.", "script_notice"),
    ("dolor amet consectetur adipiscing eiusmod tempor", "filler"), ("tandem amet fervet estive grandio quaelis cordis", "filler"), ("one two three, one two three, one two three, one two three", "filler"), ("Scripts are short programs.", ""),
]


def test_no_line_is_kept_from_the_rules(spark):
    df = spark.createDataFrame([(i, f"Heading of the text\n{t}", "s") for i, (t, _) in enumerate(RULED)], "doc_id bigint, text string, source string")
    found = {r.doc_id: r.rules for r in residue.residue_documents(df).collect()}
    assert {i: found.get(i, "") for i in range(len(RULED))} == {i: rule for i, (_, rule) in enumerate(RULED)}


def test_every_rule_names_a_text_that_it_needs():
    for group in (*residue.PHRASES.values(), *residue.BROAD.values()):
        for key, pattern in group:
            needed = re.sub(r"\([^()]*\)", "()", re.sub(r"\([^()]*\)\??", "()", pattern))
            assert all(k in branch or k.split()[0] in branch for branch in needed.split("|") for k in [key.removesuffix("s")]), (key, pattern)


RECURS = [
    ("The upstream host did not respond.", True), ("Scheduled maintenance", True), ("We measured how often the upstream host did not respond.", False), ("The upstream host did not respond, which is why the second half of this chapter describes at length how to ask again.", False),
]


def test_recurrence_decides_on_broad_rules(spark):
    """The same message is residue in three documents of two sources, and none in two documents or in one source."""
    texts = [f"Heading\n{t}\nreal text follows" for t, _ in RECURS]
    for sources, flagged in ((["a", "b", "a"], True), (["a", "b"], False), (["a", "a", "a", "A "], False)):
        df = spark.createDataFrame([(10 * i + k, t, s) for i, t in enumerate(texts) for k, s in enumerate(sources)], "doc_id bigint, text string, source string")
        found = {r.doc_id // 10 for r in residue.residue_documents(df).collect()}
        assert found == {i for i, (_, rule) in enumerate(RECURS) if rule and flagged}


def test_eligible_lines():
    text = "  > ```\n{{ name }}\n> ```\n\nIt says `{{ name }}` here\nDear {{ name }},\nhttp://x/404 broke\nHTTP 404\nİİ {{ x }}\nnothing"
    assert [(at, line) for at, line in residue.eligible_lines(text) if at] == [(1, "Dear {{ name }},"), (2, "http://x/404 broke"), (3, "HTTP 404"), (4, "İİ {{ x }}")]
    assert residue.eligible_lines(None) == residue.eligible_lines("") == []


def test_message_counts_are_exact(spark):
    n = 3000
    df = spark.range(n).selectExpr("id as doc_id", "'Please turn on scripts.\nPlease turn on scripts.' as text", "concat('s', id % 700) as source")
    assert [tuple(r) for r in residue.recurring_messages(df).select("n_lines", "n_docs", "n_sources").collect()] == [(2 * n, n, 700)]
    lines = residue.classified_lines(df).select("n_docs", "n_sources").distinct().collect()
    assert [tuple(r) for r in lines] == [(n, 700)]


TRIVIAL = [
    ('"""."""', "f"), ("/** TODO: document */", "f"), ("// FIXME", "f"), ("/**\n * walkRule function.\n */", "walkRule"), ("# Function to walk rule.", "walk_rule"), (":param x:\n:returns:", "f"), ("/** @param depth */", "f"), ("// acc = seal(weight, 41)", "f"), ("Constructor.", "f"), ("{@inheritDoc}", "f"),
    ("See above.", "f"), ("", "f"), (None, "f"), ("//", "f"), ("====================", "f"), ("sin descripción", "f"), ("T.B.D.", "f"), ("/* if (x) {\n   return y;\n } */", "f"),
]
TELLING = [("/** Walks the back edge for each language. */", "walk"), ("TODO: narrow the lock. Until then it exposes the whole module path.", "f"), ("@param limit broken signature to use", "f"), ("Das Register sperrt den Aufrufgraphen.", "f"), ("Returns 9 when the queue is stale.", "f")]


@pytest.mark.parametrize(("doc", "name"), TRIVIAL)
def test_trivial(doc, name):
    assert function_docs.trivial(doc, name)


@pytest.mark.parametrize(("doc", "name"), TELLING)
def test_telling(doc, name):
    assert not function_docs.trivial(doc, name)


PY = 'class A:\n    @cached\n    def f(self, x):\n        """Keeps the sparse index small."""\n        return x\n\n    def g(self):\n        return 1\n'
JS = "/** Sorts what the cache holds. */\nfunction s(a) {\n  if (a) {\n    return 1;\n  }\n}\n\n/** Lost to a blank line. */\n\nfunction t() {\n}\n"
RB = "# Drops stale rows at night.\ndef drop(x)\n  if x\n    1\n  end\nend\n"
GO = "package p\n\n// Seal closes the ledger for good.\nfunc (r *T) Seal() int {\n\treturn 1\n}\n"
RS = "impl T {\n    /// Merges both halves of a span.\n    #[inline]\n    pub fn merge(&self) -> i64 {\n        1\n    }\n}\n"


def test_pairs(spark, rows):
    files = spark.createDataFrame([("a.py", PY), ("a.py", PY), ("b.js", JS.replace("\n", "\r\n")), ("c.rb", RB), ("d.go", GO), ("e.rs", RS), ("n.py", None), (None, PY)], "path string, content string")
    listed = [("a.py", "A", "f", None, 3), ("a.py", "A", "f", None, 3), ("a.py", "A", "g", "", 7), ("b.js", "", "s", None, 2), ("b.js", None, "t", None, 10), ("c.rb", "", "drop", "  ", 2), ("d.go", "T", "Seal", None, 4), ("e.rs", "T", "merge", None, 4), ("x.py", "", "far", '"""Reads remote rows in one pass."""', 1), ("a.py", "", None, "x", 1)]
    functions = spark.createDataFrame([(p, o, n, "()", d, k, "x") for p, o, n, d, k in listed], "path string, owner string, name string, params string, docstring string, line_number int, comment string")
    found = function_docs.documented_functions(functions, files)
    assert rows(found.select("path", "owner", "name")) == [("a.py", "A", "f"), ("b.js", "", "s"), ("c.rb", "", "drop"), ("d.go", "T", "Seal"), ("e.rs", "T", "merge"), ("x.py", "", "far")]
    units = spark.createDataFrame([("a.py:A.f", " def  A.f(x) ", None), ("b.js:s", None, None)], "unit_id string, signature string, indexed_at timestamp")
    out = {r.unit_id: r for r in function_docs.pairs(functions, files, units).collect()}
    assert "x.py:far" not in out
    assert out["a.py:A.f"].signature == "def A.f(x)" and out["a.py:A.f"].documentation == "Keeps the sparse index small."
    assert out["a.py:A.f"].code.endswith("return x") and out["c.rb:drop"].code == RB.split("\n", 1)[1].rstrip("\n")
    assert out["b.js:s"].code == "\n".join(JS.split("\n")[1:6]) and out["d.go:T.Seal"].code.endswith("}")
    assert function_docs.documented_functions(functions.where("false"), files).count() == 0


BODIES = [
    ("a.py", "f", 1, 'def f(\n    a,\n):\n    s = """\nat column 0 }\n"""\n    return (\n1\n    )\n', "\nx = 1\n"), ("a.py", "f", 1, "def f(a: dict[str, int] = {1: 2}): return a\n", "def g(): pass\n"),
    ("a.rb", "f", 1, "def f(a)\n  x = if a then 1 else 2 end\n  y = if a\n    1\n  end\n  return 1 if x\n  while x do\n    z\n  end\n  [1].each do |i|\n    puts i unless x\n  end\nend\n", "\ndef g\nend\n"), ("a.rb", "a", 1, "def a; 1; end\n", "def b\nend\n"), ("a.rb", "f", 1, "def f(x) = x + 1\n", "def b\nend\n"),
    ("a.js", "f", 1, "function f(a = {}, { b }) {\n  return `}${a}` + '}' + /[}]/.test(b); // }\n}\n", "g();\n"), ("a.ts", "f", 1, "function f(\n  opts: { a: number },\n): { b: number }\n{\n  return { b: 1 };\n}\n", "g();\n"), ("a.ts", "f", 1, "const f = (a: number) => a + 1;\n", "const g = 1;\n"), ("a.ts", "f", 1, "export const f = async (\n  a: number,\n) => {\n  return a;\n};\n", "g();\n"),
    ("a.go", "F", 1, "func (r *T) F(x interface{}) (interface{}, error) {\n\treturn `}`, nil\n}\n", "func G() {}\n"), ("a.go", "F", 1, "func F() map[string]interface{} {\n\treturn nil\n}\n", "func G() {}\n"), ("A.java", "f", 1, "public static int f(\n    int a,\n    int b) throws E\n{\n  char c = '}';\n  return 1;\n}\n", "int g() {}\n"), ("A.java", "f", 1, "abstract int f(int a);\n", "int g() {}\n"),
    ("a.c", "f", 1, "static int f(int a[3],\n             int b)\n{\n    return '}';\n}\n", "int g;\n"), ("a.rs", "f", 1, "pub fn f<'a>(x: &'a [u8; 3]) -> char {\n    '}'\n}\n", "fn g() {}\n"), ("a.php", "f", 1, "function f(array $a = []): ?string {\n  return \"}\";\n}\n", "g();\n"),
]


@pytest.mark.parametrize(("path", "name", "line", "body", "after"), BODIES)
def test_bodies(path, name, line, body, after):
    found = function_docs.definitions(path, body + after, [(name, line), ("absent", line), (name, 99)])
    assert found[0] is not None and found[0][2].rstrip("; \n") == body.rstrip("; \n")
    assert found[1:] == [None, None]


TARGETS = "mix string, source string, target_share double, max_repeats int"


def test_pivot():
    r = random.Random(1)
    sizes = [r.randrange(1, 500) for _ in range(400)]
    out = mixing.pivot(sizes, [0.37] * 400, r.random)
    assert sum(0 < p < 1 for p in out) <= 1
    assert math.isclose(sum(s * p for s, p in zip(sizes, out, strict=True)), 0.37 * sum(sizes), rel_tol=1e-9)
    # Each record is drawn with its own probability.
    hits = [sum(mixing.pivot([3, 1, 2, 5], [0.5, 0.5, 0.5, 0.5], r.random)[k] for _ in range(4000)) / 4000 for k in range(4)]
    assert all(abs(h - 0.5) < 0.05 for h in hits)
    assert mixing.pivot([], [], r.random) == []


@pytest.fixture
def plain_tokens(monkeypatch):
    """One token for each character, so the test needs no vocabulary."""
    sized = lambda d, t, v=None: d.where("doc_id is not null and text <> ''").select("doc_id", F.lower(F.trim("source")).alias("source"), F.length("text").cast("bigint").alias("tokens"))
    monkeypatch.setattr(mixing, "record_sizes", sized)


def test_mix(spark, rows, plain_tokens, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    r = random.Random(2)
    docs = [(i, "x" * r.randrange(1, 200), "Big " if i % 2 else "big") for i in range(600)] + [(1000 + i, "y" * 50, "small") for i in range(10)] + [(None, "zz", "big"), (2000, None, "small"), (2001, "", "big"), (2002, "q", None), (2003, "other", "unlisted")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, source string, tokens int")
    t = spark.createDataFrame([("m", "big", 0.6, 2), ("m", "small", 0.4, 3), ("m", "absent", 0.0, 3), ("n", "small", 0.9, 1), ("n", "absent", 0.1, 5), (None, "big", 1.0, 1)], TARGETS)
    report = {(x.mix, x.source): x for x in mixing.mix_report(d, t).collect()}
    assert set(report) == {("m", "big"), ("m", "small"), ("m", "absent"), ("n", "small"), ("n", "absent")}
    assert rows(mixing.short_sources(d, t)) == [("m", "small"), ("n", "absent")]
    big = report["m", "big"]
    assert abs(big.drawn_tokens - big.wanted_tokens) <= 200
    assert report["m", "small"].drawn_tokens == 3 * 500 and report["m", "small"].max_copies == 3
    mixed = mixing.draw(d, t)
    assert mixed.draws.where("copies > 3 or copies < 1").count() == 0
    assert rows(mixed.draws) == rows(mixing.draw(d.repartition(7), t).draws)
    assert mixing.mix_report(d.where("false"), t).where("drawn_tokens > 0").count() == 0
    assert mixing.mix_report(d, t.where("false")).count() == 0


def test_token_sizes(spark, rows):
    pytest.importorskip("public_tokenizers")
    d = spark.createDataFrame([(1, "hello world", "a"), (2, None, "a"), (3, "hello world", "b")], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    assert rows(mixing.record_sizes(d, t)) == [(1, "a", 2)]
