"""Statement and expression forms of each language: a valid one and its broken twin."""

from __future__ import annotations

import pytest

from loomcode.llm import syntax

# The form stands where ~ is.
FRAMES = {
    "go": ("a.go", "package p\n\nfunc f() {\n\t~\n}\n"), "java": ("a.java", "class A {\n  void f() {\n    ~\n  }\n}\n"), "c": ("a.c", "void f(void) {\n    ~\n}\n"), "rust": ("a.rs", "fn f() {\n    ~\n}\n"),
    "javascript": ("a.js", "function f() {\n  ~\n}\n"), "typescript": ("a.ts", "function f(): void {\n  ~\n}\n"), "php": ("a.php", "<?php\nfunction f() {\n  ~\n}\n"), "ruby": ("a.rb", "def f\n  ~\nend\n"), "python": ("a.py", "def f():\n    ~\n"),
}
FORMS = {
    "go": [
        ("if x == y {\n}", "if x == {\n}"), ("if x {\n}", "if {\n}"), ("for {\n}", "for for {\n}"), ("x := a + b", "x := a + * / b"), ("x := -a * b", "x := a * / b"), ("f(a, b)", "f(a, , b)"), ("f(a,\n)", "f(, a)"), ("var x = 1", "var = 1"), ("const x = 1", "const = 1"), ("x := p{a: 1}", "x := = 1"),
        ("if a {\n} else {\n}", "else {\n}"), ("switch x {\ncase 1:\n}", "switch x {\ncase :\n}"), ("x = y", "x = "), ("a[1:] = b", "a[+] = b"), ("x := (a + b)", "x := (a +)"), ("return a && b", "return a && }"), ("*p = 1\n\tq := &x", "x == = 1"),
    ],
    "java": [
        ("if (a) { }", "if { }"), ("if (a) { }", "if () { }"), ("while (a) b();", "while b();"), ("for (int i = 0; i < n; i++) { }", "for (int i = 0; i < n) { }"), ("for (;;) { }", "for (;;;) { }"), ("for (String s : xs) { }", "for (String s xs) { }"), ("int x = a * b;", "int x = * / b;"), ("int x = -a;", "int x = a + ;"), ("int y = 3;", "int = 3;"),
        ("if (a) b(); else c();", "else { c(); }"), ("if (a) { } else { }", "if (a) { } else { } else { }"), ("f(a, b);", "f(a, , b);"), ("f(a, b);", "f(a, );"), ("switch (x) { case 1: break; }", "switch (x) { case : break; }"), ("try { } catch (E e) { }", "try { } catch { }"), ("List<List<A>> x = new ArrayList<>();", "List<A> x = == 1;"), ("x = a ? b : c;", "x = (a && );"),
    ],
    "c": [
        ("if (a) { }", "if { }"), ("if (a) b(); else c();", "else c();"), ("while (a) { }", "while () { }"), ("for (;;) { }", "for (;;;) { }"), ("for (i = 0; i < n; i++) { }", "for (i = 0) { }"), ("int x = *p / 3;", "int x = * / 3;"), ("int x = 3;", "int = 3;"), ("char *s = \"a\" \"b\";", "char *s = = \"a\";"), ("f(a, b);", "f(a, , b);"), ("f(&a, *b);", "f(, b);"),
        ("x = (a + b);", "x = (a + );"), ("x = a[1];", "x = a[/ 1];"), ("switch (x) { case 1: break; }", "switch (x) { case : break; }"), ("x = a || b;", "x = a || ;"), ("if (a == b) { }", "if (a == ) { }"), ("x += 2;", "x += ;"), ("int a[] = {1, 2};", "int a[] = {1, , 2};"),
    ],
    "rust": [
        ("let x = 1;", "let = 1;"), ("if a { }", "if { }"), ("while a { }", "while { }"), ("match a { _ => 1 };", "match { _ => 1 };"), ("let x = a + b;", "let x = a + / b;"), ("let x = *a;", "let x = a % ;"), ("let x: Vec<u8> = Vec::new();", "let x: = 1;"), ("g(a, b);", "g(a, , b);"), ("g(&mut a);", "g(, a);"), ("fn g(x: u8) {}", "fn g(x) {}"),
        ("fn g<T: A>(&self, x: Option<T>) {}", "fn g<T: A>(x, y: T) {}"), ("if a { } else { }", "loop { } else { }"), ("let Some(x) = y else { return };", "let x = (a == );"), ("let c = |a, b| a + b;", "let c = a != ;"), ("x += 1;", "x += ;"), ("println!(\"{}\", a,);", "let x = = 1;"),
    ],
    "javascript": [
        ("const x = 3;", "const = 3;"), ("let [a, , b] = c;", "let = c;"), ("for (;;) {}", "for (;;;) {}"), ("for (const a of b) {}", "for (const a b) {}"), ("x = (1 + 2);", "x = (1 +* 2);"), ("if (a) b(); else c();", "else { a() }"), ("if (a) { } else { }", "while (a) { } else { }"), ("if (a) {}", "if {}"), ("if (a) {}", "if () {}"), ("while (a) {}", "while {}"),
        ("f(a, b);", "f(a, , b);"), ("f(...a);", "f(, a);"), ("x = a ?? b;", "x = a ?? ;"), ("x = {if: 1, for: 2};", "x = == 1;"), ("x = /[/]+/g.test(a);", "x = (a && );"), ("switch (a) { case 1: break }", "switch (a) { case : break }"), ("const g = async (a = 1) => a;", "x += ;"), ("x = a ? b : c;", "x = [a, = b];"),
    ],
    "typescript": [
        ("let x: number = 3;", "let x: = 3;"), ("const x = y as const;", "const = 3;"), ("const g = <T,>(a: T): T => a;", "x = (a || );"), ("for (const a of b) {}", "for (a b) {}"), ("if (a) { } else { }", "else { }"), ("x = a!.b?.c;", "x = a === ;"), ("type A =\n | B\n | C;", "let x = % 2;"), ("f<A>(a, b);", "f(a, , b);"), ("let y: Array<A<B>> = [];", "let y = = [];"), ("while (a) {}", "while {}"),
    ],
    "php": [
        ("foreach ($a as $b) { }", "foreach ($a $b) { }"), ("for ($i = 0; $i < 3; $i++) { }", "for ($i = 0) { }"), ("if ($a) { }", "if { }"), ("if ($a) { } else { }", "else { }"), ("$x = $a . $b;", "$x = $a . ;"), ("$x = $a * 2;", "$x = * 2;"), ("f($a, $b);", "f($a $b);"), ("f(&$a);", "f(= $a);"), ("[$a, , $b] = $c;", "$x = [== 1];"), ("while ($a) { }", "while () { }"), ("$x = $a ?: 1;", "$x = $a && ;"), ("$x += 2;", "$x += ;"),
    ],
    "ruby": [
        ("foo(1, 2)", "foo(1, , 2)"), ("x = a && b", "x = (a && )"), ("x = [*a, *b]", "x = [a == ]"), ("xs.map { |a| a + 1 }", "xs.map { |a| a + }"), ("foo(&:bar)", "foo(, 1)"), ("x += 1", "x = = 1"), ("x = a ? 1 : 2", "x = a != == 2"), ("if a\n    1\n  end", "if a\n    1"), ("while a do\n    b\n  end", "end\n  while a do\n    b\n  end"),
    ],
    "python": [("if a:\n        pass", "if:\n        pass"), ("x = [1, 2]", "x = [1, , 2]"), ("for a in b:\n        pass", "for a b:\n        pass"), ("x = a if b else c", "else: pass")],
}


@pytest.mark.parametrize("language", sorted(FORMS))
def test_forms(language):
    path, frame = FRAMES[language]
    for valid, broken in FORMS[language]:
        assert not syntax.judge(frame.replace("~", valid), path)[0], (valid, syntax.judge(frame.replace("~", valid), path))
        assert syntax.judge(frame.replace("~", broken), path)[0], broken


JSX = 'export const A = ({ items }) => (\n  <ul className="x" onClick={() => go(1)}>\n    {items.map((i) => <li key={i}>it\'s {i}</li>)}\n    <br />\n    <></>\n  </ul>\n);\n'


def test_markup_hides_nothing():
    assert not syntax.judge(JSX, "a.tsx")[0]
    assert syntax.judge(JSX + "const = 3;\n", "a.tsx")[0]
    assert syntax.judge(JSX + "x = (1;\n", "a.jsx")[0]
    assert syntax.judge(JSX[:90], "a.tsx")[0]
    assert not syntax.judge("const id = <T>(x: T) => x;\nconst n = <Node>other;\n", "a.ts")[0]
    assert syntax.judge("const id = <T>(x: T) => x;\nx = (1 + ;\n", "a.ts")[0]


def test_deep_nesting_is_still_checked():
    deep = "x = " + "-" * 200_000 + "1\n"
    assert syntax.check_python(deep) == ""
    assert syntax.check_python(deep + "y = (1\n") != ""


def test_every_grammar_is_tried(monkeypatch):
    tried = []
    monkeypatch.setattr(syntax, "check", lambda text, language, foreign=False: tried.append(language) or "no")
    assert syntax.judge("x = 1\n", "a.py")[:2] == (True, "corrupt")
    assert sorted(tried) == sorted(syntax.LANGUAGES)
