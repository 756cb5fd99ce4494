from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomcode.functions import paths
from loomcode.sources import files as tree

CASES = [
    ("*.tmp", "notes/draft.tmp", True), ("*.tmp", "notes/draft.tmp.md", False), ("target/", "target/lib.rlib", True), ("target/", "crates/one/target/lib.rlib", True), ("target/", "targets.txt", False), ("/logs/", "logs/today.txt", True), ("/logs/", "service/logs/today.txt", False),
    ("docs/*.pdf", "docs/guide.pdf", True), ("docs/*.pdf", "docs/old/guide.pdf", False), ("**/fixtures/**", "pkg/one/fixtures/rows.csv", True), ("**/fixtures/**", "fixtures_note.csv", False), ("part-?.csv", "out/part-3.csv", True), ("part-?.csv", "out/part-31.csv", False), ("Licence", "lib/licence", True),
]


def test_rules(spark, rows):
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, pattern string, path string, want boolean").withColumn("regex", tree.rule_regex(F.col("pattern")))
    assert rows(table.where("(path rlike regex) <> want").select("pattern", "path")) == []


def test_last_match_wins(spark, rows):
    files = spark.createDataFrame([("a/x.log",), ("a/keep.log",), ("a/sub/y.log",), ("b/x.log",)], "path string")
    rules = tree.rules_of(spark.createDataFrame([("a", 0, "*.log"), ("a", 1, "!keep.log"), ("a", 2, "# comment"), ("a/sub", 0, "!y.log")], "dir string, ord int, pattern string"))
    assert rows(tree.ignored(files, rules)) == [("a/x.log", "*.log")]
    assert rows(tree.ignored(files.where("false"), rules)) == []


def test_scan(spark, rows, tmp_path):
    for name, text in {"a.py": "x = 1\n", "skip.log": "no", ".hidden.py": "no", "node_modules/m.js": "no", "src/b.go": "package b\n", ".gitignore": "*.log\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = tree.scan(spark, str(tmp_path))
    assert rows(found.select("path", "language", "content")) == [("a.py", "python", "x = 1\n"), ("src/b.go", "go", "package b\n")]
    assert tree.scan(spark, str(tmp_path), max_bytes=7).count() == 1


def test_tree(spark, rows):
    files = spark.createDataFrame([("r/a/x.py",), ("r/a/x.py",), ("r/y.go",), (None,)], "path string")
    assert rows(tree.tree_nodes(files)) == [("r", "", "r", "dir", 2), ("r/a", "r", "a", "dir", 1), ("r/a/x.py", "r/a", "x.py", "file", 1), ("r/y.go", "r", "y.go", "file", 1)]


@pytest.mark.parametrize(("path", "language"), [("a.PY", "python"), ("x/Makefile", "make"), ("a.unknown", ""), ("noext", ""), ("t.test.tsx", "typescript"), ("docker-compose.yml", "yaml")])
def test_language(spark, path, language):
    assert spark.createDataFrame([(path,)], "path string").select(paths.detect_language(F.col("path"))).first()[0] == language


def test_predicates(spark, rows):
    df = spark.createDataFrame([("a/test_x.py",), ("a/x_test.go",), ("a/conftest.py",), ("a/tests/x.py",), ("a/x.pyc",)], "path string")
    p = F.col("path")
    assert rows(df.select("path", paths.is_test(p), paths.is_compiled(p), paths.in_directory(p, "tests"))) == [("a/conftest.py", True, False, False), ("a/test_x.py", True, False, False), ("a/tests/x.py", False, False, True), ("a/x.pyc", False, True, False), ("a/x_test.go", True, False, False)]
    assert df.select(paths.module_name(p)).first()[0] == "a.test_x"
