"""File trees: scanning, ignore rules, the tree itself."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcode.functions import paths
from loomcode.functions.arrow import map_lists

# Fixed value: directories that a scan leaves out unless asked.
EXCLUDED = ("node_modules", "vendor", "dist", "build", "target", "__pycache__", "venv", "env", "site-packages", "coverage", "out", "bin", "obj")
IGNORE_FILES = (".loomignore", ".gitignore")


def scan(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED, max_bytes: int | None = None) -> DataFrame:
    """``path, size, modified_at, language, content`` of the files below a root.

    Spark lists no hidden names; excluded directories are left out before any content is read; undecodable bytes are replaced. The
    rules of ignore files in the tree apply, the nearer ones and later lines last.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(base), "")
    found = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")
    if max_bytes is not None:
        found = found.where(F.col("size") <= max_bytes)
    rules = parse_rules(ignore_files(found.select("path"), root))
    if excluded:
        found = found.where(~paths.in_directory(F.col("path"), *excluded))
    kept = found.join(ignored(found.select("path"), rules), "path", "left_anti")
    return kept.select("path", "size", "modified_at", paths.detect_language(F.col("path")).alias("language"), F.expr("make_valid_utf8(cast(content as string))").alias("content"))


def ignore_files(files: DataFrame, root: str) -> DataFrame:
    """``path, content`` of the ignore files in the directories above the given paths.

    Their names are hidden from Spark's listing, so tasks open them by name, directory by directory.
    """
    parts = F.split("path", "/")
    depth = F.sequence(F.lit(0), F.size(parts) - 1)
    directories = files.select(F.explode(F.transform(depth, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("dir")).distinct()

    def read(dirs: list) -> list:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
        out = []
        for name in (f"{d}/{x}" if d else x for d in dirs for x in IGNORE_FILES):
            place = f"{base.rstrip('/')}/{name}"
            if system.get_file_info(place).type == fs.FileType.File:
                with system.open_input_stream(place) as source:
                    out.append((name, source.read().decode("utf-8", "replace")))
        return out

    return map_lists(directories, read, "path string, content string")


def parse_rules(ignore_files: DataFrame) -> DataFrame:
    """``dir, ord, pattern, negated, regex`` of the rules in ignore files given as ``path, content``.

    Blank lines and comments are no rules; the order of a rule grows with the file's place and the line, so later rules of
    one directory win; the project's own ignore file counts before the other.
    """
    own = F.when(paths.file_name(F.col("path")) == IGNORE_FILES[0], 0).otherwise(1)
    lines = ignore_files.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), own.alias("own"), F.posexplode(F.split("content", "\r?\n")).alias("at", "line"))
    return rules_of(lines.select("dir", (F.col("own") * 1_000_000 + F.col("at")).alias("ord"), F.trim("line").alias("pattern")))


def rules_of(rows: DataFrame) -> DataFrame:
    """Adds ``negated, regex`` to rows of ``dir, ord, pattern``."""
    rows = rows.where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
    return rows.withColumn("negated", F.col("pattern").startswith("!")).withColumn("regex", rule_regex(F.regexp_replace("pattern", "^!", "")))


def rule_regex(pattern: Column) -> Column:
    """A rule as a regular expression on the path below the rule's directory.

    A trailing slash names a directory at any depth unless anchored, and matches what lies in it; ``**`` is any number of
    directories, ``*`` and ``?`` stay inside one name; other rules match the end of the path. Rules without a glob sign
    disregard case.
    """
    directory = pattern.endswith("/")
    anchored = pattern.startswith("/")
    body = F.regexp_replace(F.regexp_replace(pattern, "^/", ""), "/$", "")
    glob = body.rlike(r"[*?]")
    quoted = F.regexp_replace(body, r"([.+^$(){}|\\\[\]])", r"\\$1")
    any_depth = F.replace(F.replace(F.replace(F.replace(quoted, F.lit("**/"), F.lit("\x01")), F.lit("/**"), F.lit("\x02")), F.lit("**"), F.lit("\x03")), F.lit("*"), F.lit("[^/]*"))
    expanded = F.replace(F.replace(F.replace(F.replace(any_depth, F.lit("?"), F.lit("[^/]")), F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit("(?:/.*)?")), F.lit("\x03"), F.lit(".*"))
    inside = F.concat(F.when(anchored | (glob & F.contains(body, F.lit("/"))), "^").otherwise("(?:^|/)"), expanded, F.when(directory, "/").otherwise("$"))
    return F.concat(F.when(glob, "").otherwise("(?i)"), inside)


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``path, rule`` of the paths whose last matching rule is no negation; rules of deeper directories come later.

    A path meets the rules of each of its ancestor directories by an equi-join on the directory, not by testing every rule
    on every path.
    """
    parts = F.split("path", "/")
    depth = F.sequence(F.lit(0), F.size(parts) - 1)
    ancestors = files.select("path", F.explode(depth).alias("depth"), parts.alias("parts"))
    ancestors = ancestors.select("path", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir"), F.array_join(F.slice("parts", F.col("depth") + 1, F.size("parts")), "/").alias("rest"))
    met = ancestors.join(rules, "dir").where(F.expr("rest rlike regex"))
    last = met.groupBy("path").agg(F.max_by(F.struct("negated", "pattern"), F.struct("depth", "ord", "pattern")).alias("r"))
    return last.where("not r.negated").select("path", F.col("r.pattern").alias("rule"))


def tree_nodes(files: DataFrame) -> DataFrame:
    """``path, parent, name, kind, n_files`` of every directory and file; a directory stands only above some file."""
    parts = F.split("path", "/")
    levels = files.where("path is not null").select("path").distinct().select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts"))
    nodes = levels.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("node"), (F.col("depth") == F.size("parts")).alias("leaf"))
    grouped = nodes.groupBy("node").agg(F.max("leaf").alias("leaf"), F.count("*").alias("n_files"))
    return grouped.select(F.col("node").alias("path"), F.regexp_extract("node", r"^(.*)/[^/]*$", 1).alias("parent"), paths.file_name(F.col("node")).alias("name"), F.when(F.col("leaf"), "file").otherwise("dir").alias("kind"), "n_files")
