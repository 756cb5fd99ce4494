"""Symbols, imports and calls across files: lookups by priority, resolution, impact, closures."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcode.functions import paths
from loomcode.session import cut


#: After so many steps what was reached is written as one, so that the plan stays short however many follow.
FOLD = 50
# Functions that a language brings along.
BUILTINS = {
    "python": "abs all any bool bytes callable chr dict dir divmod enumerate eval exec filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len list locals map max min next object oct open ord pow print property range repr reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip",
    "go": "append cap clear close complex copy delete imag len make max min new panic print println real recover", "javascript": "parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent setTimeout setInterval clearTimeout clearInterval fetch structuredClone Number String Boolean Array Object Promise Symbol Error",
    "ruby": "puts print p gets raise require require_relative attr_reader attr_writer attr_accessor lambda proc loop rand sleep format sprintf", "php": "count strlen str_replace implode explode in_array array_map array_filter array_keys array_values array_merge sprintf printf print_r var_dump json_encode json_decode error_log is_null is_array",
    "c": "printf fprintf sprintf snprintf malloc calloc realloc free memcpy memset memcmp strlen strcpy strcmp strcat exit abort", "rust": "drop println print format vec panic assert Some Ok Err Box",
}
BUILTINS["typescript"] = BUILTINS["javascript"]
# End of the fixed values.


def call_kinds(sites: DataFrame, functions: DataFrame, names: DataFrame) -> DataFrame:
    """``path, line_no, base, name, kind, source`` of each call site ``path, line_no, base, name``.

    A call on self or this is ``method``; a bare name is ``local`` if the file defines it, ``imported`` if an import brings it
    in under that name, ``builtin`` if the language has it, else ``external``. A call on another base is ``module`` if the
    base's first part is imported, ``instance`` if it is a name of the file's own with a capital, else ``attribute``.
    ``source`` is the imported name behind an alias. Each name has one meaning in a file: of several imports the smallest.
    """
    own = functions.select("path", "name").distinct().withColumn("defined", F.lit(True))
    brought = names.groupBy("path", F.col("alias").alias("word")).agg(F.min("name").alias("source"))
    language = paths.detect_language(F.col("path"))
    known = reduce(lambda a, kv: a | ((language == kv[0]) & F.col("name").isin(kv[1].split())), BUILTINS.items(), F.lit(False))
    bare, of_self = F.col("base") == "", F.col("base").isin("self", "this", "cls", "$this")
    word = F.when(bare, F.col("name")).otherwise(F.regexp_extract("base", r"^(\w+)", 1))
    joined = sites.withColumn("word", word).join(own, ["path", "name"], "left").join(brought, ["path", "word"], "left")
    plain = F.when(F.col("defined"), "local").when(F.col("source").isNotNull(), "imported").when(known, "builtin").otherwise("external")
    based = F.when(of_self, "method").when(F.col("source").isNotNull(), "module").when(F.col("base").rlike(r"^[A-Z]"), "instance").otherwise("attribute")
    return joined.select("path", "line_no", "base", "name", F.when(bare, plain).otherwise(based).alias("kind"), F.when(~of_self, F.col("source")).alias("source"))


def symbols(units: DataFrame) -> DataFrame:
    """``key, unit_id, file, kind``: up to three keys for each function or method: its name inside its file, inside its
    module's last part, and inside its repository. Of several units under one key the smallest id stands."""
    named = units.where("type in ('function', 'method') and name is not null and file_path is not null")
    base = named.select("unit_id", F.col("file_path").alias("file"), "name", paths.repo(F.col("file_path")).alias("repo"), paths.stem(F.col("file_path")).alias("stem"))
    keys = F.array(
        F.struct(F.lit("file").alias("kind"), F.concat_ws("\x01", "file", "name").alias("key")),
        F.struct(F.lit("module").alias("kind"), F.concat_ws("\x01", "repo", "stem", "name").alias("key")),
        F.struct(F.lit("repo").alias("kind"), F.concat_ws("\x01", "repo", "name").alias("key")),
    )
    return base.select("unit_id", "file", F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.min("unit_id").alias("unit_id"))


def imported_modules(modules: DataFrame) -> DataFrame:
    """``file, module, first``: the distinct modules a file imports, and the first part of their dotted name."""
    each = modules.where("file is not null").select("file", F.explode("imports").alias("i")).select("file", F.regexp_extract(F.trim("i"), r"^(?:from|import)\s+(\.*[\w./:-]+)", 1).alias("module"))
    return each.where("module <> ''").distinct().withColumn("first", F.regexp_extract("module", r"^\.*([^.]*)", 1))


def resolve_import(module: str = "module", file: str = "file"):
    """The canonical dotted name of an import: one leading dot is the file's own package, each further dot one above.

    Null if the dots lead above the root.
    """
    level = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    package = F.split(F.regexp_replace(paths.module_name(F.col(file)), r"\.?[^.]*$", ""), r"\.")
    up = F.size(package) - (level - 1)
    prefix = F.array_join(F.slice(package, F.lit(1), F.greatest(up, F.lit(0))), ".")
    rest = F.regexp_replace(module, r"^\.+", "")
    return F.when(level == 0, F.col(module)).when(up < 0, F.lit(None)).otherwise(F.concat_ws(".", F.nullif(prefix, F.lit("")), F.nullif(rest, F.lit(""))))


def call_sites(units: DataFrame) -> DataFrame:
    """``caller, file, callee`` for each distinct call of a unit."""
    return units.where("file_path is not null").select(F.col("unit_id").alias("caller"), F.col("file_path").alias("file"), F.explode("calls").alias("c")).select("caller", "file", F.trim("c").alias("callee")).where("callee <> ''").distinct()


def resolve_calls(units: DataFrame, modules: DataFrame) -> DataFrame:
    """``caller, callee, target, how``: each call with the unit it means.

    A name of the same file comes first, then one of an imported module's file in the repository, then any of the
    repository; ``how`` is file, import, repo or unresolved, the target null in the last case.
    """
    known = symbols(units)
    sites = call_sites(units).withColumn("repo", paths.repo(F.col("file")))

    def keyed(kind: str, name: str) -> DataFrame:
        return known.where(F.col("kind") == kind).select(F.col("key").alias(f"{kind}_key"), F.col("unit_id").alias(name))

    same = sites.withColumn("file_key", F.concat_ws("\x01", "file", "callee")).join(keyed("file", "in_file"), "file_key", "left").drop("file_key")
    # Only calls that the file itself doesn't answer meet the imports.
    open_sites = same.where("in_file is null").drop("in_file")
    through = (
        open_sites.join(imported_modules(modules).select("file", "first").distinct(), "file")
        .withColumn("module_key", F.concat_ws("\x01", "repo", "first", "callee")).join(keyed("module", "by_import"), "module_key")
        .groupBy("caller", "callee").agg(F.min("by_import").alias("by_import"))
    )
    rest = open_sites.join(through, ["caller", "callee"], "left").withColumn("repo_key", F.concat_ws("\x01", "repo", "callee")).join(keyed("repo", "in_repo"), "repo_key", "left")
    answered = same.where("in_file is not null").select("caller", "callee", F.col("in_file").alias("target"), F.lit("file").alias("how"))
    how = F.when(F.col("by_import").isNotNull(), "import").when(F.col("in_repo").isNotNull(), "repo").otherwise("unresolved")
    return answered.unionByName(rest.select("caller", "callee", F.coalesce("by_import", "in_repo").alias("target"), how.alias("how")))


def call_edges(resolved: DataFrame) -> DataFrame:
    """``src, dst`` of the resolved calls, each once."""
    return resolved.where("target is not null").select(F.col("caller").alias("src"), F.col("target").alias("dst")).distinct()


def graph_stats(resolved: DataFrame) -> DataFrame:
    file = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    intra = file(F.col("caller")) == file(F.col("target"))
    return resolved.agg(F.count("*").alias("n_calls"), F.count("target").alias("n_resolved"), F.count_if(intra).alias("n_intra_file"), F.count_if(~intra).alias("n_cross_file"), F.count_if(F.col("target").isNull()).alias("n_unresolved"))


def direct_impact(edges: DataFrame) -> DataFrame:
    """``dst, n_callers, n_files`` of each called unit: distinct callers and their files."""
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("n_callers"), F.countDistinct(F.split_part("src", F.lit(":"), F.lit(1))).alias("n_files"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """``start, node, depth``: the nodes that can be reached from each start along src -> dst within so many steps, or in
    any number of steps without a bound, with the fewest steps; the start itself has 0.

    One join a step; only new pairs go on, and the lineage is cut after each step. Cycles end by themselves.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    frontier = cut(seeds.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    found = frontier
    for step in count(1) if depth is None else range(1, depth + 1):
        following = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(following.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        found = found if step % FOLD else cut(found)
    return found


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def file_edges(resolved: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """``src, dst, via`` between files: calls across files, and imports of a module whose name is a file's stem in the
    same repository."""
    part = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    calls = resolved.where("target is not null").select(part(F.col("caller")).alias("src"), part(F.col("target")).alias("dst")).where("src <> dst").distinct().withColumn("via", F.lit("call"))
    targets = files.where("path is not null").select("path").distinct().select(F.col("path").alias("dst"), paths.repo(F.col("path")).alias("repo"), paths.stem(F.col("path")).alias("first"))
    imports = imported_modules(modules).select(F.col("file").alias("src"), paths.repo(F.col("file")).alias("repo"), "first").distinct().join(targets, ["repo", "first"]).where("src <> dst").select("src", "dst", F.lit("import").alias("via"))
    return calls.unionByName(imports)


def compact_calls(modules: DataFrame) -> DataFrame:
    """``file, caller, callees``: a module's calls with the callees in their order, repetitions kept."""
    pairs = modules.where("file is not null").select("file", F.explode("calls").alias("caller", "list")).distinct()
    return pairs.select("file", "caller", F.array_join("list", ",").alias("callees"))
