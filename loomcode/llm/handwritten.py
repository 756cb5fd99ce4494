"""Hand-written source apart from generated, minified, vendored and data files.

Files with the same informative lines form one class. An inverted index from line hashes to classes gives each line's
rarity and repositories. A class can be contained in a class of another repository only if enough of its weight stands in
lines of other repositories, and only if its rarest lines, beyond the weight that may be missing, lead to the other: both
bounds lose nothing, so the pairs that are left are compared exactly. Lines that many classes hold lead to a bucket of their
holders first; only classes that this leaves open meet all holders.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcode.functions.arrow import map_lists
from loomcode.llm import provenance
from loomcode.session import cut, spread

MIN_LINE = 20
MIN_SHARED = 3
CONTAINMENT = 0.6
#: The shared lines' rarity in nats must exceed log(classes) by so much: less than one file in twenty then shares them by chance.
MARGIN = 3.0
#: Lines of up to so many classes lead to all their holders at once, others to buckets of about so many.
RARE = 32


def _repo(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def line_sets(files: DataFrame) -> DataFrame:
    """``file, repo, sig, lines`` for each distinct content of a file: its informative lines, and all of them in one, as
    64-bit hashes. Files without such a line have no row."""
    lines = F.filter(F.transform(F.split("content", "\r?\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= MIN_LINE) & x.rlike(r"\w.*\s.*\w"))
    hashed = files.select(F.xxhash64("path").alias("file"), F.xxhash64(_repo(F.col("path"))).alias("repo"), F.array_sort(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("lines"))
    return hashed.where(F.size("lines") > 0).select("file", "repo", F.xxhash64("lines").alias("sig"), "lines")


def contained_copies(files: DataFrame, containment: float = CONTAINMENT, rare: int = RARE) -> DataFrame:
    """``file, shared, containment`` of the files (as hashes of their paths) whose lines, by rarity, mostly stand in one file
    of another repository. Files within a repository are not compared.

    The rarity of a line is log(classes / classes that have it), so identical copies, however many, make no line common.
    """
    sets = cut(line_sets(files).dropDuplicates(["file", "sig"]))
    classes = cut(sets.groupBy("sig").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.first("lines").alias("lines")))
    n = classes.count()
    most, least = math.log(max(2, n)), math.log(max(2, n)) + MARGIN
    index = classes.select("sig", "lo", "hi", F.explode("lines").alias("line"))
    # Lines of one class need no row here: nobody shares them, and their weight is the greatest.
    common = index.groupBy("line").agg(F.count("*").alias("df"), (F.min("lo") != F.max("hi")).alias("abroad")).where("df > 1")
    weight = F.when(F.col("df").isNull(), F.lit(most)).otherwise(F.lit(most) - F.log("df"))
    weighed = index.join(common, "line", "left").select("sig", "lo", "hi", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "line", weight.alias("weight"), F.coalesce("abroad", F.lit(False)).alias("abroad")).alias("x"))
    abroad = F.when(F.col("x.abroad"), F.col("x.weight")).otherwise(0.0)
    bounds = weighed.groupBy("sig", "lo", "hi").agg(F.sum("x.weight").alias("own"), F.sum(abroad).alias("abroad"), F.count_if("x.abroad").alias("n_abroad"), F.count("*").alias("n"), F.collect_list("x").alias("items"))
    spans = F.col("lo") != F.col("hi")
    possible = F.when(spans, (F.col("n") >= MIN_SHARED) & (F.col("own") >= least)).otherwise((F.col("n_abroad") >= MIN_SHARED) & (F.col("abroad") >= least) & (F.col("abroad") >= containment * F.col("own")))
    candidates = cut(bounds.where(possible).select("sig", "lo", spans.alias("spans"), "own", "n", "items"))
    whole = candidates.where("spans").select("sig", F.col("n").alias("shared"), F.lit(1.0).alias("containment"))
    items = candidates.where("not spans").select("sig", "lo", "own", F.explode("items").alias("x")).select("sig", "lo", "own", "x.*")
    # A class that holds ``containment`` of the weight holds one of the rarest lines that make up more than the rest.
    before = F.sum("weight").over(Window.partitionBy("sig").orderBy("df", "line")) - F.col("weight")
    probes = cut(items.withColumn("before", before).where((F.col("before") <= (1 - containment) * F.col("own") + 1e-9) & F.col("abroad")).select("sig", "lo", "line", "df"))
    holders = index.select(F.col("sig").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "line")
    bucket = lambda sig, df: F.when(df > rare, F.pmod(F.xxhash64(sig, F.col("line")), F.ceil(df / rare))).otherwise(0)
    sized = holders.join(common.select("line", "df"), "line").withColumn("bucket", bucket(F.col("other"), F.col("df"))).drop("df")
    foreign = "sig <> other and (lo2 <> lo or hi2 <> lo)"
    near = probes.withColumn("bucket", bucket(F.col("sig"), F.col("df"))).join(sized, ["line", "bucket"]).where(foreign).select("sig", "other").distinct()

    def compare(pairs: DataFrame) -> DataFrame:
        both = pairs.join(items.select("sig", "own", "line", "weight"), "sig").join(index.select(F.col("sig").alias("other"), "line"), ["other", "line"])
        met = both.groupBy("sig", "other").agg(F.count("*").alias("shared"), F.sum("weight").alias("weight"), F.first("own").alias("own"))
        kept = met.where((F.col("shared") >= MIN_SHARED) & (F.col("weight") >= least) & (F.col("weight") >= containment * F.col("own")))
        return kept.groupBy("sig").agg(F.max_by("shared", "weight").alias("shared"), F.max(F.col("weight") / F.col("own")).alias("containment"))

    decided = cut(compare(near))
    rest = probes.where(F.col("df") > rare).join(decided, "sig", "left_anti")
    far = compare(rest.join(holders, "line").where(foreign).select("sig", "other").distinct())
    return sets.join(whole.unionByName(decided).unionByName(far), "sig").groupBy("file").agg(F.max("shared").alias("shared"), F.max("containment").alias("containment"))


def not_handwritten(files: DataFrame) -> DataFrame:
    """``path, kind, evidence`` of each file that is not written by hand in its own project.

    Copies across repositories come first (kind ``third_party``, evidence ``containment``); the other files are judged by
    path, header comments and token composition. Null content counts as empty, rows without a path are left out, repeated
    rows count once. Copies of one text inside one repository are no sign of a foreign origin.
    """
    rows = files.where("path is not null").select("path", "content")
    found = contained_copies(rows).select("file")
    copies = files.where("path is not null").select("path", F.xxhash64("path").alias("file")).join(found, "file", "left_semi").select("path").distinct()

    def judge(paths: list, texts: list) -> list:
        out = []
        for p, t in zip(paths, texts, strict=True):
            kind, evidence = provenance.classify(p, t)
            if kind:
                out.append((p, kind, evidence))
        return out

    ruled = map_lists(spread(rows), judge, "path string, kind string, evidence string").dropDuplicates(["path"])
    return (
        copies.select("path", F.lit("third_party").alias("copy_kind"))
        .join(ruled, "path", "full")
        .select("path", F.coalesce("copy_kind", "kind").alias("kind"), F.when(F.col("copy_kind").isNotNull(), "containment").otherwise(F.col("evidence")).alias("evidence"))
    )


def handwritten(files: DataFrame) -> DataFrame:
    """The rows of the files that remain."""
    return files.join(not_handwritten(files).select("path"), "path", "left_anti")


def origin_counts(files: DataFrame) -> DataFrame:
    """``repo, kind, n_files`` with ``handwritten`` for the files that remain."""
    kinds = not_handwritten(files).select("path", "kind")
    return (
        files.where(F.col("path").isNotNull()).select("path").distinct().join(kinds, "path", "left")
        .groupBy(_repo(F.col("path")).alias("repo"), F.coalesce("kind", F.lit("handwritten")).alias("kind"))
        .agg(F.count("*").alias("n_files"))
    )
