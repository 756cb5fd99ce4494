"""Source files that do not parse: the verdict for each file, and rates for each repository and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcode.functions.arrow import map_lists
from loomcode.llm import syntax
from loomcode.session import spread


def judge_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row for each input row: ``path, broken, cause, found_language, violation``.

    Null or empty content and paths without a known extension are not broken; a byte order mark and CRLF are no fault.
    Only the two named columns are read, so further columns of any name do no harm.
    """

    def judge(paths: list, texts: list) -> list:
        return [(p, *syntax.judge(t, p)) for p, t in zip(paths, texts, strict=True)]

    rows = spread(files.select(F.col(path).alias("path"), F.col(content).alias("content")))
    return map_lists(rows, judge, "path string, broken boolean, cause string, found_language string, violation string")


def extension_language(path: Column) -> Column:
    """The language of the extension, or null."""
    pairs = [F.lit(x) for kv in sorted(syntax.EXTENSIONS.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def broken_paths(files: DataFrame) -> DataFrame:
    """Distinct paths of the files that are not valid for the language of their extension."""
    return judge_files(files).where("broken").select("path").distinct()


def broken_rates(files: DataFrame, modules: DataFrame) -> DataFrame:
    """``repo, language, n_files, n_broken, n_wrong_extension, broken_rate`` over distinct paths.

    The language is the module table's ``lang`` where it has one for the file, else that of the extension, else
    ``unknown``; rows of one path count once, as broken if any of them is.
    """
    verdicts = (
        judge_files(files)
        .where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.max("broken").alias("broken"), F.max(F.col("cause") == "wrong_extension").alias("wrong"))
    )
    langs = modules.where(F.trim("lang") != "").groupBy(F.col("file").alias("path")).agg(F.min(F.lower(F.trim("lang"))).alias("lang"))
    return (
        verdicts.join(langs, "path", "left")
        .withColumn("repo", F.split_part("path", F.lit("/"), F.lit(1)))
        .withColumn("language", F.coalesce("lang", extension_language(F.col("path")), F.lit("unknown")))
        .groupBy("repo", "language")
        .agg(
            F.count("*").alias("n_files"),
            F.count_if("broken").alias("n_broken"),
            F.count_if("wrong").alias("n_wrong_extension"),
        )
        .withColumn("broken_rate", F.round(F.col("n_broken") / F.col("n_files"), 6))
    )
