"""Regular-expression search over lines, with position, context, limits and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line``: one row for each line, counted from 1; CRLF and LF both end a line.

    A null text has no line, an empty one a single empty line; lines of any length are kept whole.
    """
    return df.select(F.col(key), F.posexplode(F.split(text, "\r?\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def grep(table: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """The lines that match, with ``col`` (characters before the first match) and ``matched``.

    Raises ValueError for an empty pattern. Only the first match of a line counts.
    """
    if not pattern:
        raise ValueError("empty pattern")
    p = pattern if case_sensitive else f"(?i){pattern}"
    return table.where(F.col("line").rlike(p)).withColumn("col", F.expr("regexp_instr(line, {p})".format(p=_literal(p))) - 1).withColumn("matched", F.regexp_extract("line", p, 0))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def grep_context(table: DataFrame, key: str, pattern: str, around: int = 2, case_sensitive: bool = False) -> DataFrame:
    """As :func:`grep`, with ``context``: up to ``around`` lines before, the line itself, and as many after."""
    window = Window.partitionBy(key).orderBy("line_no").rowsBetween(-around, around)
    p = pattern if case_sensitive else f"(?i){pattern}"
    # Only keys with a match are sorted for their context.
    hits = table.where(F.col("line").rlike(p)).select(key).distinct()
    around_lines = table.join(hits, key, "left_semi").withColumn("context", F.array_join(F.collect_list("line").over(window), "\n"))
    return grep(around_lines, pattern, case_sensitive)


def match_counts(matches: DataFrame, key: str) -> DataFrame:
    """``key, n_matches, first_line`` for each key with a match."""
    return matches.groupBy(key).agg(F.count("*").alias("n_matches"), F.min("line_no").alias("first_line"))


def first_matches(matches: DataFrame, key: str, limit: int) -> DataFrame:
    """The first matches in the order of key and line: a top-n, not a full sort."""
    return matches.orderBy(key, "line_no").limit(limit)


def line_ranges(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """``key, ranges``: runs of successive numbers as text, such as ``1-3, 7``. Repeated and null numbers count once and not at all."""
    distinct = numbers.where(F.col(number).isNotNull()).select(key, F.col(number).alias("n")).distinct()
    islands = distinct.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy(key).orderBy("n")))
    runs = islands.groupBy(key, "island").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    text = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high"))
    parts = F.array_sort(F.collect_list(F.struct("low", text.alias("text"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["text"]), ", ").alias("ranges"))
