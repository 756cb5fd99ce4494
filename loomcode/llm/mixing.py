"""Mixing sources to target weights by pivotal dependent rounding.

Each record of a source gets the same number of copies, a fraction. Its whole part is sure; the rest is rounded so that
the source's total size is kept: two fractional records meet and mass, weighted by size, moves from one to the other
until one of them is 0 or 1. Buckets of records are rounded apart and leave at most one fractional record each; these
meet in the next level of a reduction tree, until one record of a source is left and is rounded by chance.
"""

from __future__ import annotations

import base64
import math
import zlib
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcode.functions.arrow import map_lists
from loomcode.session import cut, parallelism, spread

#: Records in a bucket of the first level, and buckets that meet in one of the next.
BUCKET, FAN_IN = 4096, 256
#: Fixed value: the split pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.tiktoken"
_DRAWN = "mix string, source string, doc_id bigint, tokens bigint, whole bigint, p double, bucket bigint"


def _encoder(path: str | None):
    import tiktoken

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def record_sizes(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, source, tokens`` of the records whose source, in lower case and trimmed, is in a mix.

    ``vocabulary`` is the path of a ranks file of a public tokenizer. Null and empty texts have no size and are left out,
    as are rows without an id; texts are measured whole.
    """
    wanted = targets.select(F.lower(F.trim("source")).alias("source")).where("source is not null").distinct()
    rows = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text")
    rows = spread(rows.join(wanted, "source", "left_semi").select("doc_id", "source", "text"))
    held: list = []

    def measure(ids: list, sources: list, texts: list) -> list:
        if not held:
            held.append(_encoder(vocabulary))
        encode = held[0].encode_ordinary
        return [(i, s, len(encode(t))) for i, s, t in zip(ids, sources, texts, strict=True)]

    return map_lists(rows, measure, "doc_id bigint, source string, tokens bigint").where("tokens > 0")


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix, source, target_share, max_repeats, n_records, size, total, wanted, copies, short`` for each target.

    ``total`` is the size of all records of the mix's sources taken once, ``wanted`` the source's share of it, ``copies``
    how often each record is used. Targets without a mix, a source or a share are left out; a null limit means once.
    """
    t = targets.where("mix is not null and source is not null and target_share is not null").select("mix", F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    t = t.dropDuplicates(["mix", "source"])
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("tokens").alias("size"))
    known = t.join(by_source, "source", "left").fillna(0, ["n_records", "size"])
    return (
        known.withColumn("total", F.sum("size").over(Window.partitionBy("mix")))
        .withColumn("wanted", F.col("target_share") * F.col("total"))
        .withColumn("short", F.col("wanted") > F.col("max_repeats") * F.col("size"))
        .withColumn("copies", F.when(F.col("size") > 0, F.least(F.col("wanted") / F.col("size"), F.col("max_repeats").cast("double"))).otherwise(0.0))
        .select("mix", "source", "target_share", "max_repeats", "n_records", "size", "total", "wanted", "copies", "short")
    )


def _uniform(seed: int, *key: object):
    """A stream of numbers in [0, 1) that depends on the key alone, so a task that runs again draws the same."""
    import numpy as np

    return np.random.Generator(np.random.PCG64([seed, zlib.crc32(repr(key).encode())]))


def pivot(sizes: list[int], ps: list[float], draw) -> list[float]:
    """Rounds the probabilities in turn; all but at most one become 0 or 1, and the sum of size times p stays."""
    out = list(ps)
    held = -1
    for k, p in enumerate(out):
        if not 0.0 < p < 1.0:
            continue
        if held < 0:
            held = k
            continue
        a, b = held, k
        up = min((1.0 - out[a]) * sizes[a], out[b] * sizes[b])
        down = min(out[a] * sizes[a], (1.0 - out[b]) * sizes[b])
        move = up if draw() * (up + down) < down else -down
        out[a] += move / sizes[a]
        out[b] -= move / sizes[b]
        for x in (a, b):
            if out[x] < 1e-9:
                out[x] = 0.0
            elif out[x] > 1.0 - 1e-9:
                out[x] = 1.0
        held = a if 0.0 < out[a] < 1.0 else b if 0.0 < out[b] < 1.0 else -1
    return out


def _meeting(seed: int, depth: int, last: bool):
    """Rounds one bucket; in the last level the record that stays fractional is rounded by chance."""

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")  # what stays fractional is small
        stream = _uniform(seed, depth, group["mix"].iat[0], group["source"].iat[0], int(group["bucket"].iat[0]))
        rounded = pivot(group["tokens"].tolist(), group["p"].tolist(), stream.random)
        if last:
            rounded = [p if p in (0.0, 1.0) else float(stream.random() < p) for p in rounded]
        return group.assign(p=rounded)

    return meet


@dataclass
class Mix:
    """``draws`` has ``mix, source, doc_id, copies, tokens`` of the records used at least once; ``plan`` the targets."""

    draws: DataFrame
    plan: DataFrame


def draw(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str | None = None) -> Mix:
    """Draws every mix. The same input and seed give the same draw, in any partitioning."""
    sizes = cut(record_sizes(documents, targets, vocabulary))
    planned = cut(plan(sizes, targets))
    largest = planned.agg(F.max("n_records")).first()[0] or 0
    buckets = max(1, math.ceil(largest / BUCKET))
    # The targets are a few rows for each mix; Spark broadcasts them if their size allows it.
    use = planned.where("copies > 0").select("mix", "source", "copies", F.greatest(F.lit(1), F.ceil(F.col("n_records") / BUCKET)).alias("buckets"))
    level = (
        sizes.join(use, "source")
        .withColumn("whole", F.floor("copies"))
        .withColumn("p", F.col("copies") - F.col("whole"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
        .select("mix", "source", "doc_id", "tokens", F.col("whole").cast("bigint").alias("whole"), "p", "bucket")
    )
    done: list[DataFrame] = [level.where("p = 0")]
    level, depth = level.where("p > 0"), 0
    while True:
        last = buckets == 1

        # A given number of partitions, so that small buckets are not merged into one task.
        parts = min(max(2 * parallelism(level.sparkSession), int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))), buckets * planned.count())
        rounded = cut(level.repartition(max(1, parts), "mix", "source", "bucket").groupBy("mix", "source", "bucket").applyInPandas(_meeting(seed, depth, last), _DRAWN))
        done.append(rounded.where("p = 0 or p = 1"))
        if last:
            break
        buckets, depth = math.ceil(buckets / FAN_IN), depth + 1
        level = rounded.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("bigint"))
    draws = reduce(DataFrame.unionByName, done).withColumn("copies", F.col("whole") + F.col("p").cast("bigint")).where("copies > 0")
    return Mix(draws.select("mix", "source", "doc_id", "copies", "tokens"), planned)


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str | None = None) -> DataFrame:
    """``mix, source, target_share, actual_share, drawn_tokens, n_drawn, max_copies, wanted_tokens, short`` for each target."""
    mixed = draw(documents, targets, seed, vocabulary)
    drawn = mixed.draws.groupBy("mix", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("drawn_tokens"), F.count("*").alias("n_drawn"), F.max("copies").alias("max_copies"))
    joined = mixed.plan.join(drawn, ["mix", "source"], "left").fillna(0, ["drawn_tokens", "n_drawn", "max_copies"])
    whole = F.sum("drawn_tokens").over(Window.partitionBy("mix"))
    return joined.select(
        "mix", "source", "target_share", F.round(F.col("drawn_tokens") / F.nullif(whole, F.lit(0)), 6).alias("actual_share"), "drawn_tokens", "n_drawn", "max_copies", F.round("wanted", 3).alias("wanted_tokens"), "short",
    )


def short_sources(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix, source`` of the sources that cannot reach their share: all their records at the limit are drawn and fall short."""
    return mix_report(documents, targets).where("short and drawn_tokens < wanted_tokens").select("mix", "source")
