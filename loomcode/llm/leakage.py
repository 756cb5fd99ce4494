"""Evaluation passages inside training text.

The items' words form a BM25 inverted index with block maxima. It goes to every task in parts of a checked size, each with
the items of one hash block; every part meets all documents.
Each document is cut into passages at the words that no item has, long ones again so that they overlap by one word less
than the length of a match: every match lies whole in one passage. Each passage queries the index by block-max WAND. The threshold of an item is the smallest score that
any of its own windows of that length gives, so no passage that holds one can fall below it. What is retrieved is then
checked word by word.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from functools import reduce
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcode.functions.arrow import map_lists
from loomcode.session import spread

RUN = 13
PASSAGE = 64
BLOCK = 16
K1, B = 1.2, 0.75
#: Bytes of item text in one part of the index, and how far a part may exceed them by the luck of the hashes.
PART_BYTES, PART_EXCESS = 8 << 20, 4
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall(text.lower()) if text else []


class ItemIndex:
    """Postings by word with scores precomputed, split into blocks with their largest score."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN) -> None:
        self.run = run
        kept = [(i, w) for i, w in ((i, words(t)) for i, t in sorted(items)) if len(w) >= run]
        self.ids = [i for i, _ in kept]
        self.stretch = re.compile(f"1{{{run},}}")
        self.texts = [" " + " ".join(w) + " " for _, w in kept]
        n = max(1, len(kept))
        average = sum(len(w) for _, w in kept) / n or 1
        counts: dict[str, dict[int, int]] = {}
        for slot, (_, w) in enumerate(kept):
            for x in w:
                counts.setdefault(x, {})[slot] = counts.get(x, {}).get(slot, 0) + 1
        weight: dict[str, dict[int, float]] = {}
        for x, tf in counts.items():
            idf = log(1 + (n - len(tf) + 0.5) / (len(tf) + 0.5))
            weight[x] = {s: idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(kept[s][1]) / average)) for s, f in tf.items()}
        self.postings: dict[str, tuple[array, array, array, array, float]] = {}
        for x, ws in weight.items():
            slots = sorted(ws)
            values = [ws[s] for s in slots]
            last = [slots[min(k + BLOCK, len(slots)) - 1] for k in range(0, len(slots), BLOCK)]
            maxima = [max(values[k : k + BLOCK]) for k in range(0, len(slots), BLOCK)]
            self.postings[x] = (array("i", slots), array("d", values), array("i", last), array("d", maxima), max(maxima))
        self.top = {x: p[4] for x, p in self.postings.items()}
        # The sum over a window's distinct words, which is what a passage that holds the window scores at least.
        self.threshold = [min(sum(weight[x][s] for x in set(w[k : k + run])) for k in range(len(w) - run + 1)) - 1e-9 for s, (_, w) in enumerate(kept)]
        self.least = min(self.threshold, default=float("inf"))

    def retrieve(self, terms: list[str]) -> list[int]:
        """Slots of the items whose score for the distinct terms reaches the item's threshold, by block-max WAND."""
        cursors = [[self.postings[x], 0] for x in terms]
        found = []
        while True:
            cursors = [c for c in cursors if c[1] < len(c[0][0])]
            cursors.sort(key=lambda c: c[0][0][c[1]])
            bound, pivot = 0.0, None
            for k, (p, _) in enumerate(cursors):
                bound += p[4]
                if bound >= self.least:
                    pivot = k
                    break
            if pivot is None:
                return found
            slot = cursors[pivot][0][0][cursors[pivot][1]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][0][cursors[pivot + 1][1]] == slot:
                pivot += 1
            block_bound, ends = 0.0, []
            for p, _ in cursors[: pivot + 1]:
                b = self._block(p[2], slot)
                if b < len(p[2]):
                    block_bound += p[3][b]
                    ends.append(p[2][b])
            if block_bound >= self.least:
                if cursors[0][0][0][cursors[0][1]] == slot:
                    score = 0.0
                    for c in cursors[: pivot + 1]:
                        score += c[0][1][c[1]]
                        c[1] += 1
                    if score >= self.threshold[slot]:
                        found.append(slot)
                else:
                    for c in cursors[:pivot]:
                        self._seek(c, slot)
            else:
                # No item up to the nearest block end can reach the threshold with these terms.
                target = min(ends) + 1 if ends else slot + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0][0][cursors[pivot + 1][1]])
                target = max(target, slot + 1)
                for c in cursors[: pivot + 1]:
                    self._seek(c, target)

    @staticmethod
    def _block(last: list[int], slot: int) -> int:
        return bisect_right(last, slot - 1)

    @staticmethod
    def _seek(cursor: list, slot: int) -> None:
        cursor[1] = bisect_right(cursor[0][0], slot - 1, cursor[1])

    def leaks(self, text: str | None) -> set[int]:
        """Ids of the items of which the text holds a run of words."""
        w = words(text)
        run, step, top = self.run, PASSAGE - self.run + 1, self.top
        if len(w) < run or not self.ids:
            return set()
        out: set[int] = set()
        # A word of no item ends a passage: no match can hold it. What stays is cut so that every match lies in one piece.
        indexed = "".join(["1" if x in top else "0" for x in w])
        for at, stop in ((k, min(k + PASSAGE, m.end())) for m in self.stretch.finditer(indexed) for k in range(m.start(), m.end() - run + 1, step)):
            passage = w[at:stop]
            terms = [x for x in dict.fromkeys(passage) if x in top]
            if sum(top[x] for x in terms) < self.least:
                continue
            slots = [s for s in self.retrieve(terms) if self.ids[s] not in out]
            if slots:
                grams = [f" {' '.join(passage[k : k + run])} " for k in range(len(passage) - run + 1)]
                out.update(self.ids[s] for s in slots if any(g in self.texts[s] for g in grams))
        return out


def leaked(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Distinct ``item_id, doc_id``: at least ``run`` successive words of the item stand in the document without a gap.

    Words are runs of letters and digits without regard to case. Null, empty and shorter texts hold no run; rows without
    an id are left out. A set of items of any size is searched in parts: one pass over the documents for each
    ``PART_BYTES`` of item text.
    """
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    largest = blocks.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > PART_EXCESS * PART_BYTES:
        raise ValueError(f"one part of the items has {largest} bytes: a single item is too long for the index")
    rows = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    found = [_search(rows, blocks.where(F.col("block") == k).drop("block"), run) for k in range(parts)]
    return reduce(DataFrame.unionByName, found).distinct()


def _search(rows: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """``item_id, doc_id`` of one part of the items, whose size is checked."""
    held = rows.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])
    index: list[ItemIndex] = []

    def search(ids: list, texts: list) -> list:
        if not index:
            index.append(ItemIndex(held.value, run))
        return [(item, doc) for doc, text in zip(ids, texts, strict=True) for item in index[0].leaks(text)]

    return map_lists(rows, search, "item_id bigint, doc_id bigint")


def word_runs(df: DataFrame, key: str, run: int = RUN) -> DataFrame:
    """``key, gram`` for each run of words; the run as text."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    with_words = df.where("text is not null").select(key, w.alias("w")).where(F.size("w") >= run)
    starts = F.sequence(F.lit(1), F.size("w") - run + 1)
    return with_words.select(key, F.explode(F.array_distinct(F.transform(starts, lambda k: F.array_join(F.slice("w", k, run), " ")))).alias("gram"))


def leaked_by_join(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """The same result by an equi-join of all word runs: what the index is compared with."""
    return word_runs(items, "item_id", run).join(word_runs(documents, "doc_id", run), "gram").select("item_id", "doc_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``suite, n_items, n_leaked_items, n_documents`` for each suite of test items."""
    pairs = leaked(documents, items)
    return (
        items.select("item_id", F.coalesce("suite", F.lit("unknown")).alias("suite")).distinct().join(pairs, "item_id", "left")
        .groupBy("suite").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("n_leaked_items"), F.countDistinct("doc_id").alias("n_documents"))
    )
