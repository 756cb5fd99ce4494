"""Splitting and term counts against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from loomcode.llm import chunking as ch
from loomcode.llm import terms as tm

CONF = "scope string, profile string, chunk_size int, chunk_overlap int, max_context_chunks int"


def _text(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["def f(x):\n    return x\n\n", "ein Wörtchen äöü ", "sentence. ", "\n", "\n\n", "x" * 40, "日本語", "    indented\n", "\r\n\r\n"]
    return "".join(r.choice(parts) for _ in range(n))


def _check(pieces, text: str, size: int, overlap: int) -> None:
    data = text.encode()
    assert pieces[0].start_byte == 0 and pieces[-1].end_byte == len(data)
    assert [p.piece_no for p in pieces] == list(range(len(pieces)))
    for p in pieces:
        assert data[p.start_byte : p.end_byte].decode() == p.text
        assert p.end_byte - p.start_byte <= 4 * size
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert b.end_byte > a.end_byte
        assert 4 * overlap <= a.end_byte - b.start_byte <= 4 * overlap + 3 or b.start_byte == 0


@pytest.mark.parametrize(("size", "overlap", "range_bytes"), [(20, 5, 1 << 18), (20, 5, 300), (16, 0, 257), (50, 25, 1000)])
def test_pieces(spark, size, overlap, range_bytes):
    texts = {f"k{i}": _text(i, 300) for i in range(6)} | {"unbroken": "y" * 3000, "wide": "é" * 2000}
    files = spark.createDataFrame([(k, t, "python") for k, t in texts.items()], "path string, content string, language string")
    config = spark.createDataFrame([("code", "*", size, overlap, 1)], CONF)
    found = defaultdict(list)
    for p in ch.split_items(ch.items(files, "files", "path", "content", "language", config, "code"), range_bytes=range_bytes).collect():
        found[p.item_key].append(p)
    assert set(found) == set(texts)
    for k, pieces in found.items():
        _check(sorted(pieces, key=lambda p: p.piece_no), texts[k], size, overlap)


def test_boundaries():
    data = b"def a():\n    x\n\n    y\n\ndef b():\n    z\n"
    assert ch.boundary(data, 0, len(data) - 1, code=True) == data.index(b"def b")
    assert ch.boundary(b"one two. three", 0, 12, code=False) == 9
    assert ch.boundary("éé".encode(), 0, 3, code=False) == 2


def test_limits_and_edges(spark, rows):
    config = spark.createDataFrame([("code", "*", 2, 1, 1), ("code", "go", 4, 0, 1), ("code", "bad", 0, 0, 1), ("text", "*", 1, 0, 1)], CONF)
    files = spark.createDataFrame([("at", "x" * 11, "py", "e"), ("over", "x" * 12, "py", "e"), ("go", "x" * 19, "go", "e"), ("null", None, None, "e"), ("empty", "", "py", "e"), (None, "x" * 99, "py", "e"), ("over", "x" * 12, "py", "e")], "path string, content string, language string, code string")
    items = ch.items(files, "files", "path", "content", "language", config, "code")
    assert rows(ch.oversized(items).select("item_key").distinct()) == [("over",)]
    assert rows(ch.split_items(items).select("start_byte", "end_byte")) == [(0, 8), (4, 12)]
    assert ch.split_items(items.where("false")).count() == 0
    assert ch.items(files, "f", "path", "content", "language", config.where("false"), "code").count() == 0


def test_overlap_is_kept_or_refused(spark):
    files = spark.createDataFrame([("k", _text(5, 300), "py")], "path string, content string, language string")
    config = spark.createDataFrame([("code", "*", 20, 17, 1)], CONF)
    _check(sorted(ch.split_items(ch.items(files, "files", "path", "content", "language", config, "code")).collect(), key=lambda p: p.piece_no), _text(5, 300), 20, 17)
    bad = spark.createDataFrame([("code", "*", 20, 20, 1)], CONF)
    with pytest.raises(Exception, match="chunk_overlap"):
        ch.split_items(ch.items(files, "files", "path", "content", "language", bad, "code")).collect()
    with pytest.raises(ValueError, match="chunk_overlap"):
        ch.split_files(spark.createDataFrame([], "path string, length bigint"), 20, 20)


def test_no_range_ends_inside_a_word(spark):
    text = "unbroken prose without any line end. " * 400
    files = spark.createDataFrame([("k", text, "en")], "path string, content string, language string")
    config = spark.createDataFrame([("text", "*", 30, 5, 1)], CONF)
    pieces = ch.split_items(ch.items(files, "d", "path", "content", "language", config, "text"), range_bytes=500).collect()
    assert len(pieces) > 100
    assert all(p.text.endswith(" ") for p in pieces)


def test_files_on_disk(spark, tmp_path):
    text = _text(9, 2000)
    place = tmp_path / "big.txt"
    place.write_bytes(text.encode())
    listing = spark.createDataFrame([(str(place), place.stat().st_size)], "path string, length bigint")
    pieces = sorted(ch.split_files(listing, 40, 10, range_bytes=1000).collect(), key=lambda p: p.piece_no)
    _check(pieces, text, 40, 10)


def _brute(data):
    n, records = Counter(), defaultdict(set)
    for r, terms, _ in data:
        for t in terms or []:
            t = t.strip(" ") if t is not None else ""
            if t:
                n[t] += 1
                if r is not None:
                    records[t].add(r)
    return sorted((t, n[t], len(records[t])) for t in n)


@pytest.mark.parametrize("heavy", [1, 3, 256])
def test_terms(spark, rows, heavy):
    r = random.Random(4)
    words = ["hot"] * 30 + [" hot ", "Warm", "warm", None, "", "  "] + [f"t{i}" for i in range(40)]
    data = [(r.choice(["a", "b", "c", None, "hotkey", "hotkey"]) if i % 3 else f"u{i}", [r.choice(words) for _ in range(r.randrange(6))] if i % 11 else None, "x") for i in range(300)]
    df = spark.createDataFrame(data, "unit_id string, dependencies array<string>, term string").repartition(5)
    counted = tm.marked_terms(tm.field_rows(df, "unit_id", "dependencies", "d").unionByName(tm.field_rows(df, "unit_id", "dependencies", "other")), limit=heavy)
    for field in ("d", "other"):
        assert rows(counted.where(f"field = '{field}'").select("term", "n_occurrences", "n_records")) == _brute(data)
    marked = {x.term: x.mark for x in counted.where("field = 'd'").collect()}
    total = len({u for u, _, _ in data if u is not None})
    for t, _, k in _brute(data):
        assert marked[t] == ("rare" if k < 3 else "common" if k > 0.12 * total else None)


def test_no_term_is_heavy(spark, rows):
    df = spark.createDataFrame([(f"u{i}", [f"t{i}", None]) for i in range(50)], "unit_id string, dependencies array<string>")
    every = tm.field_rows(df, "unit_id", "dependencies", "d")
    assert tm.heavy_terms(every) == []
    assert tm.marked_terms(every).where("mark = 'rare' and n_records = 1").count() == 50


def test_no_terms(spark):
    df = spark.createDataFrame([("a", None), ("b", [])], "unit_id string, dependencies array<string>")
    assert tm.marked_terms(tm.field_rows(df, "unit_id", "dependencies", "d")).count() == 0
    assert tm.marked_terms(tm.field_rows(df.where("false"), "unit_id", "dependencies", "d")).count() == 0
