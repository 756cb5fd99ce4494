"""What the flow queries write besides their result, and steps of many functions in many partitions."""

from __future__ import annotations

import os
import random
from pathlib import Path

import pytest

from loomcode.functions.arrow import map_runs
from loomcode.operators import flow
from loomcode.plans import catalogue

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def _written(spark) -> int:
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def _input() -> int:
    return sum(os.path.getsize(f"{SMALL}/{t}.parquet") for t in ("files", "code_functions"))


@needs_data
@pytest.mark.parametrize("name", ["reaching_defs", "slice_backward", "slice_source"])
def test_less_than_the_input_is_kept(spark, name):
    before = _written(spark)
    assert catalogue.QUERIES[name](spark, SMALL).count()
    assert _written(spark) - before < _input()


def _graphs(n: int) -> list[tuple[str, list, list, list]]:
    """Functions with edges and references at random, among them loops and lines that define two variables."""
    rng, out = random.Random(7), []
    for k in range(n):
        lines = range(1, rng.randint(3, 12))
        edges = sorted({(x, rng.choice([0, *lines])) for x in lines for _ in range(2)} | {(x, x + 1) for x in lines[:-1]})
        refs = sorted({(rng.choice("abc"), rng.choice(lines), rng.random() < 0.5) for _ in range(12)})
        out.append((f"f{k}", edges, refs, lines))
    return out


def _reaching(edges, refs):
    found = set()
    for var, line in {(v, x) for v, x, is_def in refs if is_def}:
        ahead, seen = [line], set()
        while ahead:
            at = ahead.pop()
            if at == line and not seen or (var, at, True) not in refs:
                fresh = {d for s, d in edges if s == at and d} - seen
                seen |= fresh
                ahead += fresh
        found |= {(var, line, use) for v, use, is_def in refs if not is_def and v == var and use in seen}
    return found


def test_reaching_definitions_in_partitions(spark, rows):
    """As by steps on each function, over a union of two exchanges; nothing is written on the way."""
    graphs = _graphs(300)
    edges = spark.createDataFrame([(f, s, d, "unconditional") for f, e, _, _ in graphs for s, d in e], "func string, src int, dst int, edge string")
    refs = spark.createDataFrame([(f, *r) for f, _, rs, _ in graphs for r in rs], "func string, var string, line_no int, is_def boolean")
    before = _written(spark)
    found = rows(flow.reaching_definitions(edges.repartition("func").distinct(), refs.repartition("func").distinct()))
    assert _written(spark) == before
    assert found == sorted(((f, *x) for f, e, rs, _ in graphs for x in _reaching(e, rs)), key=repr)


def test_definitions_of_many_variables():
    """More definitions than a part holds: each use finds those of its own variable."""
    n = 150
    lines = [*range(1, 2 * n), *range(1, n + 1), *range(n + 1, 2 * n + 1)]
    targets = [*range(2, 2 * n + 1), *[-1] * n, *[-2] * n]
    names = [None] * (2 * n - 1) + [f"v{k}" for k in range(n)] * 2
    whole = sorted(flow._reached("f", lines, targets, names))
    state, flow.STATE = flow.STATE, 1
    try:
        parts = sorted(flow._reached("f", lines, targets, names))
    finally:
        flow.STATE = state
    assert whole == parts == sorted(("f", f"v{k}", k + 1, n + k + 1) for k in range(n))


def test_runs_over_batches(spark, rows):
    """A key of more rows than a batch stays one run; more rows out than a batch come back in several."""
    table = spark.range(30_000).selectExpr("if(id < 25000, 'a', cast(id % 7 as string)) as k", "id as n")
    assert rows(map_runs(table, "k", lambda k, n: [(k, len(n), sum(n))], "k string, rows bigint, total bigint")) == sorted((tuple(r) for r in table.groupBy("k").agg({"n": "count", "*": "count"}).select("k", "count(n)").join(table.groupBy("k").sum("n"), "k").collect()), key=repr)
    assert map_runs(table, "k", lambda k, n: ((k, x) for x in n), "k string, n bigint").count() == 30_000
    assert map_runs(table.where("false"), "k", lambda k, n: [(k,)], "k string").count() == 0


def test_slices_in_partitions(spark, rows):
    """As by steps on each function, forward and backward from several lines; nothing is written on the way."""
    graphs = _graphs(300)
    edges = spark.createDataFrame([(f, s, d, "data", "x") for f, e, _, _ in graphs for s, d in e], "func string, src int, dst int, dep string, label string")
    criteria = spark.createDataFrame([(f, x) for f, _, _, lines in graphs for x in lines[-2:]], "func string, line_no int")
    for backward in (True, False):
        before = _written(spark)
        found = rows(flow.slices(edges.repartition("func").distinct(), criteria.repartition("func").distinct(), backward))
        assert _written(spark) == before
        expected = set()
        for f, e, _, lines in graphs:
            for start in lines[-2:]:
                seen, ahead = {start}, [start]
                while ahead:
                    at = ahead.pop()
                    fresh = {(s if backward else d) for s, d in e if (d if backward else s) == at} - seen
                    seen |= fresh
                    ahead += fresh
                expected |= {(f, start, x) for x in seen}
        assert found == sorted(expected, key=repr)


def test_slice_of_the_last_line():
    """A use depends on the last definition above it, not on one of its own line; a block on the line that holds it."""
    rows = [(1, 0, None), (2, 1, None), (3, 1, None), (4, 3, None), (5, 1, None), (1, -1, "n"), (2, -1, "x"), (4, -1, "x"), (4, -2, "x"), (5, -2, "x"), (3, -2, "y")]
    assert sorted(flow._sliced_last("f", *map(list, zip(*rows, strict=True)))) == [("f", 5, k) for k in (1, 2, 3, 4, 5)]
    rows = [r for r in rows if r[0] != 4]
    assert sorted(flow._sliced_last("f", *map(list, zip(*rows, strict=True)))) == [("f", 5, k) for k in (1, 2, 5)]
