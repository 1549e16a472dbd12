"""Span enumeration against a brute-force model, and the two paths of the column form."""

import itertools

import pytest
from pyspark.sql import functions as F

from patternloom.operators.segment import cell_segments, segment, segments
from patternloom.plans.ast import Element

V = lambda n, **k: Element("variable", n, **k)
L = lambda t, **k: Element("literal", t, **k)


def model(words, elements):
    """Tilings of the words by spans, strict elements only."""
    n, out = len(words), []
    for cuts in itertools.product(range(n + 1), repeat=len(elements)):
        at, values, ok = 0, [], True
        for e, size in zip(elements, cuts, strict=True):
            part = words[at : at + size]
            if len(part) != size or (size == 0 and not e.optional) or (e.kind == "literal" and size and part != e.text.split()):
                ok = False
                break
            at += size
            if e.kind == "variable":
                values.append([[w] for w in part] or None)
        if ok and at == n:
            out.append(values)
    return sorted(map(repr, out))


@pytest.mark.parametrize("elements", [
    (V("a"),), (V("a"), V("b")), (V("a"), L("x"), V("b")), (L("x y"),), (V("a", optional=True), L("x")), (L("x"), V("a"), V("b")), (V("a"), L("x", optional=True), V("b")),
], ids=str)
@pytest.mark.parametrize("words", [[], ["x"], ["p", "x"], ["p", "x", "q"], ["x", "x", "y", "x"], ["x", "y"]], ids=str)
def test_strict_elements(words, elements):
    slots = [[w] for w in words]
    got = {repr(v) for v, relaxed in segment(slots, slots, tuple(elements)) if relaxed == 0}
    assert got == set(model(words, elements))


def test_all_optional_adds_the_skipped_match():
    got = cell_segments([{"slots": [["a"]], "value": [["a"]]}], (V("x", optional=True),))
    assert ([[["a"]]], 0) in got and ([None], 0) in got


def test_relaxable_leaves_gaps():
    slots = [["big"], ["red"], ["cat"]]
    assert segment(slots, slots, (L("red"), V("x"))) == []
    assert any(r == 1 for _, r in segment(slots, slots, (L("red", relaxable=True), V("x"))))


def test_column_paths_agree(spark):
    alts = "array<struct<slots:array<array<string>>,value:array<array<string>>>>"
    cell = [{"slots": [["a"], ["b"]], "value": [["a"], ["b"]]}, {"slots": [], "value": []}]
    df = spark.createDataFrame([(cell,)], f"c {alts}")
    fast = df.select(segments(F.col("c"), ((V("x"),),))).first()[0]
    slow = df.select(segments(F.col("c"), ((V("x"),), (V("x"),)))).first()[0]
    assert [r["values"] for r in fast] == [[[["a"], ["b"]]]]
    assert {repr(r["values"]) for r in slow} == {repr(r["values"]) for r in fast}


def test_walk_equals_the_python_segmenter(spark):
    """Random cells under random sequences of literals and variables, optional or not, without Python in the plan."""
    import random

    rng = random.Random(3)
    cells = []
    for _ in range(60):
        alternatives = []
        for _ in range(rng.choice([1, 1, 2])):
            words = rng.choices(["p", "x", "y", "q"], k=rng.randrange(6))
            alternatives.append({"slots": [[w, w.upper(), f"pos:{w}"] for w in words], "value": [[w, w + "l"] for w in words]})
        cells.append(alternatives)
    shapes = [(L("x"),), (L("x y"),), (V("a"), L("x"), V("b")), (V("a", optional=True),), (L("x", optional=True), L("y", optional=True))]
    while len(shapes) < 24:
        shapes.append(tuple(V("abc"[k], optional=rng.random() < 0.4) if rng.random() < 0.5 else L(rng.choice(["x", "y", "x y", "pos:q", "X"]), optional=rng.random() < 0.4) for k in range(rng.randrange(1, 4))))
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c array<struct<slots:array<array<string>>,value:array<array<string>>>>")
    for at in range(0, len(shapes), 6):
        part = shapes[at : at + 6]
        got = df.select("k", *(segments(F.col("c"), (s,)).alias(f"s{i}") for i, s in enumerate(part)))
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        for row in got.collect():
            for i, s in enumerate(part):
                # a literal of a pattern is compared in lower case with all that a token is known by
                want = cell_segments(cells[row.k], s)
                assert sorted(repr((x["values"], x["relaxed"])) for x in row[f"s{i}"]) == sorted(map(repr, want)), (cells[row.k], s)


def test_options_are_put_together(spark):
    cell = [{"slots": [["a"], ["b"]], "value": [["a"], ["b"]]}]
    df = spark.createDataFrame([(cell,)], "c array<struct<slots:array<array<string>>,value:array<array<string>>>>")
    got = df.select(segments(F.col("c"), ((V("x"), L("b")), (L("a"),), (V("x"),))).alias("s")).first().s
    assert [r["values"] for r in got] == [[[["a"]]], [[["a"], ["b"]]]]
