"""Joins of tables that are planned to be large: classes of equal values are compared, not rows, and results stay the same."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patternloom.functions import omni
from patternloom.plans import compile as plans
from patternloom.plans.parser import parse
from patternloom.sources.tablestore import Store, from_rows

SHARED = """inferencepattern a row s=[TABLE:"S", PLACE:<n>] row t=[TABLE:"T", PLACE:<n>, PART:<r>] endinferencepattern
    inferencepattern b row c=[TABLE:"C", PLACE:<n>] row t=[TABLE:"T", PLACE:<n>] endinferencepattern
    inferencepattern ab infpat x = a infpat y = b rowequiv x.t = y.t endinferencepattern"""
THREE = 'inferencepattern p row t=[TABLE:"T", PLACE:<n>, PART:"east"] row s=[TABLE:"S", PLACE:<n>] row c=[TABLE:"C", PLACE:<n>] endinferencepattern'
PLACES = ["red hill", "old red hill", "hills", "hill", "blue lake", "lake"]


def store_of(spark, ways=False, n=40):
    """S and C hold a place a row, most often the first; with ways, some cells name it twice."""
    rng = random.Random(5)
    place = lambda i: PLACES[0] if i % 2 else rng.choice(PLACES)
    rows = {t: [[x, f"{t.lower()}{i}"] for i in range(n) for x in [place(i)]] for t in "SC"}
    if ways:
        for r in rows["C"][::3]:
            r[0] = f"{r[0]} ; {r[0]}s ; {rng.choice(PLACES)}"
    store = Store(spark)
    for t, r in rows.items():
        store.add(from_rows(spark, t, ["PLACE", "[SKIP] UID"], r))
    store.add(from_rows(spark, "T", ["PLACE", "PART", "[SKIP] UID"], [[p, "east" if i % 2 == 0 else "west", f"t{i}"] for i, p in enumerate(PLACES)]))
    return store


def solved_all(store, text, tasks):
    solved = {}
    for p in parse(text).patterns:
        solved[p.name] = plans.solve(store, p, None, solved=solved, tasks=None if p.components else tasks)
    return solved


def told(df):
    """All solutions with all their columns but the hash's arbitrary choice, each with how often it comes."""
    cols = sorted(c for c in df.columns)
    return Counter(repr(tuple(r[c] for c in cols)) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("ways", [False, True])
@pytest.mark.parametrize("cell", [1 << 20, 4])
def test_large_tables_give_the_same_solutions(spark, monkeypatch, ways, cell):
    monkeypatch.setattr(omni, "CELL", cell)
    store = store_of(spark, ways)
    for text in (SHARED, THREE):
        small, large = solved_all(store, text, None), solved_all(store, text, 3)
        for name in small:
            want = told(small[name])
            assert want and told(large[name]) == want and max(want.values()) == 1


def test_large_joins_compare_no_values_of_pairs_and_compare_no_solutions(spark):
    store = store_of(spark)
    for text, name in ((SHARED, "ab"), (THREE, "p")):
        df = solved_all(store, text, 3)[name]
        shown = plan(df.select(*(c for c in df.columns if c.startswith("uid_"))))
        assert "arrays_overlap" not in shown
        above = shown[: shown.index("Join")]
        assert "Aggregate" not in above and "Filter" not in above


def test_composites_of_solutions_that_may_come_twice_are_distinct(spark):
    store = store_of(spark)
    a, b, ab = parse(SHARED).patterns
    twice = {"a": plans.solve(store, a, None), "b": plans.solve(store, b, None)}
    want = told(plans.solve(store, ab, None, solved=twice))
    twice["a"] = twice["a"].unionByName(twice["a"])
    assert told(plans.solve(store, ab, None, solved=twice)) == want


def test_slots_that_are_not_filled_share_no_row(spark):
    store = store_of(spark)
    text = SHARED.replace('row t=[TABLE:"T", PLACE:<n>] end', 'row *t=[TABLE:"T", PLACE:<n>] end')
    small, large = solved_all(store, text, None)["ab"], solved_all(store, text, 3)["ab"]
    assert told(large) == told(small)
    assert large.where(F.col("uid_y__t").isNull()).isEmpty()


def test_the_limit_takes_the_same_solutions(spark):
    store, p = store_of(spark), parse('inferencepattern p row s=[TABLE:"S", PLACE:<n>] row *c=[TABLE:"C", PLACE:<n>] endinferencepattern').patterns[0]
    small, large = plans.solve(store, p, 30), plans.solve(store, p, 30, tasks=3)
    assert large.columns == small.columns and told(large) == told(small)
